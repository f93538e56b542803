"""Registry of queries: each plan has a Spark function and, where SQL can express it, DuckDB SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The entities as views of the driver's tables, in SQL; ``entities`` has the same in Spark.
PRELUDE = """
funds AS (SELECT s_suppkey AS fund_id, 'fund-' || s_suppkey AS slug, s_name AS name, n_name AS country, r_name AS region, s_acctbal * 1000000 AS aum,
  CASE s_suppkey % 5 WHEN 0 THEN 'pe' WHEN 1 THEN 'vc' WHEN 2 THEN 'growth' WHEN 3 THEN 'debt' ELSE 'fof' END AS category,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE (s_suppkey % 10) * 1000000 END AS inv_min,
  CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE (s_suppkey % 10) * 1000000 + 5000000 * (1 + s_suppkey % 4) END AS inv_max
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
companies AS (SELECT p_partkey AS company_id, p_name || ' ' || p_partkey % 40 AS name, p_type AS sector, p_brand AS brand, p_size AS size FROM part),
items AS (SELECT l_suppkey AS fund_id, l_partkey AS company_id, CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN bool_and(l_linestatus = 'O') THEN 'current' WHEN bool_and(l_linestatus = 'F') THEN 'exited' ELSE 'partial' END AS status,
  CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE (l_partkey % 10) / 10.0 END AS confidence, CAST(min(l_shipdate) AS DATE) AS entry_date, count(*) AS n_deals FROM lineitem GROUP BY l_suppkey, l_partkey),
deals AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_suppkey AS fund_id, l_partkey AS company_id, o_custkey AS investor_id, l_extendedprice * (1 - l_discount) AS amount, l_quantity AS stake,
  CAST(o_orderdate AS DATE) AS deal_date, CAST(year(o_orderdate) AS INTEGER) AS deal_year, o_orderpriority AS priority, l_linestatus AS line_status FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
signals AS (SELECT event_id AS signal_id, user_id % 10 AS fund_id, CASE event_type WHEN 'view' THEN 'website_change' WHEN 'signup' THEN 'people_move' WHEN 'click' THEN 'deal_announced' WHEN 'error' THEN 'exit_announced' ELSE 'fundraise_announced' END AS type,
  least(value, 100) AS score, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS published_at, ts + INTERVAL 1 HOUR * (event_id % 3) AS observed_at, event_id % 200 AS company_id, user_id AS url_id, event_type FROM events),
docs AS (SELECT doc_id, text, lang, source, n_chars, split_part(text, chr(10), 1) AS title FROM documents)
"""


def plan(name: str, sql: str | None = None) -> Callable:
    """Registers a query. ``sql`` starts with SELECT, or with further common table expressions after a comma."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two plans named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {PRELUDE.strip()} {sql.strip()}"
        return f

    return add
