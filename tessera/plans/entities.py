"""The entities of the data model as views of the input tables: funds, companies, portfolio items, deals, signals, titled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Entities:
    """Lazy views over one folder of tables; only the columns that a query uses are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def funds(self) -> DataFrame:
        places = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        i = F.col("s_suppkey")
        return self.table("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
            i.alias("fund_id"), F.concat(F.lit("fund-"), i).alias("slug"), F.col("s_name").alias("name"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), (F.col("s_acctbal") * 1000000).alias("aum"),
            F.when(i % 5 == 0, "pe").when(i % 5 == 1, "vc").when(i % 5 == 2, "growth").when(i % 5 == 3, "debt").otherwise("fof").alias("category"),
            F.when(i % 7 != 0, (i % 10) * 1000000).alias("inv_min"),
            F.when(i % 11 == 0, 0).otherwise((i % 10) * 1000000 + 5000000 * (1 + i % 4)).alias("inv_max"),
        )

    @property
    def companies(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("company_id"), F.concat("p_name", F.lit(" "), F.col("p_partkey") % 40).alias("name"), F.col("p_type").alias("sector"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))

    @property
    def items(self) -> DataFrame:
        k = F.col("l_partkey")
        return self.table("lineitem").groupBy(F.col("l_suppkey").alias("fund_id"), k.alias("company_id")).agg(
            F.bool_and(F.col("l_linestatus") == "O").alias("all_open"), F.bool_and(F.col("l_linestatus") == "F").alias("all_closed"), F.min("l_shipdate").cast("date").alias("entry_date"), F.count("*").alias("n_deals")
        ).select(
            "fund_id", "company_id", F.when(F.col("company_id") % 13 == 0, F.lit(None).cast("string")).when(F.col("all_open"), "current").when(F.col("all_closed"), "exited").otherwise("partial").alias("status"),
            F.when(F.col("company_id") % 9 != 0, (F.col("company_id") % 10) / F.lit(10.0)).alias("confidence"), "entry_date", "n_deals",
        )

    @property
    def deals(self) -> DataFrame:
        joined = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("fund_id"), F.col("l_partkey").alias("company_id"), F.col("o_custkey").alias("investor_id"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"), F.col("l_quantity").alias("stake"), F.col("o_orderdate").cast("date").alias("deal_date"), F.year("o_orderdate").alias("deal_year"),
            F.col("o_orderpriority").alias("priority"), F.col("l_linestatus").alias("line_status"),
        )

    @property
    def signals(self) -> DataFrame:
        i, kind = F.col("event_id"), F.col("event_type")
        return self.table("events").select(
            i.alias("signal_id"), (F.col("user_id") % 10).alias("fund_id"),
            F.when(kind == "view", "website_change").when(kind == "signup", "people_move").when(kind == "click", "deal_announced").when(kind == "error", "exit_announced").otherwise("fundraise_announced").alias("type"),
            F.least("value", F.lit(100.0)).alias("score"), F.when(i % 7 != 0, F.col("ts")).alias("published_at"), F.expr("ts + make_interval(0, 0, 0, 0, CAST(event_id % 3 AS INT))").alias("observed_at"), (i % 200).alias("company_id"), F.col("user_id").alias("url_id"), kind,
        )

    @property
    def docs(self) -> DataFrame:
        return self.table("documents").select("doc_id", "text", "lang", "source", "n_chars", F.substring_index("text", "\n", 1).alias("title"))
