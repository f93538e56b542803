"""File sources: JSON documents, maps of arrays, CSV folders, feeds, delimited text. Everything goes through Spark's readers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_documents(spark: SparkSession, path: str, schema: str, records: str | None = None) -> DataFrame:
    """Whole-file JSON by a schema; with ``records``, the rows of that array column. Malformed files give nulls."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return df.select(F.inline(records)) if records else df


def map_of_arrays(df: DataFrame, column: str, key: str) -> DataFrame:
    """A column of type map<string, array<struct>> as rows: the key and the struct's fields."""
    return df.select(F.explode(column).alias(key, "_list")).select(key, F.inline("_list"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: Sequence[str], read) -> DataFrame:
    """The first path that exists, read by ``read(path)``: enriched before filtered before raw."""
    for p in paths:
        if exists(spark, p):
            return read(p)
    raise FileNotFoundError(", ".join(paths))


def csv_folder(spark: SparkSession, path: str, schema: str | None = None, attribute: str = "category") -> DataFrame:
    """A folder of CSV files whose names are an attribute's value: 'private-equity.csv' gives 'Private Equity'."""
    r = spark.read.option("header", True).option("multiLine", True)
    df = (r.schema(schema) if schema else r).csv(path)
    name = F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), r"^(.*)\.csv$", 1)
    return df.select("*", F.initcap(F.regexp_replace(name, "[-_]+", " ")).alias(attribute))


def feed_items(spark: SparkSession, path: str, row: str = "item") -> DataFrame:
    """Entries of RSS files: title, link, published (raw text)."""
    schema = "title string, link string, pubDate string, description string"
    df = spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    return df.select("title", "link", F.col("pubDate").alias("published"), "description")


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files: title, link (the first one's address), published (raw text; the update where it is missing), description."""
    text = "struct<_VALUE: string, _type: string>"
    schema = f"title {text}, link array<struct<_href: string, _rel: string>>, published string, updated string, summary {text}, content {text}"
    df = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return df.select(F.col("title._VALUE").alias("title"), F.try_element_at("link", F.lit(1))["_href"].alias("link"), F.coalesce("published", "updated").alias("published"), F.coalesce("summary._VALUE", "content._VALUE").alias("description"))


def markdown_tables(spark: SparkSession, path: str) -> DataFrame:
    """Rows of pipe tables in text files: file, cells; rules between header and body are skipped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("line"))
    rows = lines.where(F.col("line").startswith("|") & ~F.rlike("line", F.lit(r"^\|[\s:|-]+\|?$")))
    return rows.select("file", F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)).alias("cells"))


def markdown_links(spark: SparkSession, path: str) -> DataFrame:
    """Links of markdown files: label, url."""
    found = F.regexp_extract_all("value", F.lit(r"(\[[^\]]+\]\(https?://[^)\s]+\))"), 1)
    return spark.read.text(path).select(F.explode(found).alias("m")).select(F.regexp_extract("m", r"\[([^\]]+)\]", 1).alias("label"), F.regexp_extract("m", r"\((https?://[^)\s]+)\)", 1).alias("url"))


def renamed(df: DataFrame, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """Records under variant field names made uniform: the first variant present and not null wins."""

    def pick(variants: Sequence[str]) -> Column:
        own = [F.col(v) for v in variants if v in df.columns]
        return F.coalesce(*own) if own else F.lit(None).cast("string")

    return df.select(*(pick(v).alias(k) for k, v in names.items()))


def table_rows(df: DataFrame, cells: str, header: Sequence[str], names: Mapping[str, Sequence[str]]) -> DataFrame:
    """Cells of parsed rows under canonical names, by a header whose spelling varies; absent columns are null."""
    low = [h.strip().lower() for h in header]
    at = {k: next((low.index(v.lower()) for v in variants if v.lower() in low), None) for k, variants in names.items()}
    return df.select(*((F.nullif(F.trim(F.get(cells, F.lit(i))), F.lit("")) if i is not None else F.lit(None).cast("string")).alias(k) for k, i in at.items()))
