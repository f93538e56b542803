"""Session factory: adaptive execution and UTC on, ANSI left on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "tessera", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session for analytics; cluster settings come from spark-submit unless given here."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship_code(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once a context, as --py-files would: they needn't have it installed."""
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if not getattr(sc, "_tessera_shipped", False):
        here = Path(__file__).resolve().parent
        name = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera_code.zip"
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(str(name))
        sc._tessera_shipped = True
    return spark
