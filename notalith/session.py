"""Session settings that the plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str | None = None, app: str = "notalith", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def stored(df, tag: str):
    """df computed once and kept in the session's checkpoint folder; where none is set in a temporary one, but on a cluster that is an error."""
    import tempfile
    import uuid

    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='notalith-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a side that may be broadcast after they have been counted.
FEW = 100_000


def small(df, tag: str = "side"):
    """df, computed once and kept, with a broadcast hint if a count shows that it is small."""
    from pyspark.sql import functions as F

    df = stored(df, tag)
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df
