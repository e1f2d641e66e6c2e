"""Places in a global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def place(rows: DataFrame, key: str) -> DataFrame:
    """rows with place: from 0 in order of key, ranked in the ranges of a sort and shifted by what lies before."""
    sorted_ = rows.repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    kept = stored(sorted_, "ranges")
    counts = kept.groupBy("_p").count()  # a row for each range, so as many as there are shuffle partitions
    before = counts.select("_p", (F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("count")).alias("_before"))
    w = Window.partitionBy("_p").orderBy(key)
    return kept.withColumn("_r", F.row_number().over(w)).join(F.broadcast(before), "_p").withColumn("place", F.col("_before") + F.col("_r") - 1).drop("_p", "_r", "_before")
