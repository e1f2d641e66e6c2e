"""What the corpus operators share: reading tables, shared storage, joins that survive a hot key."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copies of the small side of a salted join; a key's rows go to so many tasks.
SALTS = 8
#: Narrow rows of a file of an intermediate table.
ROWS_A_FILE = 50_000
#: Rows and bytes of a batch of texts.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set a temporary one, but on a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='notalith-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, tag: str, parts: int | None = None) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder; this cuts its lineage.

    Where the rows are known to be few, parts (of parts_for) spares the store many small files.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    (df.coalesce(parts) if parts else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of a bounded number of rows and, where Spark knows that setting, of bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def parts_for(rows: int, a_file: int = ROWS_A_FILE) -> int:
    """Files for so many rows, narrow ones unless told otherwise."""
    return max(1, -(-rows // a_file))


def free_name(taken: list[str], *wished: str) -> str | tuple[str, ...]:
    """Names like those wished for that no column of taken has, whatever its case."""
    held, out = {c.lower() for c in taken}, []
    for w in wished:
        while w.lower() in held:
            w = f"{w}_"
        held.add(w.lower())
        out.append(w)
    return out[0] if len(out) == 1 else tuple(out)


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of plans that nothing holds any more; it waits for a collection of garbage."""
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes what written() made; df cannot be read after."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def salted_left_join(rows: DataFrame, facts: DataFrame, key: str, spread, salts: int = SALTS) -> DataFrame:
    """rows LEFT JOIN facts on key, where facts has one row a key and a key may hold most rows.

    Each fact is copied once a salt and each row takes the salt of `spread`, so a hot key's rows
    meet its fact in several tasks; both sides arrive by plain exchanges, which adaptive
    execution can split further.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = facts.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def named_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's own numbers as literals of the plan, without an RDD."""
    import json

    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(x.strip().replace(' ', ': ') for x in schema.split(','))}>>")))
