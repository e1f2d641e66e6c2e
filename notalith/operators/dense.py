"""Dense lanes: exact, clustered and int8 scans of chunks for a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import products
from ..functions.vectors import asymmetric_cosine, dot
from ..schemas import NPROBE
from ..session import small
from . import ivf


#: Queries of a batch that is broadcast; more are dealt into blocks of so many.
BATCH = 1024
#: Chunks and queries that one task of a scan holds, and the chunks below which a shard is not split further.
SHARD, BLOCK, LEAST = 65_536, 16_384, 4_096


def exact(chunks: DataFrame, queries: DataFrame, key: str = "chunk_id", int8: bool = False, eligible: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, score) of every candidate for every query of queries(qid, vec).

    A batch of queries meets each chunk as one array, so rows are only multiplied where scores
    leave the scan. A batch that a count shows to be small is broadcast; else queries are dealt
    into blocks and chunks into shards, and each pair of them meets in a task of its own.
    """
    score = (lambda q: asymmetric_cosine(q, F.col("vec"))) if int8 else (lambda q: dot(q, F.col("vec")))
    rows = chunks.select(F.col(key).alias("chunk_id"), "vec").where(F.col("vec").isNotNull())
    asked = F.collect_list(F.struct("qid", F.col("vec").alias("q"))).alias("qs")
    n = queries.limit(BATCH + 1).count()
    if n <= BATCH:
        met = rows.crossJoin(F.broadcast(queries.agg(asked)))
    else:
        blocks = -(-queries.count() // BATCH)
        shards = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        batches = queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks))).groupBy("block").agg(asked).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        met = dealt.hint("shuffle_hash").join(batches, ["block", "shard"])
    out = met.select("chunk_id", F.explode(F.transform("qs", lambda q: F.struct(q["qid"].alias("qid"), score(q["q"]).alias("score")))).alias("x")).select("x.qid", "chunk_id", "x.score")
    return out if eligible is None else out.join(eligible.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_semi")


def clustered(assigned: DataFrame, centroids: DataFrame, queries: DataFrame, nprobe: int = NPROBE, key: str = "chunk_id", keep_rest: bool = True) -> DataFrame:
    """(qid, chunk_id, score): products in the probed clusters; chunks of others have -1, or are left out."""
    probed = ivf.probe(queries, centroids, nprobe).join(queries.select("qid", F.col("vec").alias("q")), "qid")
    near = assigned.join(small(probed), "cluster").select("qid", F.col(key).alias("chunk_id"), dot(F.col("q"), F.col("vec")).alias("score"))
    if not keep_rest:
        return near
    every = assigned.select(F.col(key).alias("chunk_id")).crossJoin(small(queries.select("qid")))
    return every.join(near, ["qid", "chunk_id"], "left").fillna({"score": -1.0})


def met(chunks: DataFrame, queries: DataFrame, fold, schema: str, key: str = "chunk_id", within: str | None = None) -> DataFrame:
    """fold(chunks, queries) of each shard of chunks and block of queries, as Arrow tables; the chunks come in order of id.

    Chunks are sent once a block, queries once a shard, and a task holds one of each, whatever
    their numbers. With within, only chunks and queries of one value of that column meet.
    """
    import pyarrow as pa

    rows = chunks.select(F.col(key).alias("chunk_id"), "vec", *([within] if within else [])).where(F.col("vec").isNotNull())
    n, asked = rows.count(), queries.count()
    cores = 1 if within else chunks.sparkSession.sparkContext.defaultParallelism
    shards, blocks = max(1, -(-n // SHARD), min(cores, -(-n // LEAST))), max(1, -(-asked // BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    by = ["_shard", "_block", *([within] if within else [])]
    left = rows.withColumn("_shard", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int")).withColumn("_block", every(blocks))
    right = queries.withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("_shard", every(shards))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return fold(left.sort_by("chunk_id"), right)

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, schema)


def typed(chunks: DataFrame, queries: DataFrame, key: str) -> str:
    return f"qid {queries.schema['qid'].dataType.simpleString()}, chunk_id {chunks.schema[key].dataType.simpleString()}, score double"


def nearest(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", int8: bool = False, within: str | None = None, floor: float | None = None) -> DataFrame:
    """(qid, chunk_id, score): of every candidate, the k of the largest scores for each query, ties to the smaller id, and possibly more.

    Scores are those of exact(), to nine digits, or floor where that is more. Products of a shard and a
    block are made as matrices, and only a shard's best leave its task.
    """

    def fold(left, right):
        return products.best(left, right, k, int8, floor)

    out = met(chunks, queries.select("qid", "vec", *([within] if within else [])), fold, typed(chunks, queries, key), key, within)
    return out.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("chunk_id")))).where(F.col("_r") <= k).drop("_r") if within is None else out


def probed(assigned: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int = NPROBE, key: str = "chunk_id") -> DataFrame:
    """The first k of clustered()'s candidates for each query, and possibly more: a cluster meets the queries that probe it."""
    asked = ivf.probe(queries, centroids, nprobe).join(queries.select("qid", "vec"), "qid")
    return nearest(assigned, asked, k, key, within="cluster")


def above(chunks: DataFrame, queries: DataFrame, marks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """marks(qid, score), each once, with above: the candidates whose score, to nine digits, is larger."""
    held = marks.groupBy("qid").agg(F.sort_array(F.collect_set("score")).alias("marks"))
    kind = queries.schema["qid"].dataType.simpleString()
    part = met(chunks, queries.select("qid", "vec").join(held, "qid"), products.above, f"qid {kind}, score double, above bigint", key)
    return part.groupBy("qid", "score").agg(F.sum("above").alias("above"))


def spread(chunks: DataFrame, queries: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(qid, n, not_positive, least): candidates, those whose score to nine digits is not above 0, and the least score."""
    kind = queries.schema["qid"].dataType.simpleString()
    part = met(chunks, queries.select("qid", "vec"), products.spread, f"qid {kind}, n bigint, not_positive bigint, least double", key)
    return part.groupBy("qid").agg(F.sum("n").alias("n"), F.sum("not_positive").alias("not_positive"), F.min("least").alias("least"))


def max_similarity(chunks: DataFrame, queries: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(qid, best): the largest product over all chunks."""
    return nearest(chunks, queries, 1, key).groupBy("qid").agg(F.max("score").alias("best"))
