"""Rankings: fusion by reciprocal rank, top k, collapsing, federation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import RRF_K

#: Digits at which scores count as equal, so that the order of sums cannot make or break ties.
DIGITS = 9


def lanes_of(**lanes: DataFrame) -> DataFrame:
    """(qid, chunk_id, lane, score) of lanes of (qid, chunk_id, score)."""
    return reduce(DataFrame.unionByName, [df.select("qid", "chunk_id", F.lit(name).alias("lane"), F.col("score").cast("double").alias("score")) for name, df in lanes.items()])


def rrf(lanes: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K, by: tuple[str, ...] = ("qid",), many: str | None = None) -> DataFrame:
    """(qid, chunk_id, fused): the sum over lanes of weight / (k + rank); equal scores share the first rank.

    Scores of 0 and less do not count, nor do lanes without weight. A row may stand for as many chunks as the column many says.
    """
    weights = weights or {}
    kept = lanes.withColumn("score", F.round("score", DIGITS)).where("score > 0")
    for lane, w in weights.items():
        if w <= 0:
            kept = kept.where(F.col("lane") != lane)
    weight = reduce(lambda out, x: out.when(F.col("lane") == x[0], F.lit(float(x[1]))), weights.items(), F.when(F.lit(False), 0.0)).otherwise(F.lit(1.0))
    place = F.rank().over(Window.partitionBy(*by, "lane").orderBy(F.desc("score")))
    if many:
        upto = F.sum(many).over(Window.partitionBy(*by, "lane").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        place = upto - F.sum(many).over(Window.partitionBy(*by, "lane", "score")) + 1
    return kept.withColumn("rank", place).groupBy(*by, "chunk_id").agg(F.sum(weight / (k + F.col("rank"))).alias("fused"))


def top(ranked: DataFrame, k: int, *order: Column, by: tuple[str, ...] = ("qid",), rank: str = "rank") -> DataFrame:
    """The first k rows of each query; Spark limits groups before it shuffles them."""
    return ranked.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def collapse(hits: DataFrame, most: int, owner: Column | None = None, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The first `most` hits of each document in order of rank."""
    owner = owner if owner is not None else F.coalesce("canonical_ref", "file")
    w = Window.partitionBy(*by, "_owner").orderBy("rank")
    return hits.withColumn("_owner", owner).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_owner", "_n")


def federate(hits: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """(qid, vault, file, heading, score, rank and the best hit's columns) over hits with vault and rank.

    By place, without sharing of ranks; hits of one heading of a file add up. With one vault the
    scores pass through.
    """
    keys = ["qid", "vault", "file", "heading"]
    rest = [c for c in hits.columns if c not in keys]
    grouped = hits.groupBy(*keys).agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("fused"), F.min_by(F.struct(*rest), "rank").alias("hit"))
    vaults = grouped.select("vault").distinct().limit(2).count()
    score = F.col("hit.score") if vaults == 1 else F.round("fused", 12)
    cols = [F.col(f"hit.{c}").alias(c) for c in rest if c not in ("score", "rank")]
    return top(grouped.select(*keys, score.alias("score"), F.col("hit.score").alias("_own"), F.col("hit.rank").alias("_rank"), *cols), k, F.desc("score"), F.desc("_own"), F.asc("vault"), F.asc("_rank")).drop("_own", "_rank")
