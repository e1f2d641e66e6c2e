"""Measures of rankings, and deterministic splits of query sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .places import place


def graded(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """ranked(qid, doc, rank) with the grade of each document, 0 if it has none."""
    return ranked.join(qrels.select("qid", "doc", "grade"), ["qid", "doc"], "left").fillna({"grade": 0})


def query_metrics(ranked: DataFrame, qrels: DataFrame, k: int = 10, least: int = 1) -> DataFrame:
    """qid, ndcg, mrr, hit, recall, recall_true, ndcg_true of each query of ranked.

    ndcg is over the ideal order of what was retrieved, and recall counts a ranking of fewer
    than k as if the relevant rest came after it; the `_true` ones are over all of qrels.
    """
    return measures(graded(ranked, qrels), judged(qrels, k, least), k, least)


def judged(qrels: DataFrame, k: int = 10, least: int = 1) -> DataFrame:
    """(qid, relevant, best_all): the relevant documents of each query, and the gain of its k best."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "doc"))
    best = qrels.withColumn("p", place).where(F.col("p") <= k).groupBy("qid").agg(F.sum(F.col("grade") / F.log2(F.col("p") + 1)).alias("best_all"))
    return qrels.groupBy("qid").agg(F.count_if(F.col("grade") >= least).alias("relevant")).join(best, "qid", "left")


def measures(graded: DataFrame, judged: DataFrame, k: int = 10, least: int = 1) -> DataFrame:
    """query_metrics() of graded(qid, doc, rank, grade) and judged()'s totals."""
    df = graded.withColumn("ideal", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "rank")))
    gain = lambda at: F.sum(F.when(F.col(at) <= k, F.col("grade") / F.log2(F.col(at) + 1)))
    got = df.groupBy("qid").agg(
        gain("rank").alias("dcg"), gain("ideal").alias("best"), F.min(F.when(F.col("grade") >= least, F.col("rank"))).alias("first"),
        F.count_if((F.col("grade") >= least) & (F.col("rank") <= k)).alias("in_k"), F.count_if(F.col("grade") >= least).alias("in_all"), F.count(F.lit(1)).alias("n"))
    j = got.join(judged, "qid", "left").fillna({"relevant": 0, "best_all": 0.0})
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    short = F.col("n") < k
    missing = F.greatest(F.col("relevant") - F.col("in_all"), F.lit(0))
    in_k = F.when(short, F.col("in_all") + F.least(missing, F.greatest(F.lit(k) - F.col("n"), F.lit(0)))).otherwise(F.col("in_k"))
    base = F.when(short, F.col("in_all") + missing).otherwise(F.col("in_all"))
    return j.select("qid", ratio(F.col("dcg"), F.col("best")).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("in_k") > 0).cast("int").alias("hit"),
                    ratio(in_k, base).alias("recall"), ratio(F.col("in_k"), F.col("relevant")).alias("recall_true"), ratio(F.col("dcg"), F.col("best_all")).alias("ndcg_true"))


def redundancy(ranked: DataFrame, k: int) -> DataFrame:
    """qid, redundancy: the share of the first k whose document came before."""
    seen = F.row_number().over(Window.partitionBy("qid", "doc").orderBy("rank")) > 1
    return ranked.where(F.col("rank") <= k).withColumn("again", seen).groupBy("qid").agg(F.avg(F.col("again").cast("int")).alias("redundancy"))


def by_category(metrics: DataFrame, categories: DataFrame, names: tuple[str, ...] = ("ndcg", "mrr", "hit", "recall")) -> DataFrame:
    """category (null for all), n and the mean of each measure."""
    return metrics.join(categories, "qid").rollup("category").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in names])


def win_tie_loss(a: DataFrame, b: DataFrame, measure: str = "ndcg", slack: float = 1e-9) -> DataFrame:
    """One row: queries in which a is better than, equal to, worse than b."""
    d = F.col("a") - F.col("b")
    j = a.select("qid", F.col(measure).alias("a")).join(b.select("qid", F.col(measure).alias("b")), "qid")
    return j.agg(F.count_if(d > slack).alias("win"), F.count_if(F.abs(d) <= slack).alias("tie"), F.count_if(d < -slack).alias("loss"))


def slices(queries: DataFrame, dev: float = 0.7, test: float = 0.85) -> DataFrame:
    """queries(id, category) with slice: by category, ids in order, the first for dev, then test, then holdout."""
    n = F.count(F.lit(1)).over(Window.partitionBy("category"))
    r = F.row_number().over(Window.partitionBy("category").orderBy("id"))
    return queries.withColumn("slice", F.when(r <= F.floor(n * dev + 0.5), "dev").when(r <= F.floor(n * test + 0.5), "test").otherwise("holdout"))


def percentile(values: DataFrame, column: str, points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """One row p50, p95 ...: the value at place floor(p / 100 * n), at most the last, of the sorted ones."""
    n = values.count()
    at = {p: min(p * n // 100, max(0, n - 1)) for p in points}
    found = place(values.select(column), column).where(F.col("place").isin(*at.values()))
    return found.agg(*[F.max(F.when(F.col("place") == at[p], F.col(column))).alias(f"p{p}") for p in points])
