"""Running a set of judged queries over an index, and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from .search import Index, search

GOLDEN = "version string, corpusHash string, queries array<struct<id: string, language: string, text: string, category: string, slice: string, qrels: array<struct<doc: string, grade: int>>>>"


class FixtureError(ValueError):
    """The set of judged queries is not sound."""


def load_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, qrels) of a JSON file; ids must be unique, grades 0 to 3, and a grade positive for each query."""
    q = spark.read.schema(GOLDEN).json(path, multiLine=True).select(F.explode("queries").alias("q")).select("q.*")
    queries, qrels = q.select(F.col("id").alias("qid"), "language", F.col("text").alias("query"), "category", "slice"), q.select(F.col("id").alias("qid"), F.explode("qrels").alias("r")).select("qid", "r.doc", "r.grade")
    problems = {
        "an id is missing or repeated": queries.groupBy("qid").count().where("qid IS NULL OR count > 1"),
        "a query has no text or category": queries.where("query IS NULL OR trim(query) = '' OR category IS NULL"),
        "a grade is not 0 to 3": qrels.where("doc IS NULL OR grade IS NULL OR grade NOT BETWEEN 0 AND 3"),
        "a query has no relevant document": queries.join(qrels.where("grade > 0").select("qid").distinct(), "qid", "left_anti"),
        "a document is judged twice for a query": qrels.groupBy("qid", "doc").count().where("count > 1"),
    }
    for what, rows in problems.items():
        if rows.take(1):
            raise FixtureError(what)
    return queries, qrels


def run_golden(queries: DataFrame, qrels: DataFrame, index: Index, slice_: str | None = None, k: int = 10, **options) -> DataFrame:
    """category (null: all), n, ndcg, mrr, hit, recall of a search by document."""
    asked = queries.where(F.col("slice") == slice_) if slice_ else queries
    hits = search(asked.select("qid", "query"), index, k=3 * k, **options)
    docs = hits.groupBy("qid", F.col("file").alias("doc")).agg(F.min("rank").alias("first"))
    ranked = docs.withColumn("rank", F.row_number().over(metrics.Window.partitionBy("qid").orderBy("first")))
    return metrics.by_category(metrics.query_metrics(ranked, qrels, k), asked.select("qid", "category"))
