"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by the digest of the normalised text. Every batch, the
first one too, is reduced to one row a digest and held against the index by a sort-merge
anti-join, which reads the index's buckets as they lie; what the index has not is appended. A
batch has a name, and one that is added again finds what it brought itself to be new again and
appends nothing twice, so a batch whose run was lost can be repeated.

A table is added in batches of falling length, so that first come, first kept is the rule that
the longest stays: of equal texts the row with the most code points in the original text, then
the one with the smallest doc_id (null ids last), then the first of rows that repeat a doc_id;
exactly one row of a group stays. Null texts count as empty, and all empty texts are one group.
Texts are read whole, however long. Columns other than doc_id and text are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, salted_left_join, table, written

#: Keys of dropped rows that may be broadcast after they have been counted; more are joined by shuffling.
FEW = 50_000
WHITE = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without white space, lowercase hex; null is the empty text."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "").cast("binary"), 256)


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text_sha256, n_points, row_no (a number of its own for every row), written once."""
    rows = docs.select(F.col(key).alias("doc_id"), text_digest(F.col(text)).alias("text_sha256"),
                       F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_points"),
                       F.monotonically_increasing_id().alias("row_no"))
    return written(rows, "digests")


def winners(rows: DataFrame) -> DataFrame:
    """text_sha256, keep_id, keep_row, group_size: a row for each digest, by partial aggregation."""
    order = F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "row_no")
    best = F.min(F.struct(order.alias("o"), F.col("doc_id").alias("id"), F.col("row_no").alias("no"))).alias("b")
    return rows.groupBy("text_sha256").agg(best, F.count(F.lit(1)).alias("group_size")).select(
        "text_sha256", F.col("b.id").alias("keep_id"), F.col("b.no").alias("keep_row"), "group_size")


class DigestIndex:
    """A persistent table (text_sha256, keep_id, batch) bucketed and sorted by digest, one row a digest.

    It has as many buckets as the session has shuffle partitions unless told otherwise, so that
    batches meet it without an exchange on its side.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.buckets = spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.id_type = name or f"digest_index_{uuid.uuid4().hex}", id_type

    def rows(self) -> DataFrame:
        self.spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.name} (text_sha256 STRING, keep_id {self.id_type}, batch STRING) USING parquet
                           CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS""")
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        rows.select("text_sha256", "keep_id", "batch").repartition(self.buckets, "text_sha256").write.mode("append").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name)

    def fresh(self, best: DataFrame, batch: str) -> DataFrame:
        """The rows of best whose digest no other batch brought."""
        known = self.rows().where(F.col("batch") != batch).select("text_sha256")
        return best.hint("merge").join(known.hint("merge"), "text_sha256", "left_anti")

    def add(self, best: DataFrame, batch: str) -> DataFrame:
        """Appends what best (a row a digest, with keep_id) has new under the batch's name, and returns it."""
        new = written(self.fresh(best, batch), "fresh")
        own = self.rows().where(F.col("batch") == batch).select("text_sha256")
        self.append(new.select("text_sha256", "keep_id", F.lit(batch).alias("batch")).hint("merge").join(own.hint("merge"), "text_sha256", "left_anti"))
        return new

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def by_length(rows: DataFrame, batches: int) -> list[DataFrame]:
    """rows in batches of falling length: each time those above the mean length of what is left."""
    out = []
    for _ in range(batches - 1):
        mean = rows.agg(F.avg("n_points")).first()[0] or 0.0
        out.append(rows.where(F.col("n_points") > mean))
        rows = rows.where(F.col("n_points") <= mean)
    return [*out, rows]


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, batches: int = 2) -> DataFrame:
    """doc_id, row_no, n_points, keep_id, group_size, kept, text_sha256 for every row of docs, dropped ones too.

    With an index that has rows already, rows whose text it holds are not kept and their
    keep_id is the id that the index holds. Without one, the index goes when all is decided.
    """
    spark, rows = docs.sparkSession, digests(docs)
    own = index or DigestIndex(spark, id_type=docs.schema["doc_id"].dataType.simpleString())
    name, best, new = batch or uuid.uuid4().hex, None, None
    for i, part in enumerate(by_length(rows, batches)):
        one = written(winners(part), "batch-winners")
        came = own.add(one, f"{name}/{i}").select("text_sha256", "keep_row")
        best = one if best is None else best.unionByName(one)
        new = came if new is None else new.unionByName(came)
    # a digest may be of several batches: the index says whose row stays, the batches how many there are
    size = best.groupBy("text_sha256").agg(F.sum("group_size").alias("group_size"))
    held = own.rows().select("text_sha256", "keep_id")
    found = size.join(held, "text_sha256").join(new, "text_sha256", "left")
    found = written(found, "decided")
    if index is None:
        own.drop()
    joined = salted_left_join(rows, found, "text_sha256", F.col("row_no"))
    return joined.select("doc_id", "row_no", "n_points", "keep_id", "group_size", F.coalesce(F.col("row_no") == F.col("keep_row"), F.lit(False)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Rows are known by doc_id, digest and length; of rows that share all three one is kept.
    """
    key = ["doc_id", "text_sha256", "n_points"]
    i, sha, n, mark = free_name(docs.columns, "id", "sha", "points", "mark")
    marked = written(exact_dedup(docs).select(*key, "kept"), "marked")
    counts = marked.groupBy(*key).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")).where("NOT stays OR n > 1")
    gone = written(counts.select(F.col("doc_id").alias(i), F.col("text_sha256").alias(sha), F.col("n_points").alias(n), F.col("stays").alias(mark)), "gone")
    names = docs.columns
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (text_digest(F.col("text")) == F.col(sha)) & (F.coalesce(F.char_length("text"), F.lit(0)) == F.col(n))
    few = gone.limit(FEW + 1).count() <= FEW
    close = lambda df: F.broadcast(df) if few else df
    out = docs.join(close(gone), same, "left_anti")
    again = gone.where(mark)  # rows that repeat the one that stays
    if again.take(1):
        out = out.unionByName(docs.join(close(again), same).dropDuplicates([i, sha, n]).select(*names))
    return out


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, which come to a new index in two batches."""
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
