"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame operations only).

Every shard has `vnodes` points on a ring of hashes and owns the arcs that end there. A row
belongs to the arc that its doc_id and text hash into. A shard's bound is its even share of
the rows; rows that find a full shard continue clockwise. The rows are only counted by arc:
the walk round the ring is planned on these counts, whose number is shards * vnodes whatever
the input, and rows then find their place by rank within their arc.

Law `rows`: the bound is the even share exactly, so counts differ by one at most. Null ids and
texts are hashed as such, rows that repeat others entirely share an arc; ties in an arc go by
doc_id and then text checksum. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import blake2b

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import named_rows, table, written

SHARDS = 40
VNODES = 64
#: The ring has so many places; hashes are taken modulo it.
RING_BITS = 40


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(end of arc, shard), ascending; a shard's points do not depend on how many shards there are."""
    at = {}
    for s in range(shards):
        for v in range(vnodes):
            at.setdefault(int.from_bytes(blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") >> (64 - RING_BITS), s)
    return sorted(at.items())


def walk(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): who holds which ranks of each arc.

    Home rows come first; each shard's bound is n // shards, and one more for the first
    n % shards shards. What finds no room moves on clockwise, round the ring.
    """
    n = sum(counts)
    free = [n // shards + (s < n % shards) for s in range(shards)]
    filled, plan, waiting = [0] * shards, [], []

    def put(arc: int, lo: int, hi: int, shard: int) -> int:
        m = min(hi - lo, free[shard])
        if m:
            plan.append((arc, lo, lo + m, shard, filled[shard]))
            free[shard] -= m
            filled[shard] += m
        return lo + m

    for arc, c in enumerate(counts):
        lo = put(arc, 0, c, owners[arc])
        if lo < c:
            waiting.append((arc, lo, c))
    here, carried = {a: (a, lo, hi) for a, lo, hi in waiting}, []
    for arc in [*range(len(counts))] * 2:  # the second round is for what passed the end of the ring
        left = []
        for a, lo, hi in carried:
            lo = put(a, lo, hi, owners[arc])
            if lo < hi:
                left.append((a, lo, hi))
        carried = left + ([here.pop(arc)] if arc in here else [])
    return plan


def shard_rows(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    spark = docs.sparkSession
    points = ring(shards, vnodes)
    ends = [p for p, _ in points]
    owners = [s for _, s in points]
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("point", F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32"), 64 - RING_BITS))
    # the arcs as a step table over the top bits, then the few ends inside a step
    step_bits = 11
    step = F.shiftright(F.col("point"), RING_BITS - step_bits).cast("int")
    width = 1 << (RING_BITS - step_bits)
    first = [bisect_left(ends, i * width) for i in range((1 << step_bits) + 1)]
    inside = [ends[first[i]:first[i + 1]] for i in range(1 << step_bits)]
    steps = F.broadcast(named_rows(spark, [(i, first[i], inside[i]) for i in range(1 << step_bits)], "step int, base int, inside array<bigint>"))
    rows = rows.withColumn("step", step).join(steps, "step").withColumn(
        "arc", F.pmod(F.col("base") + F.size(F.filter("inside", lambda e: e < F.col("point"))), F.lit(len(points))))
    rows = written(rows.select("doc_id", "size", "text_crc32", "point", "arc"), "ring-rows")
    counts = [0] * len(points)
    for r in rows.groupBy("arc").count().collect():
        counts[r["arc"]] = r["count"]
    plan = F.broadcast(named_rows(spark, walk(counts, owners, shards) or [(-1, 0, 0, 0, 0)], "arc int, lo bigint, hi bigint, shard int, slot0 bigint"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy("point", "doc_id", "text_crc32", "size")) - 1)
    placed = ranked.join(plan, (ranked.arc == plan.arc) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         (F.col("slot0") + F.col("rank") - F.col("lo")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
