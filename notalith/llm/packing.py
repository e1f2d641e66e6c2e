"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

A document is its ids and an end id; longer ones than a sequence are cut into full pieces, the
first of which may be shorter. Only the numbers of pieces of each length reach the driver, as
many numbers as a sequence has tokens whatever the input. Best fit, longest first, then runs
over counts: sequences with equal room are one run, and all pieces of a length go to the run
with the least room that takes them. The plan says which ranks of a length go where, and
pieces take their slots by joining on rank within length. Ranks are counted in blocks of a
hash, so a length that most pieces have is not one task's work.

Null and empty texts are a document of the end id alone. Texts are taken whole. Rows that
repeat others are packed as often as they occur; null ids are kept. An empty table gives no
rows. Other columns have no influence.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import NEWER, byte_symbols
from .common import named_rows, small_batches, table, written

SEQUENCE = 2048
END_ID = 0
#: Blocks in which the ranks of a length are counted.
BLOCKS = 64
#: How byte-level vocabularies cut a text before merging; a fixed value.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteCoder:
    """Ids of texts, by the vocabulary of a byte-level BPE file.

    tiktoken runs the file's merges, as it is the faster; texts with letters that Unicode's
    versions class differently go to the tokenizers library. Tests hold the two together.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text())
        self.library = Tokenizer.from_file(path)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        of = {c: b for b, c in byte_symbols().items()}
        ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("file", pat_str=CUT, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if not NEWER.search(text):
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its regex engine gives up on very long runs of white space
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


_coders: dict[str, ByteCoder] = {}


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n if n <= size else n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def cut_batches(batches: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    if path not in _coders:
        _coders[path] = ByteCoder(path)
    c = _coders[path]
    for b in batches:
        at, piece, start, length, crc = [], [], [], [], []
        for i, t in enumerate(b.column("text")):
            data = memoryview(c.encode(t.as_py() or "").astype("<u4").tobytes() + END_ID.to_bytes(4, "little"))
            for k, (s, n) in enumerate(pieces_of(len(data) // 4, size)):
                at.append(i)
                piece.append(k)
                start.append(s)
                length.append(n)
                crc.append(zlib.crc32(data[4 * s : 4 * (s + n)]))
        ids = b.column("doc_id").take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def plan_packing(counts: dict[int, int], size: int = SEQUENCE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit over counts: (length, lo, hi, pieces a sequence, first sequence, offset) and the number of sequences.

    Piece of rank r in [lo, hi) goes to sequence first + (r - lo) // each, at
    offset + (r - lo) % each * length.
    """
    plan, runs, rooms, made = [], defaultdict(list), [], 0  # runs: room -> [(first sequence, how many)]

    def keep(room: int, first: int, many: int) -> None:
        if many and room:
            if not runs[room]:
                insort(rooms, room)
            runs[room].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        for room in rooms[bisect_left(rooms, length) :]:
            each = room // length
            waiting, runs[room] = runs[room], []
            rooms.remove(room)
            for first, many in waiting:
                used = min(many, -(-(total - rank) // each))
                if used:
                    n = min(total - rank, used * each)
                    plan.append((length, rank, rank + n, each, first, size - room))
                    full, rest = divmod(n, each)
                    keep(room - each * length, first, full)
                    if rest:
                        keep(room - rest * length, first + full, 1)
                    rank += n
                keep(room, first + used, many - used)
            if rank == total:
                break
        if rank < total:
            each = size // length
            used = -(-(total - rank) // each)
            plan.append((length, rank, total, each, made, 0))
            full, rest = divmod(total - rank, each)
            keep(size - each * length, made, full)
            if rest:
                keep(size - rest * length, made + full, 1)
            made += used
    return plan, made


def pack(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", "text").mapInArrow(lambda b: cut_batches(b, path, size), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    cut = written(cut.withColumn("row_no", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("row_no"), F.lit(BLOCKS)).cast("int")), "pieces")
    counted = cut.groupBy("length", "block").count()
    # size * BLOCKS numbers at most
    cells = {(r["length"], r["block"]): r["count"] for r in counted.collect()}
    counts, firsts = defaultdict(int), []
    for (length, block), n in sorted(cells.items()):
        firsts.append((length, block, counts[length]))
        counts[length] += n
    plan, _ = plan_packing(counts, size)
    firsts = F.broadcast(named_rows(spark, firsts or [(-1, 0, 0)], "length bigint, block int, before bigint"))
    slots = F.broadcast(named_rows(spark, plan or [(-1, 0, 0, 1, 0, 0)], "length bigint, lo bigint, hi bigint, each bigint, first bigint, base bigint"))
    ranked = cut.withColumn("at", F.row_number().over(Window.partitionBy("length", "block").orderBy("row_no")) - 1)
    ranked = ranked.join(firsts, ["length", "block"]).withColumn("rank", F.col("before") + F.col("at"))
    placed = ranked.join(slots, (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(slots["length"])
    step = F.col("rank") - F.col("lo")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
                         (F.col("base") + step % F.col("each") * F.col("length")).cast("long").alias("offset"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
