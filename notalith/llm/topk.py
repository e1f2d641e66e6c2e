"""Exact top-k inner-product search with a KD-tree in each shard of the candidates.

Components are turned into floor(64 * x). Candidates are dealt into shards by median splits
fitted on a bounded sample, so that a shard is a region; regions with more rows than a shard
takes are dealt further by hashing. A shard's tree (median splits of the widest dimension, tight
boxes) is built once and stored with the shard's own box. A query first goes to the shard with
the best bound for it, and then, with the kth score found there, to the others whose bounds still
beat it. In a shard it goes down the tree level by level with the bound that a box puts on its
score, and then visits leaves best first: in each round every query goes to its best unvisited
boxes, and queries that meet in a box are scored together. A box is passed over if its bound is
below the query's kth score, or equals it when the box holds only larger ids. Bounds of queries
on shards are computed in blocks of both; a pair of a query and a shard is shuffled only if the
shard is open to the query. Pairs, queries and trees meet by sort-merge joins: pairs take a bit a
row in a file, and by that size Spark would send millions of them through the driver.

Vectors that are null or hold null or non-finite components take no part. Only vectors of a
query's own length are its candidates, and no row with the query's id is. Rows that repeat an
id are candidates each; a query id that repeats is answered once, for its smallest vector.
Queries without candidates have no rows; an empty table gives none. Scores beyond 64 bits
are held at their limits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

SCALE, TOP, EVERY = 64, 20, 20
#: Vectors of a shard and of a leaf, queries of a block, and boxes of a block.
SHARD, LEAF, BLOCK, BOXES = 4096, 64, 1024, 1024
#: Vectors that splits are fitted on, about, and levels of splits at most.
SAMPLE, LEVELS = 1 << 14, 10
NONE = -(1 << 63)
FOUND = "query_id long, vec_id long, score long"


class KDTree:
    """Nodes in level order: the rows of order[lo:hi], their box and smallest id."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.lo, self.hi, self.kids, self.box_lo, self.box_hi, self.least = [], [], [], [], [], []
        level = [(0, len(points))]
        nodes = [(0, len(points))]
        while level:
            below = []
            for lo, hi in level:
                p = points[order[lo:hi]]
                self.box_lo.append(p.min(0))
                self.box_hi.append(p.max(0))
                self.least.append(ids[order[lo:hi]].min())
                wide = self.box_hi[-1] - self.box_lo[-1]
                dim = int(wide.argmax())
                if hi - lo > leaf:
                    if wide[dim] > 0:
                        order[lo:hi] = order[lo:hi][np.argsort(p[:, dim], kind="stable")]
                    mid = (lo + hi) // 2
                    self.kids.append((len(nodes), len(nodes) + 1))
                    nodes += [(lo, mid), (mid, hi)]
                    below += [(lo, mid), (mid, hi)]
                else:
                    self.kids.append(None)
            level = below
        self.nodes, self.order = nodes, order
        self.box_lo, self.box_hi, self.least = np.array(self.box_lo), np.array(self.box_hi), np.array(self.least)
        self.points, self.ids = points[order], ids[order]

    def stored(self) -> bytes:
        """The tree as bytes, its numbers in the narrowest type that holds them."""
        narrow = next((t for t in (np.int16, np.int32, np.int64) if np.abs(self.points).max(initial=0) < np.iinfo(t).max), np.float64)
        return pickle.dumps({**self.__dict__, "points": self.points.astype(narrow), "box_lo": self.box_lo.astype(narrow), "box_hi": self.box_hi.astype(narrow), "order": None}, 5)

    @classmethod
    def loaded(cls, data: bytes) -> KDTree:
        tree = cls.__new__(cls)
        tree.__dict__ = pickle.loads(data)
        tree.points, tree.box_lo, tree.box_hi = (x.astype(np.float64) for x in (tree.points, tree.box_lo, tree.box_hi))
        return tree


class Splits:
    """A full binary tree of splits of space, median ones of a sample; a cell is a leaf."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels, self.dims, self.cuts = levels, np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1)
        parts = [sample]
        for node in range(len(self.dims)):
            p = parts[node]
            if len(p):
                self.dims[node] = int((p.max(0) - p.min(0)).argmax())
                x = p[:, self.dims[node]]
                self.cuts[node] = np.median(x)
                parts += [p[x <= self.cuts[node]], p[x > self.cuts[node]]]
            else:
                parts += [p, p]
            parts[node] = None

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.dims[node]] > self.cuts[node])
        return node - len(self.dims)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of whole numbers, exactly; in floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a @ b).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object)
    return np.clip(exact, NONE + 1, (1 << 63) - 1).astype(np.int64)


def merge(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties to the smaller id."""
    at = np.lexsort((ids, -score.astype(np.float64)) if np.abs(score).max(initial=0) < 2**53 else (ids, ~score), axis=1)[:, :k]
    return np.take_along_axis(score, at, 1), np.take_along_axis(ids, at, 1)


def search(tree: KDTree, queries: np.ndarray, query_ids: np.ndarray, kth: np.ndarray, kth_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best of each query that can be among its k best anywhere; NONE fills up.

    kth and kth_id are what each query has found elsewhere: its kth score and that row's id.
    """
    n, far = len(queries), np.iinfo(np.int64).max
    score, ids = np.full((n, k), NONE, np.int64), np.full((n, k), far, np.int64)
    above, below = np.maximum(queries, 0), np.minimum(queries, 0)

    def bounds(node: int, who: np.ndarray) -> np.ndarray:
        return product(above[who], tree.box_hi[node][:, None])[:, 0] + product(below[who], tree.box_lo[node][:, None])[:, 0]

    def open_(bound: np.ndarray, least, who: np.ndarray) -> np.ndarray:
        return (bound > kth[who]) | ((bound == kth[who]) & (least < kth_id[who]))

    frontier, q, leaf, ub = [(0, np.arange(n))], [], [], []
    while frontier:
        below_ = []
        for node, who in frontier:
            b = bounds(node, who)
            keep = open_(b, tree.least[node], who)
            who, b = who[keep], b[keep]
            if len(who) and tree.kids[node]:
                below_ += [(c, who) for c in tree.kids[node]]
            elif len(who):
                q.append(who)
                leaf.append(np.full(len(who), node))
                ub.append(b)
        frontier = below_
    if not q:
        return score, ids
    q, leaf, ub = np.concatenate(q), np.concatenate(leaf), np.concatenate(ub)
    order = np.lexsort((leaf, ~ub, q))
    q, leaf, ub = q[order], leaf[order], ub[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)  # of a box in its query's order
    a, width = 0, 1
    while a <= place.max():
        due = np.flatnonzero((place >= a) & (place < a + width))
        due = due[open_(ub[due], tree.least[leaf[due]], q[due])]
        due = due[np.argsort(leaf[due], kind="stable")]
        starts = [*np.flatnonzero(np.diff(leaf[due], prepend=-1)), len(due)]
        for i, j in zip(starts, starts[1:], strict=False):
            lo, hi = tree.nodes[leaf[due[i]]]
            who = q[due[i:j]]
            s = product(queries[who], tree.points[lo:hi].T)
            c = np.broadcast_to(tree.ids[lo:hi], s.shape)
            own = c == query_ids[who][:, None]
            s, c = np.where(own, NONE, s), np.where(own, far, c)
            score[who], ids[who] = merge(np.concatenate([score[who], s], 1), np.concatenate([ids[who], c], 1), k)
            better = (score[who, -1] > kth[who]) | ((score[who, -1] == kth[who]) & (ids[who, -1] < kth_id[who]))
            up = who[better]
            kth[up], kth_id[up] = score[up, -1], ids[up, -1]
        a, width = a + width, width * 2
    return score, ids


def as_matrix(vectors: pa.ChunkedArray | pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, floor(SCALE * x)) for each length of vectors."""
    v = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = v.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lengths)
    out = []
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        at = (ends[rows] - d)[:, None] + np.arange(d)
        out.append((rows, np.floor(SCALE * flat[at])))
    return out


def in_cells(batches: Iterator[pa.RecordBatch], splits: dict[int, Splits]) -> Iterator[pa.RecordBatch]:
    """vec_id, embedding, dim and cell of each row; lengths without splits are one cell."""
    for b in batches:
        dim, cell = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32)
        for at, m in as_matrix(b.column("embedding")) if b.num_rows else []:
            dim[at] = m.shape[1]
            cell[at] = splits[m.shape[1]].cells(m) if m.shape[1] in splits else 0
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(dim), pa.array(cell)], names=["vec_id", "embedding", "dim", "cell"])


def shard_tree(rows: pa.Table) -> pa.Table:
    """The one row of a shard: its box, smallest id and tree."""
    key = [rows[c][0].as_py() for c in ("dim", "cell", "part")]
    (_, points), = as_matrix(rows["embedding"])
    tree = KDTree(points, rows["vec_id"].to_numpy())
    number = key[0] << 36 | key[1] << 24 | key[2]
    return pa.table({"shard": [number], "dim": pa.array([key[0]], pa.int32()), "low": [tree.box_lo[0].tolist()], "high": [tree.box_hi[0].tolist()], "least": [int(tree.least[0])], "tree": [tree.stored()]})


def open_shards(queries: pa.Table, boxes: pa.Table, first: bool) -> pa.Table:
    """(query_id, shard, bound): of a block of queries and one of boxes the best box for each query, or with first unset all but its home that may hold one of its k best."""
    out = []
    by_dim = {d: np.flatnonzero(boxes["dim"].to_numpy() == d) for d in np.unique(boxes["dim"].to_numpy())} if boxes.num_rows else {}
    for at, m in as_matrix(queries["embedding"]) if queries.num_rows else []:
        mine = by_dim.get(m.shape[1])
        if mine is None:
            continue
        low, high = (np.array(boxes[c].take(mine).to_pylist()) for c in ("low", "high"))
        shard, least = boxes["shard"].to_numpy()[mine], boxes["least"].to_numpy()[mine]
        bound = product(np.maximum(m, 0), high.T) + product(np.minimum(m, 0), low.T)
        if first:
            q, s = np.arange(len(m)), bound.argmax(1)
        else:
            kth, kth_id, home = (queries[c].to_numpy()[at][:, None] for c in ("kth", "kth_id", "home"))
            q, s = np.nonzero(((bound > kth) | ((bound == kth) & (least < kth_id))) & (shard != home))
        out.append(pa.table({"query_id": queries["query_id"].to_numpy()[at][q], "shard": shard[s], "bound": bound[q, s]}))
    return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "shard", "bound")})


def search_shard(queries: pa.Table, shards: pa.Table, k: int = TOP) -> pa.Table:
    """What a block of queries finds in a shard."""
    found = []
    for tree in map(KDTree.loaded, shards["tree"].to_pylist() if queries.num_rows else []):
        for at, m in as_matrix(queries["embedding"]):
            qid = queries["query_id"].to_numpy()[at]
            score, ids = search(tree, m, qid, queries["kth"].to_numpy()[at].copy(), queries["kth_id"].to_numpy()[at].copy(), k)
            real = score > NONE
            found.append(pa.table({"query_id": np.repeat(qid, k)[real.ravel()], "vec_id": ids[real], "score": score[real]}))
    return pa.concat_tables(found) if found else pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})


def fitted(rows: DataFrame, n: int, shard: int) -> dict[int, Splits]:
    """Splits for each length of vectors, of a sample of about SAMPLE rows."""
    levels = min(LEVELS, max(0, (-(-n // shard) - 1).bit_length()))
    if not levels:
        return {}
    every = -(-n // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(every)) == 0).select("embedding").toArrow()
    return {m.shape[1]: Splits(m, levels) for _, m in as_matrix(sample["embedding"])} if sample.num_rows else {}


def build(rows: DataFrame, n: int, shard: int) -> DataFrame:
    """The stored shards of rows(vec_id, embedding): shard, dim, low, high, least, tree."""
    splits, kind = fitted(rows, n, shard), rows.schema["embedding"].dataType.simpleString()
    placed = written(rows.mapInArrow(lambda b: in_cells(b, splits), f"vec_id long, embedding {kind}, dim int, cell int"), "cells")
    parts = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("parts"))
    # rows of a cell are dealt over its parts whatever their ids; the table is written, so numbers of rows stay
    dealt = placed.withColumn("no", F.monotonically_increasing_id()).join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("no"), F.col("parts")).cast("int"))
    shape = "shard long, dim int, low array<double>, high array<double>, least long, tree binary"
    return written(dealt.select("vec_id", "embedding", "dim", "cell", "part").groupBy("dim", "cell", "part").applyInArrow(shard_tree, shape), "shards")


def shuffled(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join of sides that both grow with the input: neither is broadcast, whatever size its files suggest."""
    return left.join(right.hint("merge"), key, how)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors(vec_id, embedding) for each of queries, of the same columns."""
    usable = lambda df: df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long"), "embedding")
    rows, asked = usable(vectors), usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n, m = rows.count(), asked.count()
    shards = build(rows, n, shard)
    blocks, box_blocks = max(1, -(-m // block)), max(1, -(-shards.count() // BOXES))
    asked = asked.select(F.col("vec_id").alias("query_id"), "embedding", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    boxes = shards.select("shard", "dim", "low", "high", "least", F.pmod(F.xxhash64("shard"), F.lit(box_blocks)).cast("int").alias("boxes"))

    def opened(queries: DataFrame, first: bool) -> DataFrame:
        left = queries.withColumn("boxes", F.explode(F.sequence(F.lit(0), F.lit(box_blocks - 1))))
        right = boxes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return left.groupBy("block", "boxes").cogroup(right.groupBy("block", "boxes")).applyInArrow(lambda a, b: open_shards(a, b, first), "query_id long, shard long, bound long")

    def found_in(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """What the queries of pairs(query_id, shard) find in their shards."""
        left = shuffled(pairs, known, "query_id").select("query_id", "embedding", "block", "kth", "kth_id", "shard")
        right = shuffled(shards.select("shard", "tree"), left.select("shard", F.col("block").alias("asks")).distinct(), "shard").select("shard", "tree", F.col("asks").alias("block"))
        return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(lambda a, b: search_shard(a, b, k), FOUND)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    home = opened(asked, True).groupBy("query_id").agg(F.max(F.struct("bound", "shard")).alias("b")).select("query_id", F.col("b.shard").alias("shard"))
    home = written(home, "home-shards")
    found = written(found_in(home, asked.withColumn("kth", F.lit(NONE)).withColumn("kth_id", F.lit(0).cast("long"))), "home-found")
    kth = found.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
    known = shuffled(shuffled(asked, home.withColumnRenamed("shard", "home"), "query_id"), kth, "query_id", "left")
    known = written(known.fillna({"kth": NONE, "kth_id": 0}), "known")
    pairs = written(opened(known, False).select("query_id", "shard"), "open-shards")
    found = found.unionByName(found_in(pairs, known))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
