"""Jaccard self-join of word n-gram sets by PartEnum signatures.

A document's set holds the hashes of its distinct n-word shingles. Sets of sizes s <= t can
only be as similar as asked if t <= s / threshold, so sizes are cut into bands of that ratio
and a set signs for its own band and the next: similar sets sign for a common one. Within a
band similar sets differ in at most k elements. The hash domain is cut into n1 groups, so that
some group has at most k2 differences, and each group into n2 parts, of which similar sets
agree on some n2 - k2; each such subset of parts, with its contents, is a signature. There
are more groups than needed, so agreement is certain on one more than the surplus. A set
therefore leaves out subsets of as many groups as are surplus: those that most other sets are
likely to share, empty ones first and then those whose rarest shingle is frequent in a sample.
All sets leave out in the same order, which contents alone decide, so of the subsets that two
similar sets agree on, neither leaves out the last. The sample has no influence on results.

Signatures travel in sorted blocks. Of the sets of a block that share a signature the first
alone sends it on, one row for each range of signatures, and the others are hung on that first;
in the range's task the firsts of all blocks are hung on the first of them. So a signature that
most sets share comes once a block, and a bucket is a tree of two levels. Pairs of either level
carry the signatures that they share, and by these a block's first hands each of its sets on to
the firsts of just the buckets that the set is in: every set is paired with the firsts of its
own buckets, so with no more sets than it has signatures. A pair is passed over
if the sketches of its sets (a byte for each cell of the domain) differ in more cells than
similar sets differ in elements; what is left is counted exactly. Where a first one and its
partners do not all end in one component, sets of different components are held against each
other in blocks, sketch by sketch. First no more pairs leave a pair of blocks than would join
its components, nearest first, and are counted; then, of the groups that gave any, all pairs that
still lie between components. So no link between components is lost and no group of copies is
expanded into pairs.

Identical sets are one set from the start. Words are maximal runs of other than ASCII white
space, A-Z lowered. Texts of fewer words than n have one shingle; null texts and texts without
words have an empty set, which links with nothing. Texts are read whole, however long. Rows
that repeat a doc_id are rows of their own with the same id; null ids are kept, and are the
component only of sets without other ids. Other columns have no influence; an empty table gives
no rows. Sets are known by 128-bit hashes of their contents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_name, parts_for, release, salted_left_join, small_batches, table, written

#: Documents whose ids may be broadcast to fetch their texts; more are joined by shuffling.
FEW = 200_000
#: Signatures that a task sorts before it sends them, and about as many of a range's.
COMBINE, RANGE = 1 << 19, 1 << 20
#: Pairs of a row, and of a batch that leaves a task.
PAIRS, LEAVING = 1 << 12, 1 << 16
#: Texts in which shingles are counted, about, shingles of one of them at most, texts of a frequent one at least, and frequent ones at most.
SAMPLE, OF_A_SET, FREQUENT, COMMON = 1 << 13, 1 << 12, 3, 1 << 16
#: Sets of a file that has their sketches.
SKETCHES_A_FILE = 10_000
#: Bytes of sketches of a block in which unconnected sets are held against each other.
BLOCK = 1 << 21

NONE_COMMON = (np.empty(0, np.uint64), np.empty(0, np.int64))
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x + _STEP
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < n:
        x = mix(np.array([len(words)], np.uint64))
        for w in h:
            x = mix(x + w)
        return x
    x = mix(h[: len(h) - n + 1])
    for i in range(1, n):
        x = mix(x + h[i : len(h) - n + 1 + i])
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


@lru_cache(maxsize=None)
def bands(percent: int, top: int) -> tuple[tuple[int, int], ...]:
    """(least, largest) size of each band, up to one that holds top."""
    out, low = [], 1
    while not out or out[-1][1] < top:
        high = low * 100 // percent
        out.append((low, high))
        low = high + 1
    return tuple(out)


def band_of(size: int, percent: int) -> int:
    return next(i for i, (_, high) in enumerate(bands(percent, max(size, 1 << 20))) if size <= high)


@lru_cache(maxsize=None)
def shape(high: int, percent: int, wide: bool) -> tuple[int, int, int, int]:
    """(n1, k2, n2, surplus) of the band whose largest size is high; n1 = 0 if only equal sets are similar.

    Sets of at most `high` elements each differ in k = 2 * high * (100 - percent) / (100 + percent)
    elements at most. Few differences are met by one group of k + 2 parts; more by groups with
    one difference each. `wide` takes 2-subsets of 3 parts, which hold more elements, and
    otherwise 1-subsets of 2 parts, which are fewer and of which more are left out.
    """
    k = 2 * high * (100 - percent) // (100 + percent)
    if k == 0:
        return 0, 0, 0, 0
    if k <= 3:
        return 1, k, k + 2, 0
    n1 = -(-(k + 1) // 2)
    surplus = -(-n1 // (10 if wide else 3))
    return n1 + surplus, 1, 3 if wide else 2, surplus


def shared(x: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """In how many sets of the sample each element was found; 0 for those that are not common."""
    known, count = common
    if not len(known):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, count[at], 0)


def left_out(weight: np.ndarray, surplus: int) -> np.ndarray:
    """Which of the subsets (rows: groups) a set leaves out: the heaviest, of no more groups than `surplus`."""
    order = np.argsort(-weight.ravel(), kind="stable")
    order = order[weight.ravel()[order] > 0]
    new = np.zeros(len(order), np.int64)
    new[np.unique(order // weight.shape[1], return_index=True)[1]] = 1
    out = np.zeros(weight.size, bool)
    out[order[np.cumsum(new) <= surplus]] = True
    return out.reshape(weight.shape)


def signatures(x: np.ndarray, percent: int, wide: bool, common: tuple[np.ndarray, np.ndarray] = NONE_COMMON) -> np.ndarray:
    """The distinct signatures of a set for its own band and the next."""
    out = []
    own = band_of(len(x), percent)
    known = bands(percent, 1 << 20)
    known = known if own + 1 < len(known) else bands(percent, 4 * len(x))
    scattered, often = mix(x ^ _M2), shared(x, common)
    for band in (own, own + 1):
        n1, k2, n2, surplus = shape(known[band][1], percent, wide)
        if not n1:
            continue
        cells = n1 * n2
        # x is sorted, so a cell's elements are neighbours
        cell = ((x >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
        ends = np.searchsorted(cell, np.arange(cells + 1))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(scattered, dtype=np.uint64)])
        content = (sums[ends[1:]] - sums[ends[:-1]]).reshape(n1, n2)
        subsets = np.array(list(combinations(range(n2), n2 - k2)))
        held = content[:, subsets].sum(2, dtype=np.uint64)
        keep = np.ones(held.shape, bool)
        if surplus:
            # a subset is shared by no more sets than its rarest element; empty ones by any
            rarest = np.full(cells, np.iinfo(np.int64).max)
            filled = ends[1:] > ends[:-1]
            rarest[filled] = np.minimum.reduceat(often, ends[:-1][filled])
            keep = ~left_out(rarest.reshape(n1, n2)[:, subsets].min(2), surplus)
        label = np.arange(held.size, dtype=np.uint64).reshape(held.shape) + np.uint64((band + 1) << 32)
        out.append(mix(mix(held) + label)[keep])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def cells_of(size: int) -> int:
    """Cells of the sketch of a set: a power of two near its size."""
    return max(64, 1 << max(0, (size * 3 // 4).bit_length()))


def sketch(x: np.ndarray) -> bytes:
    """For each cell of the domain the sum of its elements' hashes, modulo 256."""
    n = cells_of(len(x))
    cell = (x >> np.uint64(64 - (n.bit_length() - 1))).astype(np.int64)
    out = np.zeros(n, np.uint8)
    np.add.at(out, cell, (mix(x ^ _M1) >> np.uint64(7)).astype(np.uint8))
    return out.tobytes()


def folded(cells: np.ndarray, n: int) -> np.ndarray:
    """Sketches (rows of cells) with neighbours summed up to n cells."""
    return cells.reshape(len(cells), n, -1).sum(2, dtype=np.uint8) if cells.shape[1] > n else cells


def most_differences(s, t, percent: int):
    """Elements in which similar sets of sizes s and t differ at most."""
    return (s + t) * (100 - percent) // (100 + percent)


def set_key(x: np.ndarray) -> bytes:
    """The 16 bytes that a set is known by."""
    return xxhash.xxh3_128_digest(x.tobytes(), seed=1)


def binary(keys: np.ndarray) -> pa.Array:
    """Rows of two numbers as an Arrow array of 16 bytes each."""
    ends = np.arange(len(keys) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(keys).tobytes())])


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    inorder = keys[order]
    new = np.concatenate([[True], (inorder[1:] != inorder[:-1]).any(1)])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return inorder[new], place


def hung(s: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(firsts, their signatures and numbers), (first, other) of each run of equal signatures s of sets numbered r.

    The first of a run is the set with the smallest number; pairs come once, with the number of
    signatures that each of them shares, and then these signatures in the order of pairs.
    """
    order = np.lexsort((r, s))
    s, r = s[order], r[order]
    del order
    start = np.concatenate([[True], s[1:] != s[:-1]])
    first = r[np.maximum.accumulate(np.where(start, np.arange(len(s)), 0))]
    # a set that comes from several blocks repeats its signatures
    other = (first != r) & np.concatenate([[True], start[1:] | (r[1:] != r[:-1])])
    pairs, on = first[other].astype(np.uint64) << np.uint64(32) | r[other].astype(np.uint64), s[other]
    order = np.argsort(pairs, kind="stable")
    pairs, count = np.unique(pairs, return_counts=True)
    return s[start], r[start], np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.int64), count, on[order]


def measured(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """doc_id, row_key, n_shingles, set_key, sketch of each row; sets without elements have no key."""
    for b in batches:
        size, keys, cells = [], [], []
        for t in b.column("text"):
            x = shingles(t.as_py(), n)
            size.append(len(x))
            keys.append(set_key(x) if len(x) else None)
            cells.append(sketch(x) if len(x) else None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(cells, pa.binary())], names=["doc_id", "row_key", "n_shingles", "set_key", "sketch"])


def signed(batches: Iterator[pa.RecordBatch], n: int, percent: int, wide: bool, ranges: int, common: tuple[np.ndarray, np.ndarray] = NONE_COMMON) -> Iterator[pa.RecordBatch]:
    """(part, sigs, who, keys, pairs): for each range of signatures those of a block of sets.

    who[i] is the place in keys of the set that signed sigs[i]. Equal sets are taken once a
    block, and of those that share a signature in a block only the first sends it on; the others
    are in pairs with it, in rows of their own that are dealt over all parts: there who has the
    number of signatures that each pair shares, and sigs has these.
    """
    seen: dict[bytes, int] = {}
    sigs: list[np.ndarray] = []
    who: list[np.ndarray] = []
    have = 0

    def flush() -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(seen), np.uint64).reshape(-1, 2)
        inorder, place = ranked(keys)
        s, w, pairs, count, on = hung(np.concatenate(sigs), place[np.concatenate(who)])
        cuts = np.searchsorted((s >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
        rows = []
        for p in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[p], cuts[p + 1]
            used, at = np.unique(w[a:b], return_inverse=True)
            rows.append((int(p), s[a:b].tobytes(), at.astype(np.uint32).tobytes(), inorder[used].tobytes(), b""))
        begin, ends = int(keys[0, 0]), np.concatenate([[0], np.cumsum(count)])
        for i in range(0, len(pairs), PAIRS):
            j = min(i + PAIRS, len(pairs))
            rows.append(((begin + i // PAIRS) % ranges, on[ends[i] : ends[j]].tobytes(), count[i:j].astype(np.uint32).tobytes(), b"", inorder[pairs[i:j]].tobytes()))
        seen.clear()
        sigs.clear()
        who.clear()
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "sigs", "who", "keys", "pairs"])

    for b in batches:
        for t in b.column("text"):
            x = shingles(t.as_py(), n)
            if not len(x) or (key := set_key(x)) in seen:
                continue
            s = signatures(x, percent, wide, common)
            if len(s):
                sigs.append(s)
                who.append(np.full(len(s), len(seen), np.uint32))
                seen[key] = len(seen)
                have += len(s)
            if have >= COMBINE:
                yield flush()
                have = 0
    if have:
        yield flush()


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(top, a, b, sigs): sets b hung on a first one a, within a block, or with top of blocks' firsts on the bucket's, and the signatures that both have."""

    def out(top: bool, pairs: np.ndarray, count: np.ndarray, on: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        for i in range(0, len(pairs), LEAVING):
            p, e = pairs[i : i + LEAVING], ends[i : i + LEAVING + 1]
            sigs = pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), pa.array(on[e[0] : e[-1]].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), top)), binary(p[:, 0]), binary(p[:, 1]), sigs], names=["top", "a", "b", "sigs"])

    sigs, who, keys, have = [], [], [], 0
    for batch in batches:
        for s, w, k, p in zip(*(batch.column(c) for c in ("sigs", "who", "keys", "pairs")), strict=True):
            if len(p.as_buffer()):
                yield from out(False, np.frombuffer(p.as_buffer(), np.uint64).reshape(-1, 2, 2), np.frombuffer(w.as_py(), np.uint32), np.frombuffer(s.as_py(), np.uint64))
            else:
                sigs.append(np.frombuffer(s.as_py(), np.uint64))
                who.append(np.frombuffer(w.as_py(), np.uint32) + np.int64(have))
                keys.append(np.frombuffer(k.as_py(), np.uint64).reshape(-1, 2))
                have += len(keys[-1])
    if sigs:
        inorder, place = ranked(np.concatenate(keys))
        keys.clear()
        _, _, pairs, count, on = hung(np.concatenate(sigs), place[np.concatenate(who)])
        yield from out(True, inorder[pairs], count, on)


def near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, near): whether the sketches leave it open that two sets are similar."""
    for batch in batches:
        ok = []
        for s, t, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")), strict=True):
            if min(s, t) * 100 < max(s, t) * percent:
                ok.append(False)
                continue
            x, y = np.frombuffer(x, np.uint8)[None], np.frombuffer(y, np.uint8)[None]
            n = min(x.shape[1], y.shape[1])
            ok.append(int((folded(x, n) != folded(y, n)).sum()) <= most_differences(s, t, percent))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "near"])


def across(batches: Iterator[pa.RecordBatch], percent: int, forest: bool) -> Iterator[pa.RecordBatch]:
    """(star, a, b) of different components that the sketches leave open, from rows sorted by (star, i, j).

    Rows of a key are the sets of blocks i and j of a star: side 0 is block i, side 1 is block j.
    With forest a pair is passed over if those before it would already join its components, so
    a key gives fewer pairs than it has components, and at least one if any pair is open.
    """
    names = ["star", "i", "j"]

    def compare(rows: pa.Table) -> np.ndarray:
        ids, size, side = (rows[c].to_numpy() for c in ("id", "size", "side"))
        comp = np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
        cells = rows["sketch"].to_pylist()
        n = min(map(len, cells))
        flat = np.concatenate([folded(np.frombuffer(c, np.uint8)[None], n) for c in cells])
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        out = []
        for r in left:
            o = right[(comp[right] != comp[r]) & (ids[right] > ids[r] if right is left else True)]
            o = o[np.minimum(size[o], size[r]) * 100 >= np.maximum(size[o], size[r]) * percent]
            if len(o):
                differ = (flat[o] != flat[r]).sum(1)
                fit = differ <= most_differences(size[o], size[r], percent)
                o, differ = o[fit], differ[fit]
                if forest and len(o):
                    o = o[np.argsort(differ, kind="stable")]
                    joined, nearest = np.unique(comp[o], return_index=True)
                    o = o[nearest]
                    comp[np.isin(comp, joined)] = comp[r]
                out.append(np.stack([np.minimum(ids[o], ids[r]), np.maximum(ids[o], ids[r])], 1))
        return np.concatenate(out) if out else np.empty((0, 2), np.int64)

    def ended(rows: pa.Table) -> pa.RecordBatch | None:
        p = compare(rows)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(p), key[0])), pa.array(p[:, 0]), pa.array(p[:, 1])], names=["star", "a", "b"]) if len(p) else None

    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in names], 1)
        starts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), len(k)]
        for a, b in zip(starts, starts[1:], strict=False):
            if key is not None and tuple(k[a]) != key:
                if (out := ended(pa.Table.from_batches(held))) is not None:
                    yield out
                held = []
            key = tuple(k[a])
            held.append(batch.slice(a, b - a))
    if held and (out := ended(pa.Table.from_batches(held))) is not None:
        yield out


def apart(pairs: DataFrame, comps: DataFrame, distinct: DataFrame, percent: int, forest: bool, parts: int) -> DataFrame:
    """(star, a, b): pairs of across() for the stars of pairs(a, b) whose sets are not in one component."""
    of = lambda df, c: df.join(comps.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    cells = distinct.select(F.col("set_no").alias("b"), "size", F.length("sketch").alias("room"))
    placed = written(of(of(pairs, "a"), "b").join(cells, "b"), "placed", parts)
    open_ = placed.groupBy("a").agg(F.sum("room").alias("room"), F.max(F.col("ca") != F.col("cb")).alias("open"), F.min("cb").alias("lo"), F.max("cb").alias("hi")).where("open AND lo <> hi").select("a", F.ceil(F.col("room") / BLOCK).cast("int").alias("blocks"))
    members = salted_left_join(placed.select("a", F.col("b").alias("id"), F.col("cb").alias("component"), "size"), open_, "a", F.col("id")).where("blocks IS NOT NULL")
    members = members.join(distinct.select(F.col("set_no").alias("id"), "sketch"), "id").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.col("a").alias("star"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "component", "size", "sketch")
    spread = spread.repartition("star", "i", "j").sortWithinPartitions("star", "i", "j")
    return spread.mapInArrow(lambda b: across(b, percent, forest), "star long, a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable by links(a, b), for every id in them.

    Large and small stars in turn: neighbours are hung on the smallest of them until every one
    hangs on a root. Every round is written, so a lost executor costs one round. Edges that fit
    one file are read as one partition, so their rounds need no exchange.
    """
    n = links.count()
    parts = parts_for(2 * n)  # hanging never makes more edges than there were, and each node's own
    kept = lambda df, tag: written(df, tag, parts).coalesce(parts) if parts == 1 else written(df, tag, parts)
    edges = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_left_join(both, low, "u", F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = kept(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung_ = salted_left_join(large, low, "u", F.col("v"))
        small = hung_.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = kept(small, "small-star")
        # settled: nothing hangs on two, and nothing that others hang on hangs itself
        roots = edges.select("v").distinct()
        if edges.count() == edges.select("u").distinct().count() and not roots.join(edges.select(F.col("u").alias("v")), "v", "left_semi").take(1):
            break
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) with linked: whether the sets are similar, counted on their elements."""
    # both tables are read as they lie, so a hot set's rows are split by adaptive execution
    left = pairs.join(sets.select(F.col("set_no").alias("a"), F.col("elements").alias("x")), "a")
    right = left.join(sets.select(F.col("set_no").alias("b"), F.col("elements").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return right.select("a", "b", (100 * common >= percent * (F.size("x") + F.size("y") - common)).alias("linked"))


def counted(rows: DataFrame, distinct: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """checked() for pairs, whose texts are fetched from rows by the key of one row that has the set."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_no")).distinct().join(distinct.select("set_no", "set_key", "row_key"), "set_no")
    wanted = written(wanted, "wanted-sets", parts_for(2 * pairs.count()))
    few = wanted.limit(FEW + 1).count() <= FEW
    texts = rows.join(F.broadcast(wanted) if few else wanted, "row_key").select("set_no", "set_key", "text")
    # rows that repeat a key bring a set twice, and keys may meet: only the set asked for is kept, once
    sets = texts.mapInArrow(lambda b: owned(b, n), "set_no long, elements array<long>").dropDuplicates(["set_no"])
    return checked(pairs, written(sets, "sets"), percent)


def owned(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """set_no and elements of the rows whose text has the set that they are asked for."""
    for b in batches:
        numbers, sets = [], []
        for i, k, t in zip(b.column("set_no").to_pylist(), b.column("set_key").to_pylist(), b.column("text"), strict=True):
            x = shingles(t.as_py(), n)
            if set_key(x) == k:
                numbers.append(i)
                sets.append(x.view(np.int64))
        ends = np.cumsum([0, *map(len, sets)])
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], names=["set_no", "elements"])


def sampled(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The shingles of the distinct sets of a task, of each set the least ones."""
    seen = set()
    for b in batches:
        sets = []
        for t in b.column("text"):
            x = shingles(t.as_py(), n)
            if len(x) and (key := set_key(x)) not in seen:
                seen.add(key)
                sets.append(x[:OF_A_SET])
        if sets:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["x"])


def frequent(rows: DataFrame, n: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of about SAMPLE rows, in order, and their counts there."""
    some = rows.where(F.pmod("row_key", F.lit(max(1, n_docs // SAMPLE))) == 0).select("text")
    counts = some.mapInArrow(lambda b: sampled(b, n), "x long").groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    found = counts.orderBy(F.desc("n"), "x").limit(COMMON).toArrow()
    x = found["x"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(x)
    return x[order], found["n"].to_numpy().astype(np.int64)[order]


def starred(rows: DataFrame, n: int, percent: int, wide: bool, total: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(a, b): every set that shares a signature with others, as b, beside the first of their bucket, by keys; nothing else."""
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // RANGE + 1)
    blocks = rows.select("text").mapInArrow(lambda b: signed(b, n, percent, wide, ranges, common), "part int, sigs binary, who binary, keys binary, pairs binary")
    hung_ = written(blocks.repartitionById(ranges, "part").drop("part").mapInArrow(met, "top boolean, a binary, b binary, sigs array<bigint>"), "met")
    top = hung_.where("top").groupBy("a", "b").agg(F.flatten(F.collect_list("sigs")).alias("sigs"))
    # a signature has one bucket, so a block's first has no more rows above it than signatures
    above = top.groupBy(F.col("b").alias("a")).agg(F.collect_list(F.struct(F.col("a").alias("first"), "sigs")).alias("above"))
    low = hung_.where("NOT top").select("a", "b", "sigs").join(above, "a", "left")
    # what it is itself the bucket's first for stays with it
    over = F.transform(F.filter("above", lambda x: F.arrays_overlap(x["sigs"], F.col("sigs"))), lambda x: x["first"])
    own = F.col("above").isNull() | (F.size(F.array_except("sigs", F.flatten("above.sigs"))) > 0)
    firsts = F.concat(F.when(own, F.array("a")).otherwise(F.array().cast("array<binary>")), F.coalesce(over, F.array().cast("array<binary>")))
    return low.select(F.explode(firsts).alias("a"), "b").unionByName(top.select("a", "b")).distinct()


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80, wide: bool = False) -> DataFrame:
    """doc_id, n_shingles, set_key, component_id of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = written(rows.mapInArrow(lambda b: measured(b, n), f"doc_id {kind}, row_key long, n_shingles long, set_key binary, sketch binary"), "sized")
    distinct = sized.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("row_key"), F.min("n_shingles").alias("size"), F.min("sketch").alias("sketch"))
    n_docs = sized.count()
    distinct = written(distinct.withColumn("set_no", F.monotonically_increasing_id()), "distinct-sets", parts_for(n_docs, SKETCHES_A_FILE))
    sized, whole = written(sized.select("doc_id", "n_shingles", "set_key"), "ids", parts_for(n_docs)), sized
    discard(whole)
    del whole
    total = distinct.agg(F.sum("size")).first()[0] or 0
    release(spark)
    stars = starred(rows, n, percent, wide, total, frequent(rows, n, n_docs))
    # sizes alone leave out many pairs before sketches are fetched for the rest
    known = lambda c, o: distinct.select(F.col("set_key").alias(c), F.col("set_no").alias(o), F.col("size").alias(f"n{o}"))
    fit = F.least("ni", "nj") * 100 >= F.greatest("ni", "nj") * percent
    pairs = written(stars.join(known("a", "i"), "a").join(known("b", "j"), "b").select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("ni").alias("na"), F.col("nj").alias("nb"), fit.alias("fit")), "sized-pairs")
    release(spark)
    pair_parts = parts_for(pairs.count())
    cells = lambda c: distinct.select(F.col("set_no").alias(c), F.col("sketch").alias(f"x{c}"))
    near_pairs = written(pairs.where("fit").drop("fit").join(cells("a"), "a").join(cells("b"), "b").mapInArrow(lambda b: near(b, percent), "a long, b long, near boolean").where("near").select("a", "b"), "near-pairs")
    exact = written(counted(rows, distinct, near_pairs, n, percent), "checked", pair_parts)
    links = exact.where("linked").select("a", "b")
    comps = written(components(links), "components", pair_parts)
    # stars whose sets are not in one component: first what would join them, then all that is left
    tried = exact.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    held = pairs.select("a", "b")
    for forest in (True, False):
        open_ = written(apart(held, comps, distinct, percent, forest, pair_parts), "across", pair_parts)
        if not open_.take(1):
            break
        more = written(open_.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "across-pairs", pair_parts)
        if more.take(1):
            counts = written(counted(rows, distinct, more, n, percent), "checked-across", pair_parts)
            links, tried = links.unionByName(counts.where("linked").select("a", "b")), tried.unionByName(more)
            if counts.where("linked").take(1):
                comps = written(components(links), "all-components", pair_parts)
        release(spark)
        held = held.join(open_.select(F.col("star").alias("a")).distinct(), "a", "left_semi")
    # a component's name is the least doc_id of its sets
    named = distinct.select("set_no", "set_key", "least").join(comps.select(F.col("id").alias("set_no"), "component"), "set_no", "left").withColumn("component", F.coalesce("component", "set_no"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = written(salted_left_join(named.select("set_key", "component"), least, "component", F.col("set_key")).select("set_key", "component_id"), "named", parts_for(n_docs))
    out = salted_left_join(sized, joined, "set_key", F.col("doc_id"))
    return out.select("doc_id", "n_shingles", "set_key", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_similar(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that a document of a smaller id is linked with, through others or not."""
    keep, made_up = F.col("doc_id").eqNullSafe(F.col("component_id")), free_name(docs.columns, "keep")
    joined = ngram_join(docs, n, percent).where(keep).select(F.col("doc_id").alias(made_up)).distinct()
    return docs.join(joined, F.col("doc_id").eqNullSafe(F.col(made_up)), "left_semi")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), n=3, percent=90, wide=True).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90 GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * k >= 90 * (na + nb - k)),
y AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS m FROM documents UNION SELECT y.b, r.m FROM r JOIN y ON r.id = y.a WHERE r.m < y.b)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, (SELECT min(m) FROM r WHERE r.id = s.doc_id) AS component_id FROM s
"""
