"""Products of many vectors with many queries as matrices, on Arrow tables (chunk_id, vec) and (qid, vec).

A matrix of products is made tile by tile, in double precision; scores are rounded to nine digits
before they are compared, as everywhere. A vector that is null, holds a null or is of another
length than the query has the score null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Queries and vectors of a tile: 32 MB of products.
HIGH, WIDE = 512, 8192
UNIT = 1e-9


def rounded(s: np.ndarray) -> np.ndarray:
    return np.rint(s * 1e9) / 1e9 + 0.0


def matrices(column: pa.ChunkedArray) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """{length: (places, vectors)} of whole vectors, and the places of the others."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    starts = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
    if flat.null_count:
        holes = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False))
        size[np.searchsorted(starts, holes, side="right") - 1] = -1
    values = flat.to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(size[size >= 0]):
        places = np.flatnonzero(size == n)
        whole = len(places) == len(size)
        out[int(n)] = (places, values.reshape(len(size), n) if whole else values[starts[places][:, None] + np.arange(n)])
    return out, np.flatnonzero(size < 0)


def tiles(vectors: np.ndarray, queries: np.ndarray, int8: bool = False) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first query, first vector, products); all vectors pass by a block of queries before the next."""
    for a in range(0, len(queries), HIGH):
        q = queries[a : a + HIGH].astype(np.float64)
        for c in range(0, len(vectors), WIDE):
            v = vectors[c : c + WIDE].astype(np.float64)
            if int8:
                n = np.sqrt((v * v).sum(1, keepdims=True))
                v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
            with np.errstate(invalid="ignore", over="ignore"):
                yield a, c, q @ v.T


def firsts(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k largest of each query, ties to the smaller place, and each query's kth score (-inf where there are fewer)."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, np.arange(many))[q]
    least = np.full(many, -np.inf)
    last = place == k - 1
    least[q[last]] = s[last]
    keep = place < k
    return q[keep], v[keep], s[keep], least


def best_of(vectors: np.ndarray, queries: np.ndarray, k: int, int8: bool = False, floor: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the k largest; scores that are not finite are all given out."""
    out, odd = [], []
    held = least = None
    for a, c, s in tiles(vectors, queries, int8):
        if c == 0:
            if held is not None:
                out.append((held[0] + first, held[1], held[2]))
            held, first, least = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), a, np.full(len(s), -np.inf)
        strange = ~np.isfinite(s) if not np.isfinite(s.sum()) else None
        if strange is not None and strange.any():
            x, y = np.nonzero(strange)
            odd.append((x + a, y + c, s[x, y]))
            s = np.where(strange, -np.inf, s)
        if floor is not None:
            s = np.where(s == -np.inf, s, np.maximum(s, floor)) if strange is not None else np.maximum(s, floor)
        if c == 0 and s.shape[1] > k:
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        x, y = np.nonzero((s >= (least - UNIT)[:, None]) & (s > -np.inf) if strange is not None else s >= (least - UNIT)[:, None])
        if len(x):
            *held, least = firsts(np.concatenate([held[0], x]), np.concatenate([held[1], y + c]), np.concatenate([held[2], rounded(s[x, y])]), k, len(s))
    if held is not None:
        out.append((held[0] + first, held[1], held[2]))
    return tuple(np.concatenate([p[i] for p in (*out, *odd)]) if out or odd else np.zeros(0, float if i == 2 else np.int64) for i in range(3))


def best(left: pa.Table, right: pa.Table, k: int, int8: bool = False, floor: float | None = None) -> pa.Table:
    """(qid, chunk_id, score): each query's k largest of left, which is in order of id; null scores come last."""
    (have, holes), (asked, lost) = matrices(left["vec"]), matrices(right["vec"])
    q, v, s, empty = [], [], [], []
    for n, (at, m) in asked.items():
        places, vectors = have.get(n, (np.zeros(0, np.int64), np.zeros((0, n))))
        x, y, z = best_of(vectors, m, k, int8, floor)
        q, v, s = [*q, at[x]], [*v, places[y]], [*s, z]
        others = np.sort(np.concatenate([holes, *[p for d, (p, _) in have.items() if d != n]]))[:k]
        empty.append((at, others))
    empty.append((lost, np.arange(left.num_rows)[:k]))
    for at, others in empty:
        q, v = [*q, np.repeat(at, len(others))], [*v, np.tile(others, len(at))]
        s.append(np.full(len(at) * len(others), np.nan))
    none = sum(len(at) * len(others) for at, others in empty)
    q, v, s = np.concatenate(q).astype(np.int64), np.concatenate(v).astype(np.int64), np.concatenate(s)
    mask = np.zeros(len(s), bool)
    mask[len(s) - none :] = True
    return pa.table({"qid": right["qid"].take(pa.array(q)), "chunk_id": left["chunk_id"].take(pa.array(v)), "score": pa.array(s, pa.float64(), mask=mask)})


def nearest(vectors: pa.Array, centroids: pa.ChunkedArray) -> np.ndarray:
    """The place of each vector's best centroid, the first of equals; 0 where there is no product."""
    out = np.zeros(len(vectors), np.int64)
    have, asked = matrices(pa.chunked_array([vectors]))[0], matrices(centroids)[0]
    for n, (at, m) in have.items():
        if n in asked:
            for a, _, s in tiles(asked[n][1], m):  # one tile wide: there are few centroids
                out[at[a : a + len(s)]] = asked[n][0][np.argmax(rounded(s), axis=1)]
    return out


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, vec): the sums of all vectors of a cluster and length; those that hold a null go on as they are."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        cluster, vec = b.column("cluster").to_numpy(zero_copy_only=False), b.column("vec")
        have, holes = matrices(pa.chunked_array([vec]))
        for n, (at, m) in have.items():
            names, which = np.unique(cluster[at], return_inverse=True)
            added = np.zeros((len(names), n))
            order = np.argsort(which, kind="stable")
            if n and len(order):
                added = np.add.reduceat(m[order].astype(np.float64), np.searchsorted(which[order], np.arange(len(names))), axis=0)
            for c, v in zip(names.tolist(), added, strict=True):
                held[c, n] = held[c, n] + v if (c, n) in held else v
        if len(holes):
            yield pa.RecordBatch.from_arrays([pa.array(cluster[holes], pa.int32()), vec.take(pa.array(holes)).cast(pa.list_(pa.float64()))], names=["cluster", "vec"])
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["cluster", "vec"])


def above(left: pa.Table, right: pa.Table) -> pa.Table:
    """(qid, score, above) for right(qid, vec, marks), marks ascending: the vectors of a larger score than each mark."""
    have, (asked, lost) = matrices(left["vec"])[0], matrices(right["vec"])
    marks = [np.asarray(m, float) for m in right["marks"].to_pylist()]
    count = [np.zeros(len(m), np.int64) for m in marks]
    low = np.array([m[0] if len(m) else np.inf for m in marks])
    for n, (at, m) in asked.items():
        if n not in have:
            continue
        for a, _, s in tiles(have[n][1], m):
            s = np.where(np.isnan(s), np.inf, s) if np.isnan(s.sum()) else s
            mine = at[a : a + len(s)]
            x, y = np.nonzero(s > (low[mine] - UNIT)[:, None])
            z, ends = rounded(s[x, y]), np.searchsorted(x, np.arange(len(s) + 1))
            for i in np.flatnonzero(ends[1:] > ends[:-1]):
                j = mine[i]
                below = np.searchsorted(marks[j], z[ends[i] : ends[i + 1]], side="left")  # marks that a score is larger than
                count[j] += np.bincount(below, minlength=len(marks[j]) + 1)[::-1].cumsum()[::-1][1:]
    each = np.repeat(np.arange(len(marks)), [len(m) for m in marks])
    flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return pa.table({"qid": right["qid"].take(pa.array(each)), "score": pa.array(flat(marks, float)), "above": pa.array(flat(count, np.int64))})


def spread(left: pa.Table, right: pa.Table) -> pa.Table:
    """(qid, n, not_positive, least): all vectors, those of a score not above 0, and the least score."""
    have, (asked, _) = matrices(left["vec"])[0], matrices(right["vec"])
    low, least = np.zeros(right.num_rows, np.int64), np.full(right.num_rows, np.nan)
    for n, (at, m) in asked.items():
        for a, _, s in tiles(have.get(n, (None, np.zeros((0, n))))[1], m):
            mine = at[a : a + len(s)]
            low[mine] += (s < UNIT / 2).sum(1)
            least[mine] = np.fmin(least[mine], np.fmin.reduce(s, axis=1))
    scored = np.zeros(right.num_rows, bool)
    for n, (at, _) in asked.items():
        scored[at] = n in have
    return pa.table({"qid": right["qid"], "n": pa.array(np.full(right.num_rows, left.num_rows, np.int64)), "not_positive": pa.array(low), "least": pa.array(rounded(least), pa.float64(), mask=~scored)})
