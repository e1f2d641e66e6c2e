"""Sums of weights by term within each row, on Arrow arrays of array<struct<term, weight>>; no row leaves its task for that."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def summed(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(row, term, sum of weights, place of the first) of each term of each row, in order of row and term's first place."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    coded = flat.field("term").dictionary_encode()
    rows, codes = np.repeat(np.arange(len(size)), size), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, first, which = np.unique(rows * max(1, len(coded.dictionary)) + codes, return_index=True, return_inverse=True)
    sums = np.bincount(which, flat.field("weight").to_numpy(zero_copy_only=False), len(first))
    order = np.argsort(first)
    first = first[order]
    return rows[first], flat.field("term").take(pa.array(first)), sums[order], first


def best(column: pa.Array, most: int) -> pa.Array:
    """For each row its terms of the largest sums, ties to the first seen, as array<struct<term, score>>."""
    rows, terms, sums, first = summed(column)
    order = np.lexsort((first, -sums, rows))
    rows = rows[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(column)))[rows] < most
    rows, order = rows[keep], order[keep]
    ends = np.searchsorted(rows, np.arange(len(column) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([terms.take(pa.array(order)), pa.array(sums[order])], names=["term", "score"]))
