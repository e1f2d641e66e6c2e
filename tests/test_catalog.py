"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from notalith import catalog

DATA = Path(os.environ.get("NOTALITH_TESTDATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(v):
        return str(v) if isinstance(v, bool | str | type(None)) else f"{float(v):.6f}" if not hasattr(v, "year") else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - {"stream_incremental", "chunk_reuse", "index_health"}))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    found = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), names)
