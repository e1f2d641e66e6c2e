"""Fusion of lanes in shards against ranks over all pairs."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from notalith import catalog
from notalith.functions.text import osa
from notalith.operators import dense, fusion, lanes, lexical

DATA = Path("/root/testdata/sf0.001")


def table(spark, rows, kinds):
    return spark.createDataFrame(rows, kinds)


@pytest.mark.parametrize("rounds, near", [((2, 5), False), ((1,), True), ((24, 256), False)])
def test_fused(spark, monkeypatch, rounds, near):
    """Ties at the ends of lanes, queries without a lane, rounds that leave queries open, and ranks that must be counted."""
    for name, value in (("SHARD", 30), ("BLOCK", 2), ("ROUNDS", rounds), ("RARE", 3)):
        monkeypatch.setattr(lanes, name, value)
    rnd = random.Random(3)
    vecs = [(i, [rnd.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(3)], rnd.randrange(3)) for i in range(110)]
    words = [(i, w, rnd.choice((1.0, 2.0))) for i in range(130) for w in rnd.sample("abcdefgh", rnd.randrange(4))] + [(5, "rare", 3.0)]
    names = [(i, rnd.choice("xyz"), 1.0) for i in range(130)]
    base = [(i, rnd.choice((0.0, 0.001, 0.002))) for i in range(110)]
    qs = [(q, vecs[7 * q][1] if q != 4 else None, [0, 2]) for q in range(6)]
    asked = [(q, w, rnd.choice((0.5, 1.0, 1.5))) for q in range(5) for w in rnd.sample("abcdefgh", 3)] + [(0, "rare", 1.0)]
    close = [(q, w, rnd.choice((1.0, 2.0))) for q in range(6) for w in rnd.sample("xyz", 2)]
    passed = [(q, "x", 0.25) for q in range(3)]
    kinds = "chunk_id bigint, feature string, value double"
    about = "qid int, feature string, weight double"
    given = {"sem": table(spark, vecs, "chunk_id bigint, vec array<float>, cluster int"), "bm25": lanes.Sparse(table(spark, words, kinds), table(spark, asked, about)),
             "fuzzy": lanes.Sparse(table(spark, names, kinds), table(spark, close, about), "max"),
             "graph": lanes.Sparse(table(spark, names[:110], kinds), table(spark, passed, about), "near" if near else "sum", table(spark, base, "chunk_id bigint, value double"))}
    queries = table(spark, qs, "qid int, vec array<float>, clusters array<int>")
    weights = {"graph": 0.5, "bm25": 2.0}

    plain = {n: {} for n in given}
    for q, vec, some in qs:
        for i, v, c in vecs:
            if vec is not None and (not near or c in some):
                plain["sem"][q, i] = sum(a * b for a, b in zip(vec, v, strict=True))
        for i, x in base:
            if not near or (q, i) in plain["sem"]:
                plain["graph"][q, i] = x + sum(w for p, f, w in passed for j, g, _ in names if p == q and j == i and f == g)
    for lane, entries, terms, fold in (("bm25", words, asked, lambda a, b: a + b), ("fuzzy", names, close, max)):
        for q, f, w in terms:
            for i, g, x in entries:
                if f == g:
                    plain[lane][q, i] = fold(plain[lane].get((q, i), 0.0), w * x)
    rows = {n: table(spark, [(q, i, float(s)) for (q, i), s in held.items()], "qid int, chunk_id bigint, score double") for n, held in plain.items()}
    want = {}
    for r in fusion.rrf(fusion.lanes_of(**rows), weights).collect():
        want.setdefault(r.qid, []).append((-round(r.fused, 9), r.chunk_id))
    got, scores = {}, {}
    for r in lanes.fused(queries if near else queries.drop("clusters"), given, 4, weights).collect():
        got.setdefault(r.qid, []).append((-round(r.fused, 9), r.chunk_id))
        scores[r.qid, r.chunk_id] = r.scores
    assert {q: sorted(v)[:4] for q, v in got.items()} == {q: sorted(v)[:4] for q, v in want.items()}
    assert len({(q, i) for q, v in got.items() for _, i in v}) == sum(map(len, got.values()))
    for (q, i), s in scores.items():
        assert s.sem == (pytest.approx(plain["sem"][q, i]) if (q, i) in plain["sem"] else None)
        assert s.bm25 == pytest.approx(plain["bm25"].get((q, i), 0.0)) and s.fuzzy == plain["fuzzy"].get((q, i), 0.0)


def test_alike_is_edit_distance(spark):
    """Words meet by what deletions leave, and none within the limit is lost: swaps, both ends, repeated letters."""
    rnd = random.Random(11)
    words = sorted({"".join(rnd.choice("ab1") for _ in range(rnd.randrange(3, 10))) for _ in range(150)} | {"widget", "wdiget", "widgte", "idget", "wiget", "widgets", "ab", "10", "1010"})
    terms = [w for w in words if len(w) >= 3][::3] + ["widget"]
    owned = spark.createDataFrame([(i, w) for i, w in enumerate(words) if len(w) >= 3], "chunk_id bigint, word string")
    got = {(r.word, r.term): r.like for r in lexical.alike(owned, spark.createDataFrame([(0, t) for t in set(terms)], "qid int, term string")).collect()}
    want = {(w, t): 1 - osa(w, t) / max(len(w), len(t)) for w in words for t in terms if len(w) >= 3 and osa(w, t) <= min(2, len(t) // 3) and osa(w, t) < max(len(w), len(t))}
    assert got == pytest.approx(want)


def test_rows_that_stand_for_many(spark):
    lane = spark.createDataFrame([(0, 1, "a", 1.0, 3), (0, 2, "a", 0.5, 2), (0, 3, "a", 0.5, 4), (0, 4, "a", 0.1, 1), (0, 5, "a", 0.0, 9)], "qid int, chunk_id bigint, lane string, score double, many bigint")
    assert {r.chunk_id: r.fused for r in fusion.rrf(lane, many="many").collect()} == pytest.approx({1: 1 / 61, 2: 1 / 64, 3: 1 / 64, 4: 1 / 70})


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["rrf_two_lanes", "rrf_weighted", "rrf_ties", "hybrid_search"])
def test_no_rows_of_pairs(spark, monkeypatch, name):
    def refuse(*_, **__):
        raise AssertionError("a row for each pair of query and chunk")

    monkeypatch.setattr(dense, "exact", refuse)
    monkeypatch.setattr(lexical, "bm25", refuse)
    assert catalog.queries()[name](spark, str(DATA)).agg(F.count(F.lit(1))).first()[0]
