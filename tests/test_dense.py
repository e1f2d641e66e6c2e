"""Scans by matrix against plain products, and queries that must not make a row for each pair."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from notalith import catalog
from notalith.functions.vectors import quantize
from notalith.operators import dense, ivf

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture
def tables(spark, monkeypatch):
    """Vectors with copies, a null component, another length and no vector at all; shards and blocks of a few rows."""
    monkeypatch.setattr(dense, "SHARD", 40)
    monkeypatch.setattr(dense, "BLOCK", 3)
    rnd = random.Random(5)
    rows = [(i, [rnd.choice((-1.0, -0.5, 0.25, 0.5, 1.0)) for _ in range(4)]) for i in range(150)]
    odd = [(150, [1.0, None, 0.0, 1.0]), (151, [1.0, 2.0]), (152, None)]
    v = spark.createDataFrame(rows + odd, "chunk_id bigint, vec array<float>")
    return rows, odd, v, spark.createDataFrame([(i, rows[i][1]) for i in range(0, 150, 15)], "qid bigint, vec array<float>")


def scores(rows, q):
    return sorted(((-round(sum(a * b for a, b in zip(q, v, strict=True)), 9), i) for i, v in rows))


def test_nearest(spark, tables):
    rows, _, v, q = tables
    for k, floor in ((5, None), (150, None), (20, 0.0)):
        got = {}
        for r in dense.nearest(v, q, k, floor=floor).collect():
            got.setdefault(r.qid, []).append((r.score is None, -(r.score or 0.0), r.chunk_id))
        for qid, found in got.items():
            want = sorted((min(s, -floor), i) if floor is not None else (s, i) for s, i in scores(rows, rows[qid][1]))[:k]
            assert [(s, i) for _, s, i in sorted(found)] == want
        assert len(got) == 10
    assert [(r.chunk_id, r.score) for r in dense.nearest(v, q.limit(1), 200).orderBy("chunk_id").collect()][150:] == [(150, None), (151, None)]
    codes = v.where("chunk_id < 150").select("chunk_id", quantize("vec").alias("vec"))
    plain = {(r.qid, r.chunk_id): round(r.score, 9) for r in dense.exact(codes, q, int8=True).collect()}
    found = {(r.qid, r.chunk_id): r.score for r in dense.nearest(codes, q, 150, int8=True).collect()}
    assert found == pytest.approx(plain)


def test_above_and_spread(spark, tables):
    rows, _, v, q = tables
    marks = spark.createDataFrame([(q_, m) for q_ in range(0, 150, 15) for m in (-0.5, 0.25, 1.0, 1.0)], "qid bigint, score double")
    got = {(r.qid, r.score): r.above for r in dense.above(v, q, marks).collect()}
    assert got == {(i, m): sum(-s > m for s, _ in scores(rows, rows[i][1])) for i in range(0, 150, 15) for m in (-0.5, 0.25, 1.0)}
    spread = {r.qid: (r.n, r.not_positive, r.least) for r in dense.spread(v, q).collect()}
    assert spread == {i: (152, sum(s >= 0 for s, _ in scores(rows, rows[i][1])), -scores(rows, rows[i][1])[-1][0]) for i in range(0, 150, 15)}


def test_probed(spark, tables):
    _, _, v, q = tables
    centroids, assigned = ivf.train(v.where("chunk_id < 150"), k=4, rounds=2)
    every = {(r.qid, r.chunk_id): round(r.score, 9) for r in dense.clustered(assigned, centroids, q, 2, keep_rest=False).collect()}
    assert {(r.qid, r.chunk_id): r.score for r in dense.probed(assigned, centroids, q, 150, 2).collect()} == pytest.approx(every)


def test_means(spark):
    """Sums of members, nulls left out, of vectors in several tasks."""
    rows = [(i, i % 2, [float(i), 1.0 - i]) for i in range(20)] + [(20, 0, [3.0, None])]
    df = spark.createDataFrame(rows, "chunk_id bigint, cluster int, vec array<float>").repartition(3)
    want = {}
    for c in (0, 1):
        v = [sum(x[i] for _, k, x in rows if k == c and x[i] is not None) for i in (0, 1)]
        want[c] = [round(x / sum(y * y for y in v) ** 0.5, 12) for x in v]
    assert {r.cluster: r.vec for r in ivf.means(df).collect()} == want


def test_settings_come_back(spark):
    """Many small notes are packed into a task, and the session's own settings hold after."""
    from notalith.sources.markdown import packed_files

    names = ("spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism")
    was = [spark.conf.get(n) for n in names]
    with packed_files(spark):
        assert int(spark.conf.get(names[0])) < 1 << 20 and int(spark.conf.get(names[1])) < 1000
    assert [spark.conf.get(n) for n in names] == was


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_notes_are_dealt(spark):
    """One small file of parts does not make one task parse all notes."""
    from notalith import catalog_vault

    assert catalog_vault.notes(spark, str(DATA)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


NO_PAIRS = ("knn_exact", "knn_filtered", "knn_batch_best", "knn_semantic_only_negatives", "int8_knn", "redundancy_at_10", "ndcg_mrr_hit_recall", "metrics_by_category", "true_ndcg_recall", "win_tie_loss", "ivf_recall", "ivf_probe_knn")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_rows_of_pairs(spark, monkeypatch, name):
    def refuse(*_, **__):
        raise AssertionError("a row for each pair of query and vector")

    monkeypatch.setattr(dense, "exact", refuse)
    monkeypatch.setattr(dense, "clustered", refuse)
    assert catalog.queries()[name](spark, str(DATA)).count()
