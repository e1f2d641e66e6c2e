"""Language identification, the pipeline, and the registered queries."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from notalith.llm import catalog, langid

DATA = Path("/root/testdata/sf0.001")
SYLLABLES = {"aa": ("the", "ing", "sh"), "bb": ("ung", "ß", "sch"), "cc": ("ción", "ñ", "osa")}


def labelled(spark, n=90):
    r = random.Random(1)
    rows = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        rows.append((i, " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(40)), None if i % 10 == 9 else lang, "x", 0.5))
    rows += [(900, None, "aa", "x", 0.5), (901, "", "bb", "x", 0.5), (902, "123 -- 4", "cc", "x", 0.5), (None, "theing shthe", None, "x", 0.5), (903, "osación " * 20_000, None, "x", 0.5)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string, score double")


def test_windows_cover_texts():
    w, n = langid.as_windows(b"x" * 1000, 192)
    assert w.shape == (6, 192) and n.sum() == 1000 and bytes(w.ravel()[:1000]) == b"x" * 1000
    assert langid.as_windows(b"", 192)[0].shape == (1, 192)


def test_lookups_are_the_convolution():
    net = langid.ByteCNN(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    p = net.probabilities(x, net.lookups())
    e, pooled = net.emb[x], []
    for w, c in zip(langid.WIDTHS, net.conv, strict=True):
        t = x.shape[1] - w + 1
        pooled.append((np.concatenate([e[:, j : j + t] for j in range(w)], axis=2) @ c).max(1))
    z = np.maximum(np.concatenate(pooled, 1) + net.bias, 0) @ net.out + net.out_bias
    q = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(p, q / q.sum(1, keepdims=True), atol=1e-5)


def test_gradients():
    net, r = langid.ByteCNN(["a", "b", "c"]), np.random.default_rng(1)
    for p in range(len(net.params())):
        net.params()[p][...] = net.params()[p].astype(np.float32)
    x, y = r.integers(0, 256, (6, 20)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    _, grads = net.step(x, y)
    for p, g in zip(net.params(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, h = p[at], 1e-2
        p[at] = old + h
        up = net.step(x, y)[0]
        p[at] = old - h
        down = net.step(x, y)[0]
        p[at] = old
        assert (up - down) / (2 * h) == pytest.approx(g[at], rel=0.15, abs=1e-3)


def test_language_id(spark):
    df = labelled(spark)
    net = langid.train(langid.training_part(df), per_lang=30)
    got = {r.doc_id: r for r in langid.identify(df, net, ["doc_id"]).collect()}
    assert len(got) == df.count() and net.classes == ["aa", "bb", "cc"]
    assert all(got[i].lang_pred == langid.UND and got[i].score == 0 for i in (900, 901, 902))
    assert np.mean([got[i].lang_pred == list(SYLLABLES)[i % 3] for i in range(90)]) > 0.95 and got[903].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.train(df.where("lang IS NULL"))
    assert {r.lang_pred for r in langid.identify(df, nothing, ["doc_id"]).collect()} == {langid.UND}
    assert langid.identify(df.limit(0), net, ["doc_id"]).count() == 0


def test_sample_is_bounded_and_has_all_languages(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid.ByteCNN, "fit", lambda self, x, y: seen.append((len(x), len(set(y)))) or self)
    rows = [(7, f"text {'abc'[i % 3]} number {i // 3}", f"l{i % 2}") for i in range(400)] + [(8, "the same row", "l1")] * 200
    langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), per_lang=20)
    assert seen.pop() == (40, 2)
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    many = [(i, f"some words {i}", f"l{i % 9}") for i in range(90)]
    langid.train(spark.createDataFrame(many, "doc_id bigint, text string, lang string"), per_lang=5)
    assert seen.pop() == (10, 9)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_languages_held_out(spark):
    """The registered query: its split, and its accuracy on what it has not learned from."""
    import zlib

    out = __spark_entry__.queries()["op5_language_id"](spark, str(DATA)).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.lang and any(c.isalpha() for c in r.text or "")]
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) > 0.9


def test_pipeline_stages(spark):
    r = random.Random(3)
    base = labelled(spark, 60).drop("lang_pred", "score").withColumns({"source": F.lit("s"), "n_chars": F.char_length("text").cast("bigint"), "row": F.lit(1), "_hits": F.lit("x")})
    extra = [(2000, "theing shing " + " ".join(f"theshing{r.randint(0, 99)}" for _ in range(50)), "aa")]
    words = extra[0][1].split()
    extra += [(2001, " ".join(words), "aa"), (2002, "  ".join(words), "aa"), (2003, " ".join([*words[:-1], "osa"]), "aa"), (2004, " ".join([*words[5:20], "mail me: who.am@i.example.com now and then"]), "aa")]
    df = base.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.char_length("text").cast("bigint"), "row": F.lit(1), "_hits": F.lit("x")}))
    names, out = [n for n, _ in corpus_pipeline.STAGES], df
    assert names == ["language_id", "exact_dedup", "ngram_join", "pii", "packing"]
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "")
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{len(sizes)}-{r.random()}"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == df.columns
        sizes.append({x.doc_id for x in out.select("doc_id").collect()})
    assert not {900, 901, 902} & sizes[0] and {2000, 2001, 2002, 2003, 2004} <= sizes[0]
    assert {2000, 2001, 2002} & sizes[1] == {2002} and 2003 in sizes[1]
    assert {2002, 2003} & sizes[2] == {2002} and 2004 in sizes[2]
    final = {x.doc_id: x for x in out.collect()}
    assert "who.am@i" not in final[2004].text and final[2004].n_chars == len(final[2004].text)
    packed = corpus_pipeline.STAGES[-1][1](spark, out, "").collect()
    assert {x.doc_id for x in packed} == sizes[3]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), "").count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = __spark_entry__.queries()[name](spark, str(DATA))
    found = con.execute(catalog.oracle_sql()[name])
    names = sorted(c[0] for c in found.description)
    rows = {tuple(str(r[names_at]) for names_at in order) for order in [sorted(range(len(names)), key=lambda i: [c[0] for c in found.description][i])] for r in found.fetchall()}
    assert sorted(df.columns) == names and {tuple(str(r[c]) for c in names) for r in df.collect()} == rows


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["op4_sharding", "op6_bpe", "op8_secrets", "op9_pii", "op10_packing", "pipeline"])
def test_query_runs(spark, name):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    rows = __spark_entry__.queries()[name](spark, str(DATA)).count()
    assert rows >= n if name == "op10_packing" else 0 < rows if name == "pipeline" else rows == n
