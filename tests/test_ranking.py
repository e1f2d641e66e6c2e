from __future__ import annotations

from math import log2

import pytest
from pyspark.sql import functions as F

from notalith.operators import fusion, graph, lexical, metrics, summaries
from notalith.schemas import META


def weights(spark, **fields):
    df = spark.createDataFrame([(1, *fields.values())], ["chunk_id", *fields])
    return {r.term: round(r.tf, 6) for r in lexical.postings(df, {n: F.array_join(n, " ") if isinstance(v, list) else F.col(n) for n, v in fields.items()}).collect()}


def test_field_weights(spark):
    got = weights(spark, title=" Project Atlas ", heading_path=["project atlas", "Operations", "recovery runbook"], body="body signal")
    assert got == {"operations": 1.8, "project": 4.8, "atlas": 4.8, "recovery": 1.8, "runbook": 1.8, "body": 1.0, "signal": 1.0}
    got = weights(spark, title="Semantic Search Guide", aliases=["Vector Search"], heading_path=["Semantic"], body="notes")
    assert got["semantic"] == 4.8 and got["vector"] == 3.0 and got["notes"] == 1.0 and got["search"] == 6.0


def bm25(spark, texts, query, eligible=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, text string")
    posted = lexical.postings(docs, {"body": F.col("text")})
    lens = lexical.lengths(posted)
    terms = lexical.query_terms(spark.createDataFrame([(0, query)], "qid int, query string"))
    e = spark.createDataFrame([(i,) for i in eligible], "chunk_id bigint") if eligible is not None else None
    return {r.chunk_id: r.score for r in lexical.bm25(posted, lens, terms, lexical.stats(lens), e).collect()}


def test_bm25(spark):
    rare = bm25(spark, ["common rare", "common word", "common text"], "common rare rare")
    assert rare[0] > rare[1] == rare[2]
    much = bm25(spark, ["hit hit hit hit hit hit hit hit", "hit", "none here"], "hit")
    assert much[0] < 3 * much[1]
    short = bm25(spark, ["term", "term " + "filler " * 30], "term")
    assert short[0] > short[1]
    assert bm25(spark, ["aa bb", "aa cc"], "aa", [1])[1] == bm25(spark, ["aa bb", "aa cc"], "aa")[1]
    assert bm25(spark, ["aa"], "zz") == {}


def test_fuzzy(spark):
    named = spark.createDataFrame([(1, ["Architecture Overview"]), (2, ["User Manual"]), (3, ["x", "Search"])], "chunk_id bigint, names array<string>")
    terms = lexical.query_terms(spark.createDataFrame([(0, "Architecure"), (1, "search"), (2, "serach")], "qid int, query string"))
    got = {(r.qid, r.chunk_id): round(r.score, 4) for r in lexical.fuzzy(named, terms).collect()}
    assert got == {(0, 1): round(2 * (1 - 1 / 12), 4), (1, 3): 2.0, (2, 3): round(2 * (1 - 1 / 6), 4)}


def test_rrf_shares_ranks(spark):
    lanes = spark.createDataFrame([(0, 5, "a", 1.0), (0, 6, "a", 0.9), (0, 5, "b", 0.0), (0, 7, "c", 1.0), (1, 5, "a", 1.0), (1, 6, "a", 1.0)], "qid int, chunk_id bigint, lane string, score double")
    got = {(r.qid, r.chunk_id): r.fused for r in fusion.rrf(lanes).collect()}
    assert got == pytest.approx({(0, 5): 1 / 61, (0, 6): 1 / 62, (0, 7): 1 / 61, (1, 5): 1 / 61, (1, 6): 1 / 61})
    assert {r.chunk_id for r in fusion.rrf(lanes, {"a": 0.0, "c": 2.0}).collect()} == {7}


def test_collapse(spark):
    rows = [(0, i + 1, f, None) for i, f in enumerate(["d1", "d1", "d2", "d1", "d2"])]
    hits = spark.createDataFrame(rows, "qid int, rank int, file string, canonical_ref string")
    assert fusion.collapse(hits, 1).count() == 2 and fusion.collapse(hits, 2).count() == 4
    same = hits.withColumn("canonical_ref", F.lit("one"))
    assert [r["rank"] for r in fusion.collapse(same, 1).collect()] == [1]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("abcd")], "qid string, doc string, rank int")
    qrels = spark.createDataFrame([("q", "a", 3), ("q", "c", 3), ("q", "z", 2)], "qid string, doc string, grade int")
    r = metrics.query_metrics(ranked, qrels, 3).first()
    assert r.ndcg == pytest.approx(4.5 / (3 + 3 / log2(3)), abs=1e-5)
    assert (r.mrr, r.hit, r.recall) == (1.0, 1, 1.0) and r.recall_true == pytest.approx(2 / 3)
    assert metrics.query_metrics(ranked, qrels, 10).first().recall == 1.0
    again = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("xyxy")], "qid string, doc string, rank int")
    assert metrics.redundancy(again, 4).first().redundancy == 0.5 and metrics.redundancy(again, 2).first().redundancy == 0
    a, b = (spark.createDataFrame(list(zip("wxyz", v, strict=True)), "qid string, ndcg double") for v in ([1.0, 0.5, 0.5, 0.1], [0.5, 0.5, 0.5, 0.2]))
    assert tuple(metrics.win_tie_loss(a, b).first()) == (1, 2, 1)
    assert tuple(metrics.percentile(spark.createDataFrame([(float(i),) for i in range(100)], "v double"), "v").first()) == (50.0, 95.0, 99.0)


def docs(spark, rows):
    blank = {"aliases": [], "tags": [], "custom": {}}
    return spark.createDataFrame([(f, t, blank | {"aliases": a}, x) for f, t, a, x in rows], f"file string, title string, meta {META}, text string")


def test_links(spark):
    d = docs(spark, [("n.md", "N", [], "[[Architecture]] and [[System Design#Overview|Design]]\n[guide](./user-guide.md) [web](https://x.org/a.md) [[nowhere]] [[dup]]"), ("arch.md", "Architecture", [], ""), ("sd.md", "x", ["system design"], ""),
                     ("user-guide.md", "u", [], ""), ("p.md", "dup", [], ""), ("q.md", "Dup", [], "")])
    links = graph.extract_links(d)
    got = {(r.target, r.anchor, r.label, r.line) for r in links.collect()}
    assert ("System Design", "Overview", "Design", 1) in got and ("./user-guide.md", None, "guide", 2) in got and len(got) == 5
    status = {r.target: (r.status, r.resolved) for r in graph.resolve_links(links, d).collect()}
    assert status == {"Architecture": ("resolved", "arch.md"), "System Design": ("resolved", "sd.md"), "./user-guide.md": ("resolved", "user-guide.md"), "nowhere": ("broken", None), "dup": ("ambiguous", None)}
    assert graph.resolve_links(links, d, compat=True).where("target = './user-guide.md'").first().status == "broken"


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "", 1), ("b", "c", "", 1), ("c", "d", "", 1)], "src string, dst string, raw string, line int")
    seed = spark.createDataFrame([("a",)], "seed string")
    assert {(r.file, r.distance) for r in graph.related(e, seed, 2, "outgoing").collect()} == {("b", 1), ("c", 2)}
    got = {r.file: r.score for r in graph.expand(e, spark.createDataFrame([(0, "a", 1.0)], "qid int, file string, score double")).collect()}
    assert got == {"b": 0.5, "c": 0.25}
    star = spark.createDataFrame([(f"l{i}", "hub", "", 1) for i in range(3)], e.schema)
    names = spark.createDataFrame([("hub",), ("l0",), ("l1",), ("l2",)], "file string")
    ranks = {r.file: r["rank"] for r in graph.page_rank(star, names, 100, 1e-9).collect()}
    assert ranks["l0"] == pytest.approx(0.152672, abs=1e-5) and ranks["hub"] == pytest.approx(0.541985, abs=1e-5) and sum(ranks.values()) == pytest.approx(1)
    assert graph.page_rank(star, names.limit(1)).first()["rank"] == 1.0
    assert graph.page_rank(star, names.limit(0)).count() == 0


def test_summaries(spark):
    text = "# Deploy guide\nDeploy the service with care and deploy it daily.\nUse tokens for access to the service.\n\nThe weather today is rather nice for a walk. Deploy service again to see the service deploy."
    d = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "Short one here is a sentence.")], "doc_id bigint, text string")
    tags = [r.term for r in summaries.key_phrases(d.where("doc_id = 1")).orderBy("rank").collect()]
    assert tags[0] == "deploy" and "service" in tags and len(tags) == 5
    got = {r.doc_id: r.summary for r in summaries.summaries(d).collect()}
    assert got[4] == "Short one here is a sentence." and got[2] == "" and "Deploy" in got[1] and "weather" not in got[1]


def test_answers(spark):
    q = spark.createDataFrame([(1, "API tokens"), (2, "zebra"), (3, "none")], "qid int, query string")
    hits = spark.createDataFrame([(1, 1, 1.0, "auth.md", "Tokens", "API tokens expire after a day. Something else is said here."), (2, 1, 1.0, "auth.md", "", "Nothing of the kind in this text.")], "qid int, rank int, score double, file string, heading string, snippet string")
    got = {r.qid: r.answer for r in summaries.answers(q, hits).collect()}
    assert got[1] == "Based on your notes:\n\nAPI tokens expire after a day. [auth.md › Tokens]"
    assert got[2].startswith("Relevant excerpts") and "[auth.md]: Nothing" in got[2] and got[3].startswith("No relevant")


def test_terms_are_counted_in_place(spark):
    """Key phrases, summaries and postings take no shuffle: a text is one row."""
    d = spark.createDataFrame([(1, "One line of text here.\nAnother line of text there."), (2, None)], "doc_id bigint, text string")
    posted = lexical.postings(d, {"body": F.col("text")}, "doc_id")
    for df in (summaries.key_phrases(d), summaries.summaries(d), summaries.analyse(d), posted):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.chunk_id, r.term): r.tf for r in posted.where("term = 'text'").collect()} == {(1, "text"): 2.0}


def test_faulty_counts_what_is_repeated(spark):
    posted = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 1.0), ("b", 1, -1.0), ("a", 2, 2.0)], "term string, chunk_id bigint, tf double")
    lens = spark.createDataFrame([(1, 1.0), (3, 1.0)], "chunk_id bigint, len double")
    assert lexical.faulty(posted, lens).first().asDict() == {"wrong_lengths": 2, "not_positive": 1, "without_length": 1, "repeated": 1}
