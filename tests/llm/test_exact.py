"""Operators whose results are exact: against SQL or plain versions, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notalith.llm import bpe, dedup, ngram_join, packing, pii, secrets, sharding, topk, warc
from notalith.llm.common import new_path

DOCS = "doc_id bigint, text string, kept string, _sha string, score double, row struct<a: int>"


def docs(spark, rows):
    """Rows of (doc_id, text) with columns of names that operators use themselves."""
    return spark.createDataFrame([(i, t, "k", "s", 1.0, (1,)) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (None, "one two"), (6, "word " * 30_000), (7, "é😀 漢字 ß"), (None, None)]


# exact dedup


def test_dedup_keeps_longest_then_smallest(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, "ab"), (4, "a\tb\n"), (5, "c"), (6, None), (7, "  ")]
    got = {r.doc_id: r for r in dedup.exact_dedup(docs(spark, rows)).collect()}
    assert [got[i].keep_id for i in range(1, 8)] == [2, 2, 2, 2, 5, 7, 7]
    assert [got[i].group_size for i in (1, 5, 6)] == [4, 1, 2]
    assert got[1].text_sha256 == hashlib.sha256(b"ab").hexdigest() and got[6].text_sha256 == hashlib.sha256(b"").hexdigest()


def test_dedup_odd_rows(spark):
    got = dedup.exact_dedup(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    kept = dedup.drop_copies(docs(spark, ODD)).collect()
    assert len(kept) == len({r.text_sha256 for r in got}) and kept[0].kept == "k"
    assert dedup.exact_dedup(docs(spark, [])).count() == 0


def test_dedup_index_grows(spark):
    index = dedup.DigestIndex(spark)
    first = dedup.exact_dedup(docs(spark, [(1, "a"), (2, "b")]), index)
    assert first.where("kept").count() == 2
    second = {r.doc_id: (r.keep_id, r.kept) for r in dedup.exact_dedup(docs(spark, [(3, "a "), (4, "c"), (5, "c")]), index).collect()}
    assert second == {3: (1, False), 4: (4, True), 5: (4, False)}
    assert index.rows().count() == 3
    index.drop()


def test_dedup_batch_can_be_repeated(spark):
    index, rows = dedup.DigestIndex(spark), docs(spark, [(1, "a"), (2, "b"), (3, " b"), (4, "c d e")])
    once = sorted(map(tuple, dedup.exact_dedup(rows, index, "monday").select("doc_id", "keep_id", "kept").collect()))
    assert sorted(map(tuple, dedup.exact_dedup(rows, index, "monday").select("doc_id", "keep_id", "kept").collect())) == once
    assert index.rows().count() == 3 and once == [(1, 1, True), (2, 3, False), (3, 3, True), (4, 4, True)]
    assert dedup.exact_dedup(rows, index, "tuesday").where("kept").count() == 0
    index.drop()


def test_dedup_index_is_read_as_it_lies(spark):
    index = dedup.DigestIndex(spark)
    index.add(dedup.winners(dedup.digests(docs(spark, [(i, f"t{i}") for i in range(40)]))), "a")
    best = dedup.winners(dedup.digests(docs(spark, [(i, f"t{i}") for i in range(30, 60)])))
    new = index.fresh(best, "b")
    plan = new._jdf.queryExecution().executedPlan().toString()
    join = plan.index("SortMergeJoin")
    assert "LeftAnti" in plan[join : plan.index("\n", join)] and new.count() == 20
    scan = plan.index(f"Scan parquet spark_catalog.default.{index.name}")
    assert "Exchange" in plan[join:scan]  # the batch's side
    assert "Exchange" not in plan[plan.rindex("+- Sort", 0, scan) : scan] and "Bucketed: true" in plan[scan:]
    index.drop()


def test_dedup_drops_rows_not_names(spark):
    rows = [(2, "ab", "x"), (2, "a  b", "y"), (5, "one", "z"), (5, "one", "z"), (None, "n m", "u"), (None, None, "v"), (None, "", "v")]
    df = spark.createDataFrame([(i, t, c, c, c) for i, t, c in rows], "doc_id bigint, text string, _sha string, sha string, mark string")
    out = sorted(((r.doc_id, r.text or "", r._sha, r.sha, r.mark) for r in dedup.drop_copies(df).collect()), key=str)
    assert out == sorted([(2, "a  b", "y", "y", "y"), (5, "one", "z", "z", "z"), (None, "n m", "u", "u", "u"), (None, "", "v", "v", "v")], key=str)


# sharding


def test_walk_moves_overflow_clockwise():
    plan = sharding.walk([5, 1, 0], [0, 1, 2], 3)
    assert sorted(plan) == [(0, 0, 2, 0, 0), (0, 2, 3, 1, 1), (0, 3, 5, 2, 0), (1, 0, 1, 1, 0)]
    r = random.Random(4)
    for _ in range(50):
        shards = r.randint(1, 9)
        counts = [r.choice([0, 0, 3, 50]) for _ in range(30)]
        plan = sharding.walk(counts, r.sample([i % shards for i in range(30)], 30), shards)
        load = Counter()
        for _, lo, hi, s, slot in sorted(plan, key=lambda p: (p[3], p[4])):
            assert slot == load[s]
            load[s] += hi - lo
        assert sum(load.values()) == sum(counts) and max(load.values(), default=0) - min((load[s] for s in range(shards)), default=0) <= 1
        assert sorted((a, x) for a, lo, hi, _, _ in plan for x in range(lo, hi)) == [(a, x) for a, c in enumerate(counts) for x in range(c)]


def test_sharding_rows(spark):
    got = sharding.shard_rows(docs(spark, ODD * 9), 7).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 90 and all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(len(slots[s]) for s in range(7)) <= 1
    one = next(r for r in got if r.doc_id == 7)
    raw = "é😀 漢字 ß".encode()
    assert (one.size, one.text_crc32, one.law, one.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    assert sharding.shard_rows(docs(spark, []), 7).count() == 0


def test_ring_is_stable():
    few, many = dict(sharding.ring(5)), dict(sharding.ring(6))
    assert all(many[p] in (s, 5) for p, s in few.items() if p in many)


# WARC


def test_warc_round_trip(spark):
    rows = [(1, "http://a/1\r\nX: y", "<p>é</p>", "x"), (2, None, "<p>é</p>", "x"), (3, "u", None, "x"), (4, "u", "", "x"), (9, "u", "WARC/1.1\r\n\r\n\r\n\r\nbody", "x"), (None, "u", "<p>é</p>", "x"), (5, "u", "q" * 300_000, "x"), (5, "u", "q" * 300_000, "x")]
    path = new_path(spark, "warc-test")
    warc.write_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string"), path)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.pages_back(spark, path).collect()), key=str)
    assert got == sorted([(1, 9, "revisit", 2), (2, 9, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (9, len(b"WARC/1.1\r\n\r\n\r\n\r\nbody"), "response", None), (None, 9, "revisit", 2), (5, 300_000, "response", None), (5, 300_000, "response", None)], key=str)
    full = {r.record_id: r for r in warc.read_warc(spark, path).collect()}
    assert bytes(full["<urn:x-page:9>"].payload) == b"WARC/1.1\r\n\r\n\r\n\r\nbody" and "%0D%0A" in full["<urn:x-page:1>"].target_uri
    assert full["<urn:x-page:1>"].headers["WARC-Profile"] == warc.PROFILE
    import base64

    assert full["<urn:x-page:2>"].payload_digest == "sha1:" + base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()


def test_warc_pushes_down(spark):
    path = new_path(spark, "warc-test")
    warc.write_pages(spark.createDataFrame([(i, f"http://h{i % 3}/", f"p{i % 5}") for i in range(50)], "page_id bigint, url string, html string"), path, 1)
    df = warc.read_warc(spark, path, ["record_id", "warc_type", "target_uri"]).where("warc_type = 'response' AND target_uri LIKE 'http://h1%'")
    assert "Filter (" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == sum(i % 3 == 1 for i in range(45, 50))
    assert warc.read_warc(spark, path, ["content_length"]).where("content_length > 0").count() == 50


def test_warc_foreign_files(spark, tmp_path):
    block = warc.record({"record_id": "<urn:x-page:1>", "warc_type": "response", "payload": b"abc", "payload_length": 3})
    import gzip

    (tmp_path / "a.warc").write_bytes(block * 2)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(block) + gzip.compress(block.replace(b"abc", b"xyz")))
    got = [bytes(r.payload) for r in warc.read_warc(spark, f"file://{tmp_path}").collect()]
    assert sorted(got) == [b"abc", b"abc", b"abc", b"xyz"]
    path = new_path(spark, "warc-none")
    warc.write_pages(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.pages_back(spark, path).count() == 0


def test_warc_cut_files_and_other_cases(tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField("warc_type", StringType()), StructField("payload", StringType())])

    def read(data, name, skip=False, columns=schema):
        (tmp_path / name).write_bytes(data)
        reader = warc.WarcReader(f"file://{tmp_path}/{name}", columns, 1 << 20, skip)
        return [(r["warc_type"], r.get("payload")) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]

    one = warc.record({"warc_type": "response", "payload": b"abc" * 900})
    payload = b"abc" * 900
    lower = one.replace(b"Content-Length: 2", b"content-LENGTH: 2").replace(b"WARC-Type", b"warc-type")
    assert lower != one and read(lower + one, "a.warc") == [("response", payload)] * 2
    for whole, name in ((one, "b.warc"), (warc.member(one), "c.warc.gz")):
        for cut in (5, 40, len(whole) // 2, len(whole) - 30):
            for columns in (schema, schema[:1]):
                with pytest.raises(warc.BadRecord):
                    read(whole + whole[:cut], name, columns=columns)
                assert read(whole + whole[:cut], name, True)[:1] == [("response", payload)]
    assert read(one[:-4], "d.warc") == [("response", payload)]
    with pytest.raises(warc.BadRecord):
        read(one.replace(b"Content-Length: 2", b"X-Length: 2", 1), "e.warc")


# n-gram join


def plain_join(rows, n, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[root(i)].append(d)
    return Counter((d, len(sets[i]), min((x for x in groups[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "percent", "wide"), [(3, 90, True), (5, 80, False), (5, 80, True), (2, 60, False)])
def test_ngram_join_is_exact(spark, n, percent, wide):
    r = random.Random(n * percent)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(12):
        base = [r.choice(words) for _ in range(r.choice([2, 4, 8, 15, 40, 120, 300]))]
        for _ in range(r.choice([1, 3, 12])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, len(t) // 30, len(t) // 12])):
                at = r.randrange(len(t))
                t[at : at + r.choice([0, 1])] = [r.choice(words).upper()]
            rows.append((len(rows) * 3 % 997, r.choice([" ", "\n", " \t"]).join(t)))
    rows += [(2000, "A b C d e f g"), (2001, "a B c D E F G"), (2002, None), (2003, ""), (2004, " "), (2005, "a"), (2006, "A\n"), (None, "a b c d e f g"), (2000, "A b C d e f g")]
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.ngram_join(docs(spark, rows), n, percent, wide).collect())
    assert got == plain_join(rows, n, percent)


@pytest.mark.parametrize(("percent", "wide"), [(90, True), (80, False), (80, True), (95, True), (50, False)])
def test_similar_sets_share_a_signature(percent, wide):
    r = np.random.default_rng(percent)
    for size in [2, 3, 5, 9, 10, 11, 19, 20, 21, 40, 41, 77, 150, 400, 1500]:
        for _ in range(20):
            x = np.unique(ngram_join.mix(r.integers(0, 1 << 62, size).astype(np.uint64)))
            drop = int(r.integers(0, size // 4 + 1))
            add = int(r.integers(0, size // 4 + 1))
            y = np.unique(np.concatenate([x[drop:] if r.random() < 0.5 else r.permutation(x)[drop:], ngram_join.mix(r.integers(0, 1 << 62, add).astype(np.uint64))]))
            both = len(np.intersect1d(x, y))
            if len(y) and 100 * both >= percent * (len(x) + len(y) - both) and not np.array_equal(x, y):
                assert np.intersect1d(ngram_join.signatures(x, percent, wide), ngram_join.signatures(y, percent, wide)).size
                a, b = (np.frombuffer(ngram_join.sketch(s), np.uint8)[None] for s in (x, y))
                n = min(a.shape[1], b.shape[1])
                assert (ngram_join.folded(a, n) != ngram_join.folded(b, n)).sum() <= ngram_join.most_differences(len(x), len(y), percent)


def test_sets_of_a_bucket_meet_whatever_their_blocks(monkeypatch):
    r = random.Random(8)
    texts = [" ".join(r.choice("ab") + str(i) for i in range(9)) for _ in range(200)]
    whole = {ngram_join.set_key(x): set(ngram_join.signatures(x, 80, False).tolist()) for x in (ngram_join.shingles(t, 1) for t in texts)}
    monkeypatch.setattr(ngram_join, "COMBINE", 200)
    sent = [row for b in ngram_join.signed(iter([pa.RecordBatch.from_pydict({"text": texts})]), 1, 80, False, 3) for row in b.to_pylist()]
    assert max(Counter(row["part"] for row in sent).values()) > 3
    pairs = [pair for part in range(3) for b in ngram_join.met(iter([pa.RecordBatch.from_pylist([row for row in sent if row["part"] == part])])) for pair in b.to_pylist()]
    assert {pair["top"] for pair in pairs} == {True, False}
    above, stars = defaultdict(set), defaultdict(set)
    for pair in pairs:
        stars[pair["a"]] |= {pair["a"], pair["b"]}
        if pair["top"]:
            above[pair["b"]].add(pair["a"])
    for pair in pairs:
        for first in above[pair["a"]] if not pair["top"] else ():  # as starred() does by a join
            stars[first].add(pair["b"])
    for x, s in whole.items():
        assert all(any({x, y} <= star for star in stars.values()) for y, t in whole.items() if x != y and s & t)


def test_unconnected_sets_leave_a_block_as_a_forest():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 100, np.uint64)
    sets = [np.sort(np.concatenate([base[: 100 - i % 5], rng.integers(0, 1 << 63, i % 5, np.uint64)])) for i in range(60)]
    sets += [np.sort(rng.integers(0, 1 << 63, 100, np.uint64)) for _ in range(5)]  # these are near nothing
    rows = pa.table({"star": [1] * 65, "i": [0] * 65, "j": [0] * 65, "side": [0] * 65, "id": range(65), "component": range(65), "size": [100] * 65, "sketch": [ngram_join.sketch(x) for x in sets]})
    whole = [(a, b) for t in ngram_join.across(iter(rows.to_batches()), 80, False) for a, b in zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True)]
    forest = [(a, b) for t in ngram_join.across(iter(rows.to_batches()), 80, True) for a, b in zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True)]
    assert sorted(whole) == [(a, b) for a in range(60) for b in range(a + 1, 60)]
    assert set(forest) <= set(whole) and len(forest) == 59
    root = list(range(65))
    for a, b in forest:
        root = [root[a] if r == root[b] else r for r in root]
    assert len(set(root[:60])) == 1


def test_ngram_join_leaves_out_what_most_sets_share():
    r = np.random.default_rng(11)
    new = lambda n: ngram_join.mix(r.integers(0, 1 << 62, n).astype(np.uint64))
    license_ = np.sort(new(12))
    common = license_, np.full(12, 500)
    for percent, wide in ((80, False), (90, True)):
        # few of the strangers that share a passage meet in a bucket
        seen = Counter(s for _ in range(300) for s in ngram_join.signatures(np.unique(np.concatenate([license_, new(300)])), percent, wide, common).tolist())
        assert max(seen.values()) <= 15 and sum(v for v in seen.values() if v > 1) < 300
        # similar sets still do, whatever the sample holds of them
        for size in (40, 90, 150, 400, 1500):
            for _ in range(30):
                x = np.unique(new(size))
                drop = r.integers(0, size * (100 - percent) // 100 + 1)
                y = np.sort(x[drop:] if r.random() < 0.5 else r.permutation(x)[drop:])
                some = np.sort(r.permutation(x)[: r.integers(0, size + 1)])
                known = some, r.integers(3, 9, len(some))
                if 100 * len(y) >= percent * len(x):
                    assert np.intersect1d(ngram_join.signatures(x, percent, wide, known), ngram_join.signatures(y, percent, wide, known)).size


def test_ngram_join_finds_frequent_shingles(spark):
    rows = docs(spark, [(i, f"own{i}a own{i}b the common line") for i in range(40)] + [(99, None)]).withColumn("row_key", F.col("doc_id"))
    x, count = ngram_join.frequent(rows, 3, 41)
    assert x.tolist() == ngram_join.shingles("the common line", 3).tolist() and count.tolist() == [40]
    none = ngram_join.frequent(rows.limit(0), 3, 0)
    assert len(none[0]) == len(none[1]) == 0


def test_ngram_join_is_exact_across_tasks(spark):
    r = random.Random(4)
    rows = []
    for g in range(6):
        base = [f"t{g}w{i}" for i in range(10)]
        for _ in range(40):
            t = list(base)
            for at in r.sample(range(10), r.choice([3, 4, 5])):
                t[at] = f"x{r.randrange(6)}"
            rows.append((len(rows), " ".join(t)))
    r.shuffle(rows)
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.ngram_join(docs(spark, rows).repartition(12), 1, 80).collect())
    assert got == plain_join(rows, 1, 80)


def test_sets_are_paired_with_the_firsts_of_their_own_buckets_alone(spark):
    r = random.Random(5)
    passages = [[f"p{g}w{i}" for i in range(12)] for g in range(5)]
    rows = [(i, " ".join([w for p in r.sample(passages, 3) for w in p] + [f"x{r.randrange(30)}" for _ in range(r.randrange(4))])) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(60)]
    buckets = defaultdict(set)
    for x in {ngram_join.set_key(x): x for x in (ngram_join.shingles(t, 1) for _, t in rows)}.values():
        for s in ngram_join.signatures(x, 80, False).tolist():
            buckets[s].add(ngram_join.set_key(x))
    order = lambda key: tuple(np.frombuffer(key, np.uint64).tolist())
    exact = {(min(b, key=order), key) for b in buckets.values() for key in b if key != min(b, key=order)}
    found = ngram_join.starred(docs(spark, rows).repartition(12), 1, 80, False, 1, ngram_join.NONE_COMMON).collect()
    assert Counter((bytes(p.a), bytes(p.b)) for p in found) == Counter(exact)


def test_ngram_join_drops(spark):
    rows = [(3, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "x y z"), (4, None), (5, None)]
    kept = ngram_join.drop_similar(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5] and kept.columns[2:] == ["kept", "_sha", "score", "row"]
    assert ngram_join.ngram_join(docs(spark, [])).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 100), (7, 7)]
    got = {r.id: r.component for r in ngram_join.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 100: 50}


# BPE


def test_bpe_is_the_libraries(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), bpe.WordCoder(bpe.load_spec(path))
    r = random.Random(2)
    signs = "aàÀbcdeéß ΑΣσ 1٣²½ \t\n​!?'s\"#$漢字かпр😀ﬁİǅ"
    texts = ["", "the quick brown fox", "a" * 20_000, "ab" * 3000 + "the" * 2000, "it's 42% <|endoftext|><|startoftext|>x"] + ["".join(r.choice(signs) if r.random() < 0.9 else r.choice(["the", "ing", "<|endoftext|>"]) for _ in range(r.randint(0, 90))) for _ in range(1500)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        n, ids, decoded = mine.encode(t)
        assert (n, ids, decoded) == (len(e.ids), " ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False))
        assert mine.decode(e.ids) == decoded
    out = {r.doc_id: r for r in bpe.encode_table(docs(spark, ODD[:9]), path).collect()}
    assert out[1].n_tokens == out[2].n_tokens == 0 and out[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and out[6].n_tokens == 30_000
    assert bpe.encode_table(docs(spark, []), path).count() == 0


# top k


def plain_top(rows, queries, k):
    ok = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in ok:
        if q in queries:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_top_k_is_exact(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(300)] + [(300 + i, [0.5] * 6) for i in range(60)] + [(400, None), (401, [1.0, None] * 3), (402, [float("nan")] * 6), (403, [1.0] * 4), (404, [2.0] * 4), (405, []), (406, [1e7, -1e7] * 3)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, shard string, block int")
    for shard, block in ((4096, 1024), (50, 7)):
        got = {tuple(x) for x in topk.top_k(df, df.where("vec_id % 20 = 0 OR vec_id IN (403, 406)"), 9, shard, block).collect()}
        assert got == plain_top(rows, {*range(0, 400, 20), 400, 403, 406}, 9)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_sends_no_pairs_through_the_driver(spark):
    # every query goes to every shard: in files such pairs are a few bytes, in the driver they are not
    r = np.random.default_rng(7)
    df = spark.createDataFrame([(i, [float(x) for x in r.normal(size=8)]) for i in range(400)], "vec_id bigint, embedding array<float>")
    got = topk.top_k(df, df.where("vec_id % 2 = 0"), 5, 20, 50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan
    assert got.count() == 200 * 5


def test_top_k_bounds_are_tight():
    r = np.random.default_rng(6)
    p = r.integers(-64, 64, (500, 8)).astype(float)
    tree = topk.KDTree(p, np.arange(500), 16)
    for node, (lo, hi) in enumerate(tree.nodes):
        inside = tree.points[lo:hi]
        assert (inside.min(0) == tree.box_lo[node]).all() and (inside.max(0) == tree.box_hi[node]).all()
    q = p[:20]
    score, ids = topk.search(tree, q, np.arange(20), np.full(20, topk.NONE), np.zeros(20, np.int64), 5)
    best = np.sort(q @ p.T - np.where(np.arange(500)[None] == np.arange(20)[:, None], 1e9, 0), axis=1)[:, ::-1][:, :5]
    assert (score == best).all()


# secrets


def plain_windows(value):
    """(name, largest entropy of 20 characters that touch no sample), by counting every window anew."""
    import math
    import re

    if re.fullmatch("[0-9A-Fa-f]+", value):
        name, value = "entropy_hex", value.lower()
    elif re.fullmatch("[0-9A-Z]+|[0-9a-z]+", value):
        name, value = "entropy_base36", value.lower()
    else:
        name = "entropy_base64"
    taken = set()
    for p in ("example", "dummy", "placeholder", "xxxx", "abcdefgh", "12345678"):
        for i in range(len(value)):
            if value[i : i + len(p)].lower() == p:
                taken |= set(range(i, i + len(p)))
    for i in range(len(value) - 7):
        if len(set(value[i : i + 8])) == 1:
            taken |= set(range(i, i + 8))
    free = [value[j : j + 20] for j in range(len(value) - 19) if not taken & set(range(j, j + 20))]
    return name, max((-sum(c / 20 * math.log2(c / 20) for c in Counter(w).values()) for w in free), default=0.0)


def plain_spans(text):
    """What the contract and the module's docstring say, with patterns of its own."""
    import re

    text, base, extra = text or "", [], []
    for m in re.finditer(r"((?:(?i:password|passwd|secret|token|apikey|api_key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            base.append((m.start(), 0, m.end(), "assign", m[2]))
    base += [(m.start(), 1, m.end(), "access", m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end(), "hex", m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base.sort()
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        run = m[0]
        if len(run) < 20 or not re.search("[0-9]", run) or not re.search("[A-Za-z]", run) or any(s < m.end() and m.start() < e for s, _, e, _, _ in base):
            continue
        if re.fullmatch("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", run):
            continue
        words = [w for w in re.split("[/_=-]+", run)]
        if words[0] and all(re.fullmatch("[a-z]+|[A-Z][a-z]+|[A-Z]+|[0-9]{1,4}|", w) for w in words):
            continue
        name, bits = plain_windows(run)
        if bits >= {"entropy_hex": 3.0, "entropy_base36": 3.7, "entropy_base64": 4.0}[name] - 1e-12:
            extra.append((m.start(), 3, m.end(), name))
    listed = lambda spans: ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in spans)
    return [sum(x[3] == k for x in base) for k in ("assign", "access", "hex")], hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted([*base, *extra])), [plain_windows(x[4])[1] for x in base], len(extra)


def test_secrets_are_the_plain_ones(spark):
    r = random.Random(5)
    parts = ["password", "TOKEN", "api_key", "secret", " ", "=", ":", '"', "abc", "AKIA", "ABCDEF0123456789", "deadbeef01", "0123456789abcdef", "xyZ9_k/", "é", "😀", "\n", "secret=token: abcdefgh", "Ab3dEf6hIj9kLmN0pQrStU", "q7w8e9r1t2y3u4i5o6p7a8", "the word", "550e8400-e29b-41d4-a716-446655440000", "aaaaaaaaaaaaaaaaaaaaaaaa1", "F00DBABE12CAFE9876D1"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "a" * 100_000), (1003, "ab cd " * 20_000)]
    rows += [(2000 + i, " ".join("".join(r.choice(a) for _ in range(r.randint(18, 44))) for a in ("0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHabcdefgh0123456789+/", "aA1-")) + " secret: " + "".join(r.choice("abcXYZ012.") for _ in range(30))) for i in range(60)]
    rows += [(3000, "key deadbeefdeadbeefdeadbeef and Ab3dEf6hIj9kLmN0pQrStU " * 3_000)]
    found = secrets.scan(docs(spark, rows))
    kinds = ("assign", "access", "hex")
    got = {x.doc_id: x for x in found.select("doc_id", *[F.size(k).alias(k) for k in kinds], F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("sha"), secrets.listed(F.sort_array(F.concat("base", "extra"))).alias("spans"), "bits", F.size("extra").alias("extra")).collect()}
    for i, t in rows:
        n, sha, spans, bits, extra = plain_spans(t)
        assert ([got[i][k] for k in kinds], got[i].sha, got[i].spans, got[i].extra) == (n, sha, spans, extra)
        assert got[i].bits == pytest.approx(bits, abs=1e-9)
    for kind in ("entropy_hex", "entropy_base36", "entropy_base64"):
        assert any(kind in x.spans for x in got.values())
    assert got[3000].extra == 3_000 and secrets.scan(docs(spark, [])).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_secrets_beside_allowed_parts(spark):
    key, words = "Ab3dEf6hIj9kLmN0pQrStU", "/".join(["path", "to"] * 40)
    marks = ["-" * 10, "exampleeeeeeee", "eeeeeeeexample", "examplexample", "xxxxx", "Dummy", "A" * 9]
    hits = [words + "/" + key, "=" * 130 + key, *[m + key for m in marks], *[key + m + "7" for m in marks], "1" + "z" * 50_000 + key, "ab/" * 20_000 + key, "exampl" * 9_000 + "e" + key]
    clean = ["ab/" * 20_000 + "12", words + "/12", "550e8400-e29b-41d4-a716-446655440000", "Ab3dEf6hIjexample9kLmN0pQrStU", "-" * 130 + "a1", "Ab3dEf6hIj" + "=" * 8 + "9kLmN0pQrStU"]
    got = {x.doc_id: x.extra for x in secrets.scan(docs(spark, list(enumerate(hits + clean)))).collect()}
    assert [[(x.s, x.e) for x in got[i]] for i in range(len(hits))] == [[(0, len(t))] for t in hits]
    assert not any(got[len(hits) + i] for i in range(len(clean)))


# personal data


TEXT = "Dear Mr. John Smith, mail Bob.s@x1.example.com or bob.S@x1.example.com, call +1 (988) 555-2485, card 4111 1111 1111 1111 = 4111111111111111, ip 10.0.0.255. госпожа Иванова Мария. +1 (826) 555-4081 190.137.223.204 SSN 123-45-6789"


def test_surrogates_keep_type_and_reference(spark):
    import re

    rows = [(1, TEXT), (2, None), (3, ""), (None, "Mr Smith saw Mr. Smith at 10.0.0.255"), (5, "clean text 12.5 and 2020-01-01 v1.2.3"), (6, "pad " * 30_000 + "x@y.example.org"), (6, "x@y.example.org")]
    got = defaultdict(list)
    for r in pii.replace(docs(spark, rows)).collect():
        got[r.doc_id].append(r.text)
    new = got[1][0]
    for private in ("John", "Smith", "ob.s@", "555-2485", "4111", "10.0.0.255", "Иванова", "123-45-6789", "555-4081", ".204"):
        assert private not in new
    mails = re.findall(r"\S+@\S+", new)
    assert mails[0] == mails[1].rstrip(",") and mails[0].endswith(".com")
    a, b = re.search(r"card ([\d ]+) = (\d+)", new).groups()
    digits = [int(x) for x in b]
    assert a.replace(" ", "") == b and sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r"\+\d \(\d{3}\) \d{3}-\d{4}", new) and re.search(r"SSN \d{3}-\d{2}-\d{4}$", new)
    assert re.search(r"Mr\. (%s) " % "|".join(pii.GIVEN["m", "latin"]), new) and re.search(r"госпожа (%s) " % "|".join(pii.GIVEN["f", "cyrillic"]), new)
    assert re.search(r"ip (\S+)\.", new)[1] == got[None][0].split(" at ")[1]
    first, second = re.match(r"Mr (\S+) saw Mr\. (\S+)", got[None][0]).groups()
    assert first == second
    assert got[5] == [rows[4][1]] and got[2] == [None] and got[3] == [""] and got[6][0].endswith(got[6][1]) or got[6][1].endswith(got[6][0])
    assert pii.replace(docs(spark, [])).count() == 0
    assert pii.replace(docs(spark, rows[:1]), "other key").first().text != new


def test_surrogates_stay_distinct(spark, monkeypatch):
    """In a space of few surnames families meet, and are drawn anew until none do."""

    def few(word, draw, key):
        return F.concat(F.lit("N"), F.translate(F.pmod(F.xxhash64(word, draw), F.lit(60)).cast("string"), "0123456789", "abcdefghij"))

    monkeypatch.setattr(pii, "surname", few)
    names = [a + b for a in ("Ka", "Lo", "Mi", "Nu", "Po") for b in ("rin", "sen", "tal", "vik")]
    rows = [(i, f"Mr. {n} came") for i, n in enumerate(names * 2)]
    got = defaultdict(set)
    for r in pii.replace(docs(spark, rows)).collect():
        got[rows[r.doc_id][1]].add(r.text)
    assert all(len(v) == 1 for v in got.values()) and len({next(iter(v)) for v in got.values()}) == len(names)
    assert not {next(iter(v)) for v in got.values()} & set(got)


def test_members_of_a_family_share_its_surname(spark):
    """More members than there are given names; the family's surname stays through redraws."""
    given = ["".join(x).capitalize() for x in product(("qua", "xo", "zi", "ju", "wy"), repeat=2)]
    rows = [(i, f"Mr {n} Abernathy") for i, n in enumerate(given)] + [(100, "Mr Abernathy"), (101, "Mrs Abernathy")]
    new = {r.doc_id: r.text.split(" ") for r in pii.replace(docs(spark, rows)).collect()}
    assert len({x[-1] for x in new.values()}) == 1 and "Abernathy" not in new[0]
    assert len({" ".join(x) for x in new.values()}) == len(rows) and all(len(new[i]) == len(rows[i][1].split()) if i < 100 else len(new[i]) == 2 for i in new)


def test_whole_names_go(spark):
    rows = [(1, "Señora María García López vino"), (2, "Herr Karl von Berg kam"), (3, "Frau Anna Müller-Schmidt geht"), (4, "Mr McDonald and Mr O'Brien met Dr. J. van der Waals."), (5, "no name: mister Smith, Mrs. 5")]
    new = {r.doc_id: r.text for r in pii.replace(docs(spark, rows)).collect()}
    for i, private in ((1, "María García López"), (2, "Karl Berg"), (3, "Anna Müller Schmidt"), (4, "McDonald Donald Brien Waals")):
        assert not [p for p in private.split() if p in new[i]]
    assert new[2].split()[2] == "von" and new[3].count("-") == 1 and new[1].startswith("Señora ") and new[1].endswith(" vino")
    assert " van der " in new[4] and "Dr. " in new[4] and new[4].endswith(".") and new[5] == rows[4][1]


def test_iban_and_hot_null_ids(spark):
    valid = "DE89370400440532013000"
    rows = [(None, f"IBAN {valid} of x{i}@y.example.org.uk.example.com.a.b.c.d.e.f") for i in range(50)]
    for r in pii.replace(docs(spark, rows)).collect():
        iban = r.text.split()[1]
        moved = "".join(str(int(c, 36)) for c in iban[4:] + iban[:4])
        assert iban != valid and iban[:2] == "DE" and len(iban) == 22 and int(moved) % 97 == 1
        assert "example.org.uk" not in r.text and r.text.endswith(".f")


def test_surrogates_leave_all_columns_alone(spark):
    odd = spark.createDataFrame([(1, "to a@b.example.com", "h", "g", "r", "p", "n", "m", "i")], "doc_id bigint, text string, hits string, gaps string, row string, pairs string, `new` string, map string, id string")
    out = pii.replace(odd).first()
    assert out.asDict() | {"text": ""} == odd.first().asDict() | {"text": ""} and out.text != "to a@b.example.com"


def test_more_surnames_than_three_syllables_make(spark):
    names = ["".join(x).capitalize() for x in product(("qua", "xo", "zi", "ju", "wy", "phe", "gri", "sto"), repeat=4)] + ["Qua", "Xo"]
    new = [x.text for x in pii.replace(docs(spark, [(i, f"Mr {n}") for i, n in enumerate(names)])).select("text").collect()]
    assert len(names) > 4096 and len(set(new)) == len(names)
    assert all(len(x) < 60 and not any(c.isdigit() for c in x) and x.startswith("Mr ") for x in new)


def test_streams_stand_in_the_plan_once(spark):
    """The driver holds, copies and prints plans: no branch or character may bring a copy of the stream it reads."""
    entities = docs(spark, [(1, "a@b.example.com")]).select(F.lit("email").alias("kind"), F.col("text").alias("canon"))
    filled = pii.filled(pii.found(docs(spark, [(1, TEXT)]).select(F.struct("*").alias("row"), "text")), None, "key")
    for df, most in ((filled, 20), (entities.select(pii.replacement(F.col("kind"), F.col("canon"), F.lit(0), "key")), 20)):
        assert 0 < df._jdf.queryExecution().optimizedPlan().toString().count("sha2(") <= most


# packing


def test_plan_is_best_fit():
    r = random.Random(8)
    for _ in range(60):
        size = r.choice([8, 30, 100])
        counts = {n: r.choice([1, 2, 7, 40]) for n in r.sample(range(1, size + 1), r.randint(1, min(size, 25)))}
        plan, made = packing.plan_packing(counts, size)
        used, seen = defaultdict(list), Counter()
        for length, lo, hi, each, first, base in plan:
            for k in range(lo, hi):
                used[first + (k - lo) // each].append((base + (k - lo) % each * length, length))
                seen[length, k] += 1
        assert set(seen.values()) == {1} and len(seen) == sum(counts.values()) and len(used) == made
        for slots in used.values():
            at = 0
            for start, length in sorted(slots):
                assert start == at
                at += length
            assert at <= size
        rooms = []  # the same, a piece at a time
        for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fit = min((x for x in rooms if x >= length), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((size if fit is None else fit) - length)
        assert len(rooms) == made


def test_packing_is_the_libraries(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, mine = Tokenizer.from_file(path), packing.ByteCoder(path)
    rows = [*ODD, (8, " " * 400_000), (9, "it's <|endoftext|>  x\n\n y 漢字 ǅ")]
    for _, t in rows:
        assert list(mine.encode(t or "")) == library.encode(t or "", add_special_tokens=False).ids
    got = packing.pack(docs(spark, rows), path, 100).collect()
    lengths = [len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows]
    assert sum(r.length for r in got) == sum(lengths) and len(got) == sum(-(-n // 100) for n in lengths)
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 6)
    assert long[0][2] == lengths[7] % 100 and all(x[2] == 100 for x in long[1:]) and [x[1] for x in long[1:3]] == [long[0][2], long[0][2] + 100]
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    assert len(used) == -(-sum(lengths) // 100)
    assert packing.pack(docs(spark, []), path).count() == 0
