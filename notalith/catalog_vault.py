"""Queries over a collection of notes that is made of the part table, a note a row.

The notes are made by concatenation alone, so what any query must return follows from the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.passages import canonical_passage, chunk_hash
from .operators import graph
from .operators.filters import candidates
from .plans import reports
from .session import stored
from .sources import index_io, markdown

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The columns of a note, for both sides: Spark and DuckDB read the same text.
NOTE = """
  SELECT p_partkey AS k, concat(p_name, ' ', p_partkey) AS title, replace(p_brand, '#', '') AS brand, lower(p_type) AS kind, p_size AS size, concat('item-', p_partkey) AS alias,
         CASE p_size % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'draft' ELSE 'archived' END AS status, CASE WHEN p_partkey % 2 = 0 THEN 'alpha' ELSE 'beta' END AS project, CASE WHEN p_partkey % 7 = 0 THEN 'false' ELSE 'true' END AS canonical,
         concat('2025-', lpad(CAST(p_partkey % 12 + 1 AS {text}), 2, '0'), '-', lpad(CAST(p_partkey % 28 + 1 AS {text}), 2, '0')) AS created, CAST(round(p_retailprice * 100) AS BIGINT) AS cents,
         (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS other FROM part"""


def notes(spark: SparkSession, d: str) -> DataFrame:
    """file, raw, md5, mtime and the columns that they are made of."""
    part = spark.read.parquet(f"{d}/part.parquet")
    part.createOrReplaceTempView("part")
    n = spark.sql(NOTE.format(text="string"))
    names = n.select(F.col("k").alias("other"), F.col("title").alias("other_title"))
    # few and small files hold many notes: rows are dealt over the tasks before texts are made and parsed
    n = n.join(names, "other").repartition(4 * spark.sparkContext.defaultParallelism, "k")
    front = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{a}: "), v) for a, v in (("title", F.col("title")), ("aliases", F.concat(F.lit("["), "alias", F.lit("]"))), ("tags", F.concat(F.lit("[#"), "kind", F.lit(", "), F.lower("brand"), F.lit("]"))),
                        ("project", F.col("project")), ("status", F.col("status")), ("canonical", F.col("canonical")), ("priority", F.col("size").cast("string")), ("created", F.col("created")))], F.lit("---"))
    body = F.concat(F.lit("\n\n# "), "title", F.lit("\n\n"), first_text(), F.lit("\n\n## Specs\n\n"), second_text(), F.lit("\n\n## Related\n\n"), third_text(), F.lit("\n"))
    n = n.withColumn("file", F.concat("brand", F.lit("/"), F.col("k").cast("string"), F.lit(".md"))).withColumn("raw", F.concat(front, body))
    return n.withColumn("md5", F.md5(F.col("raw").cast("binary"))).withColumn("mtime", F.to_timestamp("created"))


def first_text():
    return F.concat("title", F.lit(" is a "), "kind", F.lit(" item of "), "brand", F.lit(" sold at "), F.col("cents").cast("string"), F.lit(" cents."))


def second_text():
    return F.concat(F.lit("The size of "), "title", F.lit(" is "), F.col("size").cast("string"), F.lit(" and the brand is "), "brand", F.lit("."))


def third_text():
    return F.concat(F.lit("See [["), "other_title", F.lit("]] for a similar item of the catalogue."), F.when(F.col("k") % 10 == 0, F.concat(F.lit(" Also [[missing "), F.col("k").cast("string"), F.lit("|gone]]."))).otherwise(F.lit("")))


VAULT = "WITH n AS (" + NOTE.format(text="VARCHAR") + """),
v AS (SELECT n.*, o.title AS other_title, concat(n.brand, '/', n.k, '.md') AS file FROM n JOIN n o ON n.other = o.k),
t AS (SELECT *, concat(title, ' is a ', kind, ' item of ', brand, ' sold at ', cents, ' cents.') AS t1, concat('The size of ', title, ' is ', size, ' and the brand is ', brand, '.') AS t2,
      concat('See [[', other_title, ']] for a similar item of the catalogue.', CASE WHEN k % 10 = 0 THEN concat(' Also [[missing ', k, '|gone]].') ELSE '' END) AS t3 FROM v),
c AS (SELECT file, k, title, kind, brand, title AS heading, title AS path, t1 AS text, 13 AS start_line FROM t UNION ALL SELECT file, k, title, kind, brand, 'Specs', concat(title, ' > Specs'), t2, 17 FROM t
      UNION ALL SELECT file, k, title, kind, brand, 'Related', concat(title, ' > Related'), t3, 21 FROM t)
"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = VAULT + sql
        return f

    return keep


def parsed(spark, d):
    return stored(markdown.parse_docs(notes(spark, d).select("file", "raw", "md5", "mtime")), "parsed")


def chunks(spark, d):
    return markdown.numbered(markdown.chunks_of(parsed(spark, d)))


@query("SELECT file, heading, path, text, start_line, start_line AS end_line FROM c")
def md_chunks(spark, d):
    return chunks(spark, d).select("file", "heading", F.array_join("heading_path", " > ").alias("path"), "text", "start_line", "end_line")


@query("SELECT path, count(*) AS n FROM c GROUP BY 1")
def md_heading_path(spark, d):
    return chunks(spark, d).groupBy(F.array_join("heading_path", " > ").alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT file, title, concat(kind, ',', lower(brand)) AS tags, alias AS aliases, project, status, canonical = 'true' AS canonical, created, CAST(size AS VARCHAR) AS priority FROM t")
def md_frontmatter(spark, d):
    m = lambda c: F.col(f"meta.{c}")
    return parsed(spark, d).select("file", "title", F.array_join(m("tags"), ",").alias("tags"), F.array_join(m("aliases"), ",").alias("aliases"), m("project").alias("project"), m("status").alias("status"), m("canonical").alias("canonical"),
                                   m("created").alias("created"), m("custom")["priority"].alias("priority"))


PASSAGE = "concat_ws(chr(10), title, CASE WHEN heading <> title THEN heading END, concat('tags: #', kind, ' #', lower(brand)), text)"


@query(f"SELECT file, heading, {PASSAGE} AS passage FROM c")
def md_canonical_passage(spark, d):
    return chunks(spark, d).select("file", "heading", canonical_passage(F.col("title"), F.col("heading_path"), F.col("meta.tags"), F.col("text")).alias("passage"))


@query(f"SELECT file, heading, sha256(concat('heading-path-v1', chr(0), 'hash-64', chr(0), 'main', chr(0), '', chr(0), {PASSAGE})) AS chunk_hash FROM c")
def md_chunk_hash(spark, d):
    passage = canonical_passage(F.col("title"), F.col("heading_path"), F.col("meta.tags"), F.col("text"))
    return chunks(spark, d).select("file", "heading", chunk_hash({"id": "hash-64"}, passage).alias("chunk_hash"))


def filtered(name: str, expression: str, sql: str) -> None:
    def run(spark, d):
        return parsed(spark, d).where(candidates(filter=expression)).select("file")

    run.__name__ = f"filter_dsl_{name}"
    query(f"SELECT file FROM t WHERE {sql}")(run)


filtered("and", "tag:promo AND status:active", "kind = 'promo' AND status = 'active'")
filtered("or_group", '(tag:#Small OR tag:large) AND status != "archived"', "kind IN ('small', 'large') AND status <> 'archived'")
filtered("not", "NOT tag:promo AND !status:draft", "kind <> 'promo' AND status <> 'draft'")
filtered("implicit_and", "project:beta priority >= 25", "project = 'beta' AND size >= 25")
filtered("number", "priority < 10 OR priority == 40", "size < 10 OR size = 40")
filtered("missing", "owner != bob AND NOT owner:bob AND project = alpha", "project = 'alpha'")
filtered("date_string", "date >= 2025-06-01 AND created < 2025-09-15", "created >= '2025-06-01' AND created < '2025-09-15'")
filtered("contains", "title contains bolt AND file contains brand1", "contains(lower(title), 'bolt') AND contains(lower(file), 'brand1')")
filtered("boolean", "canonical:false OR alias = item-5", "canonical = 'false' OR k = 5")
filtered("number_on_text", "status:2 OR status != 3 OR priority > 45", "size > 45")


def predicate(name: str, sql: str, **where) -> None:
    def run(spark, d):
        return parsed(spark, d).where(candidates(**where)).select("file")

    run.__name__ = name
    query(f"SELECT file FROM t WHERE {sql}")(run)


predicate("glob_filter", "brand LIKE 'Brand1%' AND brand NOT LIKE '%/%'", globs="brand1*/*.MD")
predicate("since_filter", "created >= '2025-07-01'", since="2025-07-01")
predicate("tag_all", "kind = 'economy' AND brand = 'Brand3'", tags=["#Economy", "brand3"])
predicate("canonical_only", "canonical = 'true'", canonical_only=True)
predicate("custom_eq", "size = 7", custom={"priority": 7})
predicate("metadata_eq", "project = 'alpha' AND status = 'draft'", project="alpha", status="draft")


def documents(spark, d):
    """file, title, meta and the text of all chunks."""
    p = parsed(spark, d)
    return p.select("file", "title", "meta", F.array_join(F.transform("pieces", lambda x: x["text"]), "\n").alias("text"))


@query("SELECT file, 'wikilink' AS type, other_title AS target, CAST(NULL AS VARCHAR) AS label, 3 AS line FROM t UNION ALL SELECT file, 'wikilink', concat('missing ', k), 'gone', 3 FROM t WHERE k % 10 = 0")
def links_extract(spark, d):
    return graph.extract_links(documents(spark, d)).select("file", "type", "target", "label", "line")


LINKS = """, l AS (SELECT t.file, o.file AS resolved FROM t JOIN t o ON t.other = o.k),
e AS (SELECT DISTINCT file AS src, resolved AS dst FROM l WHERE file <> resolved) """


@query(LINKS + "SELECT file, other_title AS target, 'resolved' AS status, resolved FROM t JOIN l USING (file) UNION ALL SELECT file, concat('missing ', k), 'broken', NULL FROM t WHERE k % 10 = 0")
def links_resolve(spark, d):
    docs = documents(spark, d)
    return graph.resolve_links(graph.extract_links(docs), docs).select("file", "target", "status", "resolved")


def edges(spark, d):
    return stored(graph.build_graph(documents(spark, d)), "edges")


@query(LINKS + "SELECT dst AS file, count(*) AS backlinks, min(src) AS first FROM e GROUP BY 1")
def backlinks(spark, d):
    return graph.backlinks(edges(spark, d)).groupBy(F.col("src").alias("file")).agg(F.count(F.lit(1)).alias("backlinks"), F.min("dst").alias("first"))


@query(LINKS + """, s AS (SELECT file AS seed FROM t WHERE k % 100 = 0), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
h1 AS (SELECT DISTINCT seed, dst AS file FROM s JOIN b ON b.src = seed WHERE dst <> seed), h2 AS (SELECT DISTINCT seed, dst AS file FROM h1 JOIN b ON b.src = h1.file WHERE dst <> seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.file = b.dst))
SELECT seed, file, 1 AS distance FROM h1 UNION ALL SELECT seed, file, 2 FROM h2""")
def related_notes_bfs(spark, d):
    seeds = notes(spark, d).where("k % 100 = 0").select(F.col("file").alias("seed"))
    return graph.related(edges(spark, d), seeds, 2).select("seed", "file", "distance")


def rank_sql(rounds: int) -> str:
    parts = [", f AS (SELECT src, count(*) AS fan FROM e GROUP BY 1), z AS (SELECT count(*) AS n FROM t), r0 AS (SELECT file, 1.0::DOUBLE / n AS rank FROM t, z)"]
    for i in range(rounds):
        parts.append(f"x{i} AS (SELECT coalesce(sum(rank), 0) AS loose FROM r{i} LEFT JOIN f ON src = file WHERE fan IS NULL), g{i} AS (SELECT dst, sum(rank / fan) AS got FROM e JOIN f USING (src) JOIN r{i} ON file = src GROUP BY 1)")
        parts.append(f"r{i + 1} AS (SELECT file, 0.15 / n + 0.85 * (coalesce(got, 0) + loose / n) AS rank FROM t CROSS JOIN z CROSS JOIN x{i} LEFT JOIN g{i} ON dst = file)")
    return LINKS + ", ".join(parts)


@query(rank_sql(10) + " SELECT file, round(rank, 9) AS rank FROM r10")
def pagerank_fixed(spark, d):
    docs = documents(spark, d)
    edges = stored(graph.build_graph(docs), "edges")  # of the notes that have been parsed already
    return graph.page_rank(edges, docs.select("file"), 10, None).select("file", F.round("rank", 9).alias("rank"))


@query(LINKS + """, q AS (SELECT k AS qid, file AS seed, 1.0::DOUBLE AS score FROM t WHERE k % 100 = 0), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
h1 AS (SELECT DISTINCT qid, seed, dst AS file FROM q JOIN b ON b.src = seed WHERE dst <> seed), h2 AS (SELECT DISTINCT qid, seed, dst AS file FROM h1 JOIN b ON b.src = h1.file WHERE dst <> seed)
SELECT qid, file, max(s) AS score FROM (SELECT qid, file, 0.5 AS s FROM h1 UNION ALL SELECT qid, file, 0.25 FROM h2) GROUP BY 1, 2""")
def graph_expand(spark, d):
    seeds = notes(spark, d).where("k % 100 = 0").select(F.col("k").alias("qid"), "file", F.lit(1.0).alias("score"))
    return graph.expand(edges(spark, d), seeds)


@query("SELECT file, title, heading, text, start_line FROM c WHERE file = 'Brand2/0.md' AND heading = 'Specs'")
def get_chunk(spark, d):
    return reports.get_chunk(chunks(spark, d), "Brand2/0.md", "specs").select("file", "title", "heading", "text", "start_line")


@query("SELECT file, 3::BIGINT AS chunks FROM t WHERE brand = 'Brand2'")
def list_files_glob(spark, d):
    return reports.list_files(chunks(spark, d), "brand2/**")


@query("SELECT file, title, heading, path AS \"headingPath\", text FROM c")
def export_csv_shape(spark, d):
    path = f"{shared(spark)}/csv"
    index_io.export_csv(chunks(spark, d), path)
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


@query("SELECT file, heading, path AS headings, text FROM c")
def export_jsonl_shape(spark, d):
    path = f"{shared(spark)}/jsonl"
    index_io.export_jsonl(chunks(spark, d).withColumn("chunk_hash", F.lit("")), path, vectors=False)
    return spark.read.schema("file string, heading string, headingPath array<string>, text string").json(path).select("file", "heading", F.array_join("headingPath", " > ").alias("headings"), "text")


@query("SELECT file, title, heading, text FROM c")
def export_parquet_shape(spark, d):
    path = f"{shared(spark)}/parquet"
    index_io.export_parquet(chunks(spark, d), path)
    return spark.read.parquet(path)


def shared(spark: SparkSession) -> str:
    """A new folder in the session's checkpoint folder."""
    import uuid

    stored(spark.range(1), "probe")  # sets the folder where none is
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/out-{uuid.uuid4().hex}"


def older(spark, d):
    """The same notes before: every ninth was written otherwise, every eleventh was not there; a few are gone since."""
    n = notes(spark, d).select("k", "file", "raw", "md5", "mtime")
    was = n.where("k % 11 <> 0").withColumn("raw", F.when(F.col("k") % 9 == 0, F.regexp_replace("raw", "Specs", "Details")).otherwise(F.col("raw")))
    gone = n.where("k % 50 = 1").select("k", F.concat(F.lit("gone/"), "file").alias("file"), F.concat(F.lit("# Gone "), "file", F.lit("\n\nThis is a note that went away some time ago.\n")).alias("raw"), "md5", "mtime")
    return was.unionByName(gone).withColumn("md5", F.md5(F.col("raw").cast("binary")))


@query("SELECT file, CASE WHEN k % 11 = 0 THEN 'new' WHEN k % 9 = 0 THEN 'changed' ELSE 'same' END AS change FROM t UNION ALL SELECT concat('gone/', file), 'deleted' FROM t WHERE k % 50 = 1")
def incremental_diff(spark, d):
    from .plans.build import changes

    return changes(notes(spark, d), older(spark, d))


@query("SELECT concat('gone/', file) AS file FROM t WHERE k % 50 = 1")
def deleted_files(spark, d):
    from .plans.build import deleted

    return deleted(notes(spark, d), older(spark, d))


@query("SELECT (SELECT count(*) * 3 FROM t WHERE k % 11 <> 0) - (SELECT count(*) FROM t WHERE k % 11 <> 0 AND k % 9 = 0) AS reused, (SELECT count(*) * 3 FROM t WHERE k % 11 = 0) + (SELECT count(*) FROM t WHERE k % 11 <> 0 AND k % 9 = 0) AS embedded, (SELECT count(*) * 3 FROM t) AS chunks")
def chunk_reuse(spark, d):
    """What a second build of the changed notes takes over, and what it embeds."""
    from .plans.build import build_index

    path = f"{shared(spark)}/index"
    build_index(spark, older(spark, d), path, cluster=False)
    r = build_index(spark, notes(spark, d), path, cluster=False)
    return spark.createDataFrame([(r.reused, r.embedded, r.chunks)], "reused bigint, embedded bigint, chunks bigint")


#: Indexes of the notes by application, folder and whether they have clusters: an index outlives the query that builds it.
BUILT: dict[tuple, str] = {}


def built(spark, d, cluster=False):
    from .plans.build import build_index
    from .plans.search import Index

    key = (spark.sparkContext.applicationId, d, cluster)
    if key not in BUILT:
        path = f"{shared(spark)}/index"
        build_index(spark, notes(spark, d), path, cluster=cluster)
        BUILT[key] = path
    return Index.load(spark, BUILT[key]), BUILT[key]


def note_queries(spark, d):
    """Titles of every hundredth note as queries."""
    return notes(spark, d).where("k % 100 = 0").select(F.col("k").alias("qid"), F.col("title").alias("query"))


HITS = ("qid", "rank", "file", "heading", "cosine", "score", "graph_score")


def embedded_sql(text: str) -> str:
    """The vector of hash-64: a count for each word in the place of its hash modulo 64, at length one, as float32."""
    code = "list_reduce(list_prepend(7, list_transform(string_split(w, ''), lambda c: unicode(c))), lambda h, c: (h * 31 + c) % 4294967296) % 64"
    counts = f"list_transform(range(64), lambda b: len(list_filter(list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), lambda w: {code}), lambda x: x = b)))"
    return f"(SELECT list_transform(l, lambda x: (x / sqrt(list_sum(list_transform(l, lambda y: y * y))))::FLOAT)::DOUBLE[] FROM (SELECT {counts} AS l))"


def search_sql(where: str = "TRUE", graph: bool = False, k: int = 6) -> str:
    """CTEs that end in hits(qid, rank, file, heading, text, fused, cosine, graph_score): lanes, their fusion and the first k of each query."""
    from .catalog_search import tok

    weighted = " UNION ALL ".join(f"SELECT file, start_line, unnest({tok(field)}) AS term, {w}::DOUBLE AS w FROM k" for field, w in (("title", 3.0), ("alias", 3.0), ("path", 1.8), ("text", 1.0)))
    lanes = "SELECT qid, file, start_line, 'semantic' AS lane, round(cosine, 9) AS score FROM cs UNION ALL SELECT qid, file, start_line, 'bm25', round(score, 9) FROM bm UNION ALL SELECT qid, file, start_line, 'fuzzy', round(score, 9) FROM fz"
    boosted = rank_sql(3)[len(LINKS) + 1 :] + """,
sd AS (SELECT qid, file AS seed, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file) AS r FROM (SELECT qid, file, max(cosine) AS score FROM cs WHERE cosine > 0 GROUP BY 1, 2)) WHERE r <= 10),
bi AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), o1 AS (SELECT DISTINCT seed, dst AS file FROM (SELECT DISTINCT seed FROM sd) JOIN bi ON src = seed WHERE dst <> seed),
o2 AS (SELECT DISTINCT o1.seed, dst AS file FROM o1 JOIN bi ON src = file WHERE dst <> o1.seed AND NOT EXISTS (SELECT 1 FROM o1 x WHERE x.seed = o1.seed AND x.file = dst)),
pa AS (SELECT qid, file, max(score * f) AS passed FROM sd JOIN (SELECT seed, file, 0.5 AS f FROM o1 UNION ALL SELECT seed, file, 0.25 FROM o2) USING (seed) GROUP BY 1, 2),
gr AS (SELECT qid, file, start_line, rank + coalesce(passed, 0) AS score FROM cs JOIN r3 USING (file) LEFT JOIN pa USING (qid, file)),"""
    if graph:
        lanes += " UNION ALL SELECT qid, file, start_line, 'graph', round(score, 9) FROM gr"
    return (LINKS if graph else "") + f""", k AS (SELECT c.*, t.alias, t.status, concat('item-', c.k) AS al FROM c JOIN t USING (file)),
qs AS (SELECT k AS qid, title AS query, {embedded_sql('title')} AS v FROM t WHERE k % 100 = 0), q AS (SELECT qid, unnest(list_distinct({tok('query')})) AS term FROM qs),
ok AS (SELECT * FROM k WHERE {where}), ve AS (SELECT file, start_line, {embedded_sql(PASSAGE)} AS v FROM ok),
cs AS (SELECT qid, file, start_line, list_inner_product(qs.v, ve.v) AS cosine FROM qs, ve),
p AS (SELECT file, start_line, term, sum(w) AS tf FROM ({weighted}) GROUP BY 1, 2, 3), le AS (SELECT file, start_line, round(sum(tf), 3) AS len FROM p GROUP BY 1, 2),
av AS (SELECT count(*) AS n, avg(len) AS av FROM le), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
bm AS (SELECT qid, p.file, p.start_line, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))) AS score
  FROM q JOIN p USING (term) JOIN df USING (term) JOIN le ON le.file = p.file AND le.start_line = p.start_line CROSS JOIN av WHERE EXISTS (SELECT 1 FROM ok WHERE ok.file = p.file) GROUP BY 1, 2, 3),
nw AS (SELECT DISTINCT file, start_line, word FROM (SELECT file, start_line, unnest({tok("concat(title, ' ', alias)")}) AS word FROM ok) WHERE length(word) >= 3),
pr AS (SELECT term, word, damerau_levenshtein(term, word) AS dist FROM (SELECT DISTINCT term FROM q WHERE length(term) >= 3), (SELECT DISTINCT word FROM nw) WHERE abs(length(term) - length(word)) <= 2),
fz AS (SELECT qid, file, start_line, 2 * max(1 - dist / greatest(length(pr.term), length(word))) AS score FROM nw JOIN pr USING (word) JOIN q USING (term) WHERE dist <= least(2, length(pr.term) // 3) GROUP BY 1, 2, 3),
{boosted if graph else ''}
la AS (SELECT *, rank() OVER (PARTITION BY qid, lane ORDER BY score DESC) AS r FROM ({lanes}) WHERE score > 0),
fu AS (SELECT qid, file, start_line, sum(CASE lane WHEN 'graph' THEN 0.5 ELSE 1 END / (60 + r)) AS fused FROM la GROUP BY 1, 2, 3),
hits AS (SELECT * FROM (SELECT fu.*, cosine, heading, text, {'gr.score' if graph else 'NULL::DOUBLE'} AS graph_score,
  row_number() OVER (PARTITION BY fu.qid ORDER BY round(fused, 9) DESC, round(coalesce(cosine, -1), 9) DESC, fu.file, fu.start_line) AS rank
  FROM fu JOIN c USING (file, start_line) LEFT JOIN cs USING (qid, file, start_line) {'LEFT JOIN gr USING (qid, file, start_line)' if graph else ''}) WHERE rank <= {k})"""


SHOWN = " SELECT qid, rank, file, heading, round(cosine, 3) AS cosine, round(fused, 4) AS score, round(graph_score, 4) AS graph_score FROM "


@query(search_sql("status <> 'archived'") + SHOWN + "hits")
def vault_search(spark, d):
    from .plans.search import search

    return search(note_queries(spark, d), built(spark, d)[0], filter="status != archived").select(*HITS)


@query(search_sql(graph=True) + SHOWN + "(SELECT *, row_number() OVER (PARTITION BY qid, file ORDER BY rank) AS nth FROM hits) WHERE nth <= 1")
def graph_boost_search(spark, d):
    from .plans.search import search

    return search(note_queries(spark, d), built(spark, d)[0], graph_boost=0.5, max_per_doc=1).select(*HITS)


@query()
def ann_search(spark, d):
    from .plans.search import search

    return search(note_queries(spark, d), built(spark, d, True)[0], ann=True).select(*HITS)


def asked_sql() -> str:
    from .catalog_search import SENTENCES, tok

    return search_sql(k=5) + f""", hx AS (SELECT qid, rank, round(fused, 4) AS score, concat('[', file, ' › ', heading, ']') AS cite, substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 220) AS text FROM hits),
su AS (SELECT qid, rank, score, cite, unnest(ss) AS sent, generate_subscripts(ss, 1) AS n FROM (SELECT *, {SENTENCES} AS ss FROM hx)), ts AS (SELECT qid, {tok('query')} AS terms FROM qs),
sf AS (SELECT su.*, len(list_filter({tok('sent')}, lambda x: list_contains(terms, x))) AS found, len({tok('sent')}) AS toks FROM su JOIN ts USING (qid) WHERE length(sent) > 15),
sp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(found / (toks + 1) * score, 9) DESC, rank, n) AS place FROM sf WHERE found > 0),
an AS (SELECT qid, string_agg(sent || ' ' || cite, chr(10) || chr(10) ORDER BY place) AS body FROM sp WHERE place <= 3 GROUP BY 1),
ex AS (SELECT qid, string_agg(cite || ': ' || substr(text, 1, 200) || '…', chr(10) || chr(10) ORDER BY rank) AS body FROM hx WHERE rank <= 2 GROUP BY 1)
SELECT qid, CASE WHEN an.body IS NOT NULL THEN 'Based on your notes:' || chr(10) || chr(10) || an.body WHEN ex.body IS NOT NULL THEN 'Relevant excerpts from notes:' || chr(10) || chr(10) || ex.body
  ELSE 'No relevant passages found in the notes to answer the question.' END AS answer FROM qs LEFT JOIN an USING (qid) LEFT JOIN ex USING (qid)"""


@query(asked_sql())
def ask_vault(spark, d):
    from .plans.answers import ask

    return ask(note_queries(spark, d), built(spark, d)[0])


@query("SELECT (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM t) AS files, 0::BIGINT AS bad_vectors, 0::BIGINT AS empty_texts, 0::BIGINT AS repeated_ids, 0::BIGINT AS wrong_lengths, 0::BIGINT AS not_positive, 0::BIGINT AS without_length, 0::BIGINT AS repeated, 0::BIGINT AS orphan_lengths, 0::BIGINT AS orphan_edges")
def index_health(spark, d):
    i = built(spark, d)[0]
    return reports.health(i.chunks, i.postings, i.lengths, i.edges, 64)


def as_files(rows: DataFrame, folder: str) -> None:
    """Writes raw of rows(file, raw) under folder, each in its own file, by the tasks."""

    def write(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for file, raw in zip(b.column("file").to_pylist(), b.column("raw").to_pylist(), strict=True):
                store.create_dir(f"{base}/{file}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{file}", compression=None) as out:
                    out.write(raw.encode())
            yield b.select(["file"])

    rows.select("file", "raw").mapInArrow(write, "file string").write.format("noop").mode("overwrite").save()


@query("SELECT file, CASE WHEN k % 9 = 0 AND k % 11 <> 0 THEN 'changed' WHEN k % 11 = 0 THEN 'new' ELSE 'same' END AS change, 3::BIGINT AS chunks, md5 AS indexed FROM (SELECT *, " + 'md5(concat_ws(chr(10), \'---\', concat(\'title: \', title), concat(\'aliases: [\', alias, \']\'), concat(\'tags: [#\', kind, \', \', lower(brand), \']\'), concat(\'project: \', project), concat(\'status: \', status), concat(\'canonical: \', canonical), concat(\'priority: \', size), concat(\'created: \', created), \'---\') || chr(10) || chr(10) || \'# \' || title || chr(10) || chr(10) || t1 || chr(10) || chr(10) || \'## Specs\' || chr(10) || chr(10) || t2 || chr(10) || chr(10) || \'## Related\' || chr(10) || chr(10) || t3 || chr(10)) AS md5 FROM t)')
def stream_incremental(spark, d):
    """Notes arrive as files in two batches of a stream: older ones, then edits and new ones, while some go.

    Returns what the second batch made of each note that is left, with its chunks and the digest indexed.
    """
    from .plans.build import changes
    from .streaming.refresh import follow

    root = shared(spark)
    old, new = stored(older(spark, d), "older"), stored(notes(spark, d).select("file", "raw", "md5"), "newer")
    as_files(old, f"{root}/notes")
    follow(spark, f"{root}/notes", f"{root}/index", f"{root}/cp", once=True, cluster=False).awaitTermination()
    before = stored(index_io.Store(spark, f"{root}/index").table("docs").select("file", "md5"), "before")
    index_io.Store(spark, root).remove("notes/gone")
    diff = changes(new, old).where("change IN ('new', 'changed')").select("file")
    as_files(new.join(diff, "file", "left_semi"), f"{root}/notes")
    follow(spark, f"{root}/notes", f"{root}/index", f"{root}/cp", once=True, cluster=False).awaitTermination()
    store = index_io.Store(spark, f"{root}/index")
    after = store.table("docs").select("file", F.col("md5").alias("indexed"))
    made = changes(after.withColumnRenamed("indexed", "md5"), before).where("change <> 'deleted'")
    return made.join(reports.list_files(store.table("chunks")), "file").join(after, "file")
