"""Secret scanning by patterns and by windowed entropy (DataFrame operations only).

Base spans are the matches of three patterns. Beyond them, candidate strings (long runs of
letters, digits and the signs of base64) are held against a window of fixed width that slides
over each: for every character class the window's Shannon entropy follows from counts that
are raised for the character that enters and lowered for the one that leaves. A candidate is
a span if some window of its class reaches the class's threshold, unless the allow list
knows its whole shape or it overlaps a base span; base spans always stay. Windows that touch
a ruler or a sample word do not count, those beside it do.

The same windows give every base span an entropy, which says how random its value is and
decides nothing.

Positions are code points from 0, ends exclusive. Null texts are empty. Whole texts are
scanned, however long. Other columns and repeated rows have no influence; an empty table gives
no rows.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Base patterns by kind, in the order in which kinds are listed; fixed values.
BASE = {
    "assign": r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A quick test that a text has any match of a kind.
HAS = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: A whole run of at least 20 of the signs, with a digit and a letter in it.
RUN = "A-Za-z0-9+/_=-"
CANDIDATE = rf"(?<![{RUN}])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[{RUN}]{{20,}}+"
#: Classes of candidates, the first that fits: name, pattern, alphabet, bits a window must reach.
CLASSES = (
    ("entropy_hex", r"^[0-9A-Fa-f]+$", "0123456789abcdef", 3.0),
    ("entropy_base36", r"^[0-9A-Z]+$|^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 3.7),
    ("entropy_base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 4.0),
)
WINDOW = 20
#: Matches of a text whose places are summed up together.
CHUNK = 256
#: Shapes of whole candidates that are no secrets: UUIDs, words and short numbers joined by signs.
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(?:[a-z]++|[A-Z][a-z]++|[A-Z]++|[0-9]{1,4}+)(?:[/_=-]++(?:[a-z]++|[A-Z][a-z]++|[A-Z]++|[0-9]{1,4}+))*+[/_=-]*+$",
)
#: Rulers and samples: windows that overlap them are no secrets.
SAMPLE = (
    r"(?:(?i:example|dummy|placeholder|x{4,}|abcdefgh|12345678)|(.)\1{7,}+)"
    r"(?:(?<=(.))\2{7,}+|(?i:(?<=e)xample|(?<=d)ummy|(?<=p)laceholder|(?<=a)bcdefgh|(?<=1)2345678))*+"  # what overlaps it
)

SPAN = "struct<s int, o int, e int, kind string, hit string>"
KINDS = (*BASE, *(c[0] for c in CLASSES))


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, where it is used in lambdas that would compute it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def all_spans(text: Column, kind: str, pattern: str) -> Column:
    """The matches of pattern in order of place, from the lengths of matches and of what lies between.

    Places are summed up chunk by chunk, as an array that grows by one is copied each time.
    """
    matches = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda h, g: F.struct(h.alias("hit"), F.char_length(g).alias("gap")))
    order, none = F.lit(KINDS.index(kind) if kind in KINDS else 0), F.expr(f"cast(array() as array<{SPAN}>)")

    def add(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.char_length(x["hit"])
        span = F.struct(start.alias("s"), order.alias("o"), end.alias("e"), F.lit(kind).alias("kind"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    def placed(found: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(found) - 1) / CHUNK), F.lit(0)).cast("int")), lambda c: F.slice(found, c * CHUNK + 1, CHUNK))
        more = lambda a, chunk: bound(F.aggregate(chunk, F.struct(a["at"].alias("at"), none.alias("out")), add), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out")))
        return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{SPAN}>>)").alias("out")), more, lambda a: F.flatten(a["out"]))

    return bound(F.filter(matches, lambda x: x["hit"].isNotNull()), placed)


def base_spans(text: Column, kind: str) -> Column:
    """The matches of a base kind that are long enough; those too short take their characters all the same."""
    if kind == "hex":
        # runs are as long as they get, so one that is too short can be left out of the search
        spans = all_spans(text, kind, BASE[kind][:-1] + "{%d,}" % LEAST[kind])
    else:
        value = (lambda x: F.regexp_extract(x["hit"], BASE[kind], 2)) if kind == "assign" else (lambda x: x["hit"])
        spans = F.filter(all_spans(text, kind, BASE[kind]), lambda x: F.char_length(value(x)) >= LEAST[kind])
    return F.when(text.rlike(HAS[kind]), spans).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def window_entropy(text: str, alphabet: str, window: int = WINDOW) -> str:
    """SQL for the largest entropy in bits of a window that slides over the expression text.

    With counts c of a window's characters its entropy is log2(window) - sum(c log2 c) / window;
    the sum changes by the terms of the character that enters and of the one that leaves.
    """
    term = "array(" + ", ".join(f"{c * log2(c) if c else 0.0!r}D" for c in range(window + 1)) + ")"
    entered = f"a.sum + IF(x.i = x.o, 0D, {term}[a.n[x.i] + 1] - {term}[a.n[x.i]] + IF(x.o < 0, 0D, {term}[a.n[x.o] - 1] - {term}[a.n[x.o]]))"
    return f"""get(transform(array(split({text}, '')), cs -> aggregate(
      transform(cs, (c, k) -> named_struct('k', k, 'i', locate(c, '{alphabet}'), 'o', IF(k < {window}, -1, locate(get(cs, k - {window}), '{alphabet}')))),
      named_struct('n', array_repeat(0, {len(alphabet) + 1}), 'sum', 0D, 'most', 0D),
      (a, x) -> named_struct(
        'n', transform(a.n, (n, j) -> n + IF(j = x.i, 1, 0) - IF(j = x.o, 1, 0)),
        'sum', {entered},
        'most', IF(x.k < {window - 1}, a.most, greatest(a.most, {log2(window)!r}D - ({entered}) / {window}))),
      a -> a.most)), 0)"""


def beside_samples(hit: str) -> str:
    """SQL for the pieces of the expression hit whose windows touch no sample; a sample is cut out whole."""
    return f"split({hit}, r'{SAMPLE}', -1)"


def most_bits(hit: str, alphabet: str) -> str:
    """SQL for the largest entropy of a window of the expression hit that touches no sample; 0 where there is no such window."""
    return f"array_max(transform({beside_samples(hit)}, p -> {window_entropy('p' if len(alphabet) > 40 else 'lower(p)', alphabet)}))"


def value_of(span: Column) -> Column:
    """What a base span holds secret."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["hit"], BASE["assign"], 2)).otherwise(span["hit"])


def value_bits(values: str) -> Column:
    """For each of a column of strings the largest window entropy in its own class."""
    return F.expr(f"transform({values}, y -> CASE {' '.join(f"WHEN y RLIKE r'{p}' THEN {most_bits('y', a)}" for _, p, a, _ in CLASSES)} END)")


def entropy_spans(candidates: str) -> Column:
    """Those of the column of candidate spans that some window of their class gives away."""
    allowed = " OR ".join(f"x.hit RLIKE r'{p}'" for p in ALLOW)
    kept = f"filter({candidates}, x -> NOT ({allowed}))"
    branch = "".join(f" WHEN x.hit RLIKE r'{p}' THEN IF({most_bits('x.hit', a)} >= {bits}D, '{name}', '')" for name, p, a, bits in CLASSES)
    place = "CASE y.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    return F.expr(f"""transform(filter(transform({kept}, x -> named_struct('s', x.s, 'e', x.e, 'kind', CASE{branch} END, 'hit', x.hit)), y -> y.kind <> ''),
                      y -> named_struct('s', y.s, 'o', {place}, 'e', y.e, 'kind', y.kind, 'hit', y.hit))""")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and extra (arrays of spans), bits (the entropy of each of base) of every row of docs(doc_id, text)."""
    text = F.col("text")
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.select("doc_id", *[base_spans(text, k).alias(k) for k in BASE], F.when(text.rlike(f"[{RUN}]{{20}}"), all_spans(text, "candidate", CANDIDATE)).otherwise(empty).alias("candidates"))
    df = df.withColumn("base", F.sort_array(F.concat(*BASE))).withColumn("values", F.transform("base", value_of))
    free = F.filter(entropy_spans("candidates"), lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    bits = F.when(F.size("base") > 0, value_bits("values")).otherwise(F.expr("cast(array() as array<double>)"))
    return df.select("doc_id", *BASE, "base", F.when(F.size("candidates") > 0, free).otherwise(empty).alias("extra"), bits.alias("bits"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the contract, the number of spans that entropy adds, and the base spans' entropies in bits, in their order."""
    df = scan(table(spark, sf_dir, "documents"))
    return df.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                     listed(F.sort_array(F.concat("base", "extra"))).alias("spans"), F.size("extra").cast("long").alias("n_entropy"), F.transform("bits", lambda x: F.round(x, 3)).alias("bits"))

