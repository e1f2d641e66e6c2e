"""Surrogates for personal data (DataFrame operations only).

Entities are found by patterns. Each gets a replacement drawn from a keyed hash of its kind and
canonical form, so all mentions of one entity in all documents get the same one. It is of the
entity's type and format: digits stay digits, letters keep case and script, separators stay
where they are, octets stay octets, valid card numbers and IBANs get valid check digits, a mail
address keeps its top-level domain. A name is a title and the words after it that look like
names, whatever their number; the title and particles stay, given names become given names of
the title's gender and of their own script, and the last word, the family's, becomes one
surname for all of its members. All entities of the corpus are then held against each other:
where two would get the same replacement, or one an existing entity, all but the first draw
anew until no two meet. Families are settled first and keep their surname; where full names meet
then, they draw other given names.

The hash is an HMAC; its key is the session's `spark.notalith.piiKey`, and whoever has it can
link surrogates to entities they guess. Without that setting a known key is used, which suits
tests.

Null texts stay null and have no entities; whole texts are read, however long. Rows that repeat
others are replaced alike; other columns have no influence, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import count

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_for, table, written

#: Titles and names by gender and script.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Madame", "Mme", "госпожа"), "m": ("Mr", "Sir", "Herr", "Señor", "Monsieur", "господин"),
          "": ("Dr", "Doctor", "Prof", "Professor", "Doktor", "доктор")}
PARTICLES = ("von", "van", "der", "den", "de", "del", "della", "da", "di", "du", "dos", "la", "le", "zu", "zur", "ter", "bin", "ibn", "al", "el", "y", "фон")
GIVEN = {
    ("f", "latin"): ("Anna", "Clara", "Elena", "Emma", "Helen", "Ida", "Julia", "Laura", "Lucia", "Maria", "Nina", "Olivia", "Paula", "Rosa", "Sofia", "Vera"),
    ("m", "latin"): ("Adam", "Bruno", "Carl", "Daniel", "Erik", "Felix", "Hugo", "Jonas", "Karl", "Leo", "Martin", "Oscar", "Paul", "Simon", "Thomas", "Victor"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Светлана"),
    ("m", "cyrillic"): ("Андрей", "Борис", "Виктор", "Дмитрий", "Иван", "Максим", "Николай", "Олег", "Павел", "Сергей"),
}
SYLLABLES = {"latin": ("ba", "den", "fel", "gar", "hol", "kin", "lam", "mor", "nev", "pol", "ran", "sel", "tor", "van", "wel", "zan"), "cyrillic": ("ба", "вол", "гор", "дан", "зор", "кин", "лев", "мар", "нов", "пет", "рад", "сол", "тар", "фед", "хор", "чер")}
ACCENTED, CYRILLIC = "àâäáçéèêëíîïñóôöòùúûü", "абвгдежзиклмнопрстуфхцчшщыэюя"

_words = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_before = rf"(?:(?:{'|'.join(PARTICLES)}) )*+"
_word = r"(?:\p{Lu}\.|\p{Lu}\p{L}*+(?:['’-]\p{L}++)*+)"
#: Kinds and their patterns, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)++",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "name": rf"(?<!\p{{L}})(?:{_words})\.? {_before}{_word}(?: {_before}{_word})*+",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: The setting that holds the key, and the key of tests.
KEY_SETTING, TEST_KEY = "spark.notalith.piiKey", "for tests alone"
#: Between the parts of a message or key.
SEP = "\u0001"
#: Rows of redrawn entities that may be broadcast; more are joined by shuffling.
FEW = 50_000
#: Draws after which a round that settles no entity is an error; rounds that settle some go on.
DRAWS = 12


def hinted(text: Column) -> Column:
    """Whether a text has what every entity has: an at sign, two digits close by, or a title. Finding a byte string is cheaper than any pattern."""
    out = F.contains(text, F.lit("@")) | text.rlike("[0-9][ .()-]{0,2}[0-9]")
    for titles in TITLES.values():
        for t in titles:
            out = out | F.contains(text, F.lit(t))
    return F.coalesce(out, F.lit(False))


def kind_of(mention: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in KINDS if k != "name"]):
        out = F.when(mention.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def canonical(kind: Column, mention: Column) -> Column:
    """What mentions of one entity share: letters and digits of numbers, lower case of addresses, words of names."""
    digits = F.regexp_replace(mention, r"[^\p{L}\p{N}]", "")
    return F.when(kind == "email", F.lower(mention)).when(kind == "name", F.regexp_replace(mention, r"\.(?= |$)", "")).when(kind == "ip", mention).otherwise(digits)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value stands in the plan once and is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hmac(message: Column, key: str) -> Column:
    """HMAC-SHA512 of a text, in hexadecimal."""
    k = key.encode()
    k = (hashlib.sha512(k).digest() if len(k) > 128 else k).ljust(128, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in k)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 512))), 512)


def stream(kind: Column, canon: Column, draw: Column, key: str) -> Column:
    """512 hexadecimal digits that nothing but the key and the entity decides."""
    blocks = F.array(*[F.lit(str(i)) for i in range(4)])
    return F.array_join(F.transform(blocks, lambda i: hmac(F.concat_ws(SEP, i, kind, draw.cast("string"), canon), key)), "")


def drawn(hexed: Column, i: Column) -> Column:
    """The i-th number below 65536 of a stream."""
    return F.conv(F.substr(hexed, (i * 4) % F.lit(509) + 1, F.lit(4)), 16, 10).cast("int")


def pick(choices: str, at: Column) -> Column:
    return F.substr(F.lit(choices), F.pmod(at, F.lit(len(choices))) + 1, F.lit(1))


def like(c: Column, at: Column) -> Column:
    """A character of the class of c."""
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (F.when(c.rlike("[0-9]"), pick("0123456789", at)).when(c.rlike("[a-z]"), pick(low, at)).when(c.rlike("[A-Z]"), pick(up, at))
            .when(c.rlike(r"[а-яё]"), pick(CYRILLIC, at)).when(c.rlike(r"[А-ЯЁ]"), pick(CYRILLIC.upper(), at))
            .when(c.rlike(r"\p{Lu}"), pick(ACCENTED.upper(), at)).when(c.rlike(r"\p{Ll}"), pick(ACCENTED, at)).otherwise(c))


def reletter(text: Column, hexed: Column) -> Column:
    return bound(hexed, lambda h: F.array_join(F.transform(F.split(text, ""), lambda c, i: like(c, drawn(h, i))), ""))


def luhn(digits: Column) -> Column:
    """The sum that a valid card number has divisible by ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def iban_rest(iban: Column) -> Column:
    """The rest modulo 97 that is 1 for a valid IBAN."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: step(a, c).cast("int"))


def chosen(names: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), F.pmod(at, F.lit(len(names))) + 1)


def surname(word: Column, draw: Column, key: str) -> Column:
    """For each part of a family's name one of syllables of its script; a syllable more each draw, so there are always more than families in the end."""

    def one(part: Column) -> Column:
        made = lambda h, s: F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), draw + 3), lambda n: chosen(SYLLABLES[s], drawn(h, n))), ""))
        return bound(stream(F.lit("family"), part, draw, key), lambda h: F.when(part.rlike("[а-яё]"), made(h, "cyrillic")).otherwise(made(h, "latin")))

    return F.array_join(F.transform(F.split(word, "-"), one), "-")


def family_of(name: Column) -> Column:
    return F.regexp_extract(name, r"[^ ]+$", 0)


def named(canon: Column, draw: Column, family: Column, key: str) -> Column:
    """The name with title and particles as they are, other given names, and the surname given for its family."""
    words = F.split(canon, " ")
    title, last = F.element_at(words, 1), F.size(words) - 1

    def given(word: Column, h: Column) -> Column:
        at = drawn(h, F.lit(0))
        female = F.when(title.isin(*TITLES["f"]), True).when(title.isin(*TITLES["m"]), False).otherwise(drawn(h, F.lit(1)) % 2 == 0)
        pick_ = lambda s, n: F.when(female, chosen(GIVEN["f", s], n)).otherwise(chosen(GIVEN["m", s], n))
        # a later draw has a second name by a hyphen, and so on, so that given names never run out
        more = lambda s: F.concat_ws("-", pick_(s, at), F.array_join(F.transform(F.when(draw > 0, F.sequence(F.lit(2), draw + 1)).otherwise(F.expr("cast(array() as array<int>)")), lambda n: pick_(s, drawn(h, n))), "-"))
        full = lambda s: F.when(draw > 0, more(s)).otherwise(pick_(s, at))
        return F.when(word.rlike("[а-яё]"), full("cyrillic")).otherwise(full("latin"))

    initial = lambda w: bound(drawn(stream(F.lit("initial"), w, draw, key), F.lit(0)), lambda at: like(w, at))
    other = lambda w: bound(stream(F.lit("given"), w, draw, key), lambda h: given(w, h))
    part = lambda w, i: F.when((i == 0) | w.isin(*PARTICLES), w).when(i == last, family).when(F.char_length(w) == 1, initial(w)).otherwise(other(w))
    return F.array_join(F.transform(words, part), " ")


def replacement(kind: Column, canon: Column, draw: Column, key: str) -> Column:
    """The canonical form of what stands for canon; of a name's family its surname (names themselves: named)."""
    at = F.instr(canon, "@")
    domain = F.substr(canon, at + 1)
    top = F.regexp_extract(domain, r"\.[^.]+$", 0)
    head = F.regexp_replace(domain, r"\.[^.]+$", "")

    def email(h: Column) -> Column:
        return F.concat(reletter(F.substr(canon, F.lit(1), at - 1), h), F.lit("@"), reletter(head, stream(F.lit("domain"), domain, F.lit(0), key)), top)

    def ip(h: Column) -> Column:
        return F.array_join(F.transform(F.split(canon, r"\."), lambda o, i: (drawn(h, i) % 254 + 1).cast("string")), ".")

    def card(new: Column) -> Column:
        whole = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(new, F.lit(2)))
        short = F.substr(whole, F.lit(1), F.char_length(whole) - 1)
        check = F.pmod(F.lit(10) - luhn(F.concat(short, F.lit("0"))) % 10, F.lit(10)).cast("string")
        return F.when(luhn(canon) % 10 == 0, F.concat(short, check)).otherwise(whole)

    def iban(new: Column) -> Column:
        country, body = F.substr(canon, F.lit(1), F.lit(2)), F.substr(new, F.lit(5))
        digits = F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
        return F.concat(country, F.when(iban_rest(canon) == 1, digits).otherwise(F.substr(new, F.lit(3), F.lit(2))), body)

    def number(h: Column) -> Column:
        return bound(reletter(canon, h), lambda new: F.when(kind == "card", card(new)).when(kind == "iban", iban(new)).otherwise(new))

    own = lambda h: F.when(kind == "email", email(h)).when(kind == "ip", ip(h)).otherwise(number(h))
    return F.when(kind == "family", surname(canon, draw, key)).otherwise(bound(stream(kind, canon, draw, key), own))


def laid_out(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate's canonical form with the separators of a mention."""
    step = lambda a, c: F.when(c.rlike(r"[\p{L}\p{N}]"), F.struct((a["i"] + 1).alias("i"), F.concat(a["t"], F.substr(surrogate, a["i"] + 1, F.lit(1))).alias("t"))).otherwise(F.struct(a["i"].alias("i"), F.concat(a["t"], c).alias("t")))
    numbers = F.aggregate(F.split(mention, ""), F.struct(F.lit(0).alias("i"), F.lit("").alias("t")), step, lambda a: a["t"])
    # words of a name keep the full stops of the mention's
    stops = lambda w, m: F.when(m.endswith("."), F.concat(w, F.lit("."))).otherwise(w)
    name = F.array_join(F.zip_with(F.split(surrogate, " "), F.split(mention, " "), stops), " ")
    return F.when(kind.isin("email", "ip"), surrogate).when(kind == "name", name).otherwise(numbers)


def found(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with gaps and hits (arrays of text and of kind, mention and canon), null where nothing is found."""
    text, has = F.col("text"), hinted(F.col("text"))
    hits = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    df = docs.withColumn("raw", F.when(has, hits)).withColumn("gaps", F.when(F.size("raw") > 0, F.split(text, ANY, -1)))
    pairs = F.transform(F.when(F.size("raw") > 0, F.col("raw")), lambda m: F.struct(kind_of(m).alias("kind"), m.alias("mention")))
    return df.withColumn("pairs", pairs).withColumn("hits", F.transform("pairs", lambda p: F.struct(p["kind"].alias("kind"), p["mention"].alias("mention"), canonical(p["kind"], p["mention"]).alias("canon")))).drop("raw", "pairs")


def settled(entities: DataFrame, make: Callable[[Column], Column], draws: int) -> DataFrame | None:
    """(kind, canon, surrogate) of the entities(kind, canon, ...) that cannot keep their first draw, or None; make(draw) is a column of surrogates."""
    new = entities.withColumn("surrogate", make(F.lit(0))).persist(StorageLevel.DISK_ONLY)
    parts = parts_for(new.count())
    known = new.select("kind", F.col("canon").alias("surrogate"))

    def losers(held: DataFrame, fresh: DataFrame) -> DataFrame:
        """Of fresh, those that meet another one, a held one or an entity; the smallest of equals stays if it meets only equals."""
        same = fresh.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("canon").alias("first")).where("n > 1")
        a = fresh.join(same, ["kind", "surrogate"]).where("canon <> first").select("kind", "canon")
        b = fresh.join(held.select("kind", "surrogate").unionByName(known), ["kind", "surrogate"], "left_semi").select("kind", "canon")
        return a.unionByName(b).distinct()

    lost = losers(new.limit(0), new).persist(StorageLevel.DISK_ONLY)
    if not lost.take(1):
        lost.unpersist()
        new.unpersist()
        return None
    held, out, before = new.join(lost, ["kind", "canon"], "left_anti"), None, None
    for draw in count(1):
        if draw > draws and lost.count() == before.count() and not lost.join(before, ["kind", "canon"], "left_anti").take(1):
            raise ValueError(f"entities are left that have no free surrogate after {draw} draws: the forms of their kind and length are used up")
        before = lost
        fresh = written(entities.join(lost, ["kind", "canon"], "left_semi").withColumn("surrogate", make(F.lit(draw))), f"draw-{draw}", parts)
        lost = written(losers(held, fresh), "meeting", parts)
        good = fresh.join(lost, ["kind", "canon"], "left_anti").select("kind", "canon", "surrogate")
        out = good if out is None else out.unionByName(good)
        if not lost.take(1):
            break
        held = written(held.select("kind", "canon", "surrogate").unionByName(good), "settled", parts)
    out = written(out, "redrawn", parts)
    new.unpersist()
    return out


def redrawn(docs: DataFrame, key: str, draws: int = DRAWS) -> DataFrame | None:
    """(kind, canon, surrogate) of the entities, families among them, that cannot keep their first draw, or None."""
    one = found(docs.select("text")).select(F.explode("hits").alias("h")).select("h.kind", "h.canon").distinct().persist(StorageLevel.DISK_ONLY)
    names = one.where("kind = 'name'")
    families = names.select(F.lit("family").alias("kind"), family_of(F.col("canon")).alias("canon")).distinct()
    first = settled(one.where("kind <> 'name'").unionByName(families), lambda draw: replacement(F.col("kind"), F.col("canon"), draw, key), draws)
    out = first
    if names.take(1):
        own = names.withColumn("last", family_of(F.col("canon")))
        if first is not None:
            own = own.join(first.where("kind = 'family'").select(F.col("canon").alias("last"), F.col("surrogate").alias("family")), "last", "left")
        else:
            own = own.withColumn("family", F.lit(None).cast("string"))
        own = own.select("kind", "canon", F.coalesce("family", surname(F.col("last"), F.lit(0), key)).alias("family"))
        second = settled(own, lambda draw: named(F.col("canon"), draw, F.col("family"), key), draws)
        out = first if second is None else second if first is None else first.unionByName(second)
    one.unpersist()
    return out


def surrogates(docs: DataFrame, key: str | None = None) -> DataFrame:
    """row (all columns of docs), text (with surrogates) and hits (the entities found, with kind, mention and canon).

    Where entities were redrawn, texts that may have any meet their redrawn ones by a join; all
    other texts pass by it.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, TEST_KEY)
    fixed = redrawn(docs, key)
    rows = docs.select(F.struct("*").alias("row"), "text", F.xxhash64("doc_id", "text").alias("id"))
    if fixed is None:
        return filled(found(rows), None, key)
    may = hinted(F.col("text"))
    df = found(rows.where(may))
    each = df.select("id", F.explode("hits").alias("h")).select("id", F.col("h.kind").alias("kind"), F.col("h.canon").alias("canon"))
    pairs = each.unionByName(each.where("kind = 'name'").select("id", F.lit("family").alias("kind"), family_of(F.col("canon")).alias("canon"))).distinct()
    few = fixed.limit(FEW + 1).count() <= FEW
    maps = pairs.join(F.broadcast(fixed) if few else fixed, ["kind", "canon"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(SEP, "kind", "canon"), "surrogate"))).alias("map"))
    out = filled(df.join(maps, "id", "left"), F.col("map"), key)
    return out.unionByName(rows.where(~may).select("row", "text", F.lit(None).cast(out.schema["hits"].dataType).alias("hits")))


def filled(df: DataFrame, map_: Column | None, key: str) -> DataFrame:
    """found() rows with what stands for each mention, by the map of redrawn ones or by the first draw, in its place."""
    redrawn_ = lambda kind, canon: map_[F.concat_ws(SEP, kind, canon)] if map_ is not None else F.lit(None).cast("string")
    zero = F.lit(0)

    def new(h: Column) -> Column:
        last = family_of(h["canon"])
        name = named(h["canon"], zero, F.coalesce(redrawn_(F.lit("family"), last), surname(last, zero, key)), key)
        return F.coalesce(redrawn_(h["kind"], h["canon"]), F.when(h["kind"] == "name", name).otherwise(replacement(h["kind"], h["canon"], zero, key)))

    drawn_ = F.transform("hits", lambda h: F.struct(h["kind"].alias("kind"), h["mention"].alias("mention"), new(h).alias("s")))
    df = df.withColumn("new", drawn_).withColumn("new", F.transform("new", lambda x: laid_out(x["kind"], x["mention"], x["s"])))
    parts = F.zip_with("gaps", "new", lambda g, x: F.concat(g, F.coalesce(x, F.lit(""))))
    return df.select("row", F.when(F.col("gaps").isNotNull(), F.array_join(parts, "")).otherwise(F.col("text")).alias("text"), "hits")


def replace(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with surrogates in its texts."""
    return surrogates(docs, key).select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_entities, a count of each kind, and the text with surrogates in place."""
    df = surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("hits", lambda h: h["kind"] == k))
    return df.select("row.doc_id", F.greatest(F.size("hits"), F.lit(0)).cast("long").alias("n_entities"), *[F.greatest(count(k), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], "text")
