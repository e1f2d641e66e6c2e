"""Text functions as Column expressions; none leaves the JVM but the edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..schemas import SNIPPET

#: Words that are no terms.
STOP = (
    "the and for are was has with this that from not but you your can all any its of to in on it is at by be we us he as or an do so no if up my me am "
    "все как что это при для или был без над под так его нет есть по от из на за во со не ни же ли бы уж мы вы он то но до ко"
).split()
TERM = r"[\p{L}\p{N}][\p{L}\p{N}#+-]*"


def tokenize(text: Column) -> Column:
    """Terms of a text in order, lower-cased, of two characters or more, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)), lambda t: (F.char_length(t) > 1) & ~t.isin(*STOP))


def trimmed(text: Column) -> Column:
    """Without white space at the ends, Unicode's too."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalised(text: Column) -> Column:
    """Line ends as LF, trimmed."""
    return trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"))


def snippet(text: Column, size: int = SNIPPET) -> Column:
    return F.substring(F.regexp_replace(text, r"(?U)\s+", " "), 1, size)


def rounded(score: Column, digits: int) -> Column:
    return F.round(score, digits)


def similarity_limit(term: Column) -> Column:
    """Edits that a query term may be away."""
    return F.least(F.lit(2), F.floor(F.char_length(term) / 3)).cast("int")


def matching_terms(query: Column, terms: Column) -> Column:
    """The query's terms that occur, in the query's order, each once."""
    return F.array_intersect(F.array_distinct(query), terms)


def osa(a: str, b: str, most: int | None = None) -> int:
    """Edits between two words, a swap of neighbours counting as one and no place edited twice."""
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        if most is not None and min(row) > most and min(one) > most:
            return most + 1
        two, one = one, row
    return one[-1]


@F.pandas_udf(IntegerType())
def edit_distance(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """osa() on columns; meant for distinct pairs that a length band has let through."""
    for a, b in pairs:
        yield pd.Series([osa(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ** is anything, * anything within a folder; case does not count.

    A question mark stays a quantifier of what stands before it.
    """
    if any(c in glob for c in "|()$\\{}"):
        raise ValueError(f"sign not allowed in a glob: {glob}")
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        c = glob[i]
        out += "[^/]*" if c == "*" else c if c == "?" else "".join("\\" + c if c in ".+^[]-&~#" else c)
        i += 1
    return f"(?i)^{out}$"
