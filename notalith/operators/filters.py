"""Predicates on chunks, and a filter language that is compiled once to a Column.

Predicates have two values: what is missing meets `!=` and nothing else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import glob_pattern

NUMBER = re.compile(r"^-?\d+(\.\d+)?$")
OPERATORS = (":", "=", "==", "!=", ">", ">=", "<", "<=")


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: str | float | bool


@dataclass(frozen=True)
class Logic:
    op: str  # and, or, not
    parts: tuple


class FilterError(ValueError):
    """The text is no filter expression."""


TOKEN = re.compile(r"""\s+|(?P<q>"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?)|(?P<op>>=|<=|!=|==|[()<>=:!])|(?P<w>[^\s():=!<>"']+)""", re.S)


def tokens(source: str) -> list[str]:
    """The words of a filter; a quoted one keeps double quotes round its unescaped text."""
    out = []
    for m in TOKEN.finditer(source):
        if m["q"] is not None:
            q = m["q"]
            body = q[1:-1] if len(q) > 1 and q[-1] == q[0] and not re.search(r"(?<!\\)(?:\\\\)*\\$", q[:-1]) else q[1:]
            out.append('"' + re.sub(r"\\(.)", r"\1", body, flags=re.S) + '"')
        elif m["op"] or m["w"]:
            out.append(m["op"] or m["w"])
    return out


class Parser:
    """OR over AND over NOT; terms side by side are ANDed."""

    def __init__(self, source: str):
        self.words, self.at = tokens(source), 0

    def peek(self, n: int = 0) -> str | None:
        return self.words[self.at + n] if self.at + n < len(self.words) else None

    def keyword(self, name: str) -> bool:
        return (self.peek() or "").lower() == name

    def take(self) -> str:
        if self.peek() is None:
            raise FilterError("the filter ends where a term is due")
        self.at += 1
        return self.words[self.at - 1]

    def parse(self):
        if not self.words:
            raise FilterError("the filter is empty")
        node = self.any()
        if self.peek() is not None:
            raise FilterError(f"unexpected: {self.peek()}")
        return node

    def any(self):
        parts = [self.all()]
        while self.keyword("or"):
            self.take()
            parts.append(self.all())
        return parts[0] if len(parts) == 1 else Logic("or", tuple(parts))

    def all(self):
        parts = [self.no()]
        while self.peek() is not None and self.peek() != ")" and not self.keyword("or"):
            if self.keyword("and"):
                self.take()
            parts.append(self.no())
        return parts[0] if len(parts) == 1 else Logic("and", tuple(parts))

    def no(self):
        if self.keyword("not") or self.peek() == "!":
            self.take()
            return Logic("not", (self.no(),))
        return self.term()

    def term(self):
        word = self.take()
        if word == "(":
            node = self.any()
            if self.peek() != ")":
                raise FilterError("a parenthesis is not closed")
            self.take()
            return node
        if word == ")" or word in OPERATORS:
            raise FilterError(f"unexpected: {word}")
        field, op, raw = word.strip('"'), ":", word
        if self.peek() in OPERATORS or self.keyword("contains"):
            op = self.take().lower()
            op = "=" if op == "==" else op
            if self.peek() is None or self.peek() == ")":
                raise FilterError(f"no value after {op}")
            raw = self.take()
        text = re.sub(r"^[\"']|[\"']$", "", raw)
        value = {"true": True, "false": False}.get(text.lower(), float(text) if NUMBER.match(text) else text)
        return Compare(field, op, value)


def parse_filter(source: str):
    return Parser(source).parse()


def plain(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return f"{value:g}" if isinstance(value, float) and value.is_integer() else str(value)


def of_list(items: Column, op: str, value) -> Column | None:
    target = plain(value).lower().removeprefix("#")
    hit = F.coalesce(F.exists(items, lambda x: F.regexp_replace(F.lower(x), "^#", "") == target), F.lit(False))
    return hit if op in (":", "contains", "=") else ~hit if op == "!=" else None


def of_scalar(text: Column, truth: Column, op: str, value) -> Column:
    """Of a value as text (null where missing) and its truth."""
    missing = F.lit(op == "!=")
    if isinstance(value, bool):
        ok = (truth != value) if op == "!=" else (truth == value)
    elif isinstance(value, float):
        n = F.when(F.trim(text) == "", F.lit(0.0)).when(F.lower(text) == "true", F.lit(1.0)).when(F.lower(text) == "false", F.lit(0.0)).otherwise(F.expr("try_cast(0 AS DOUBLE)") * 0 + text.try_cast("double"))
        n = F.when(F.isnan(n), F.lit(None)).otherwise(n)
        compare = {"=": n == value, ":": n == value, "!=": n != value, ">": n > value, ">=": n >= value, "<": n < value, "<=": n <= value}.get(op, F.lit(False))
        ok = F.coalesce(compare, F.lit(False))
    else:
        a, b = F.lower(text), value.lower()
        ok = {"=": a == b, ":": F.contains(a, F.lit(b)), "contains": F.contains(a, F.lit(b)), "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
    return F.when(text.isNull(), missing).otherwise(ok)


def column_of(node, date_from_custom: bool = True) -> Column:
    """A filter's tree as a predicate on chunks(file, title, meta)."""
    if isinstance(node, Logic):
        parts = [column_of(p, date_from_custom) for p in node.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.op == "and" else out | p
        return ~out if node.op == "not" else out
    name, meta = re.sub("[-_]", "", node.field.lower()), lambda f: F.col(f"meta.{f}")
    custom = F.get_json_object(F.concat(F.lit('{"v":'), F.col("meta.custom")[node.field], F.lit("}")), "$.v")
    if name in ("tag", "tags", "alias", "aliases"):
        items = meta("tags" if name.startswith("tag") else "aliases")
        hit = of_list(items, node.op, node.value)
        return hit if hit is not None else of_scalar(F.when(F.size(items) >= 0, F.array_join(items, ",")), F.lit(True), node.op, node.value)
    texts = {
        "file": F.col("file"), "path": F.col("file"), "title": F.coalesce(F.when(meta("title") != "", meta("title")), F.col("title")), "project": meta("project"), "type": meta("type"), "status": meta("status"),
        "canonical": meta("canonical").cast("string"), "created": meta("created"), "updated": meta("updated"),
    }
    texts["date"] = F.coalesce(meta("created"), F.get_json_object(F.concat(F.lit('{"v":'), meta("custom")["date"], F.lit("}")), "$.v")) if date_from_custom else meta("created")
    if name in texts:
        text = texts[name]
        truth = meta("canonical") if name == "canonical" else text != ""
        return of_scalar(text, truth, node.op, node.value)
    raw = meta("custom")[node.field]
    truth = ~raw.isin("false", "0", '""', "null")
    one = of_scalar(custom, truth, node.op, node.value)
    many = of_list(F.from_json(raw, "array<string>"), node.op, node.value)
    return F.when(raw.startswith("["), many).otherwise(one) if many is not None else one


def compile_filter(source: str, strict: bool = True, date_from_custom: bool = True) -> Column:
    """A predicate of a filter text; one that cannot be parsed is an error, or false for all rows if not strict."""
    try:
        return column_of(parse_filter(source), date_from_custom)
    except FilterError:
        if strict:
            raise
        return F.lit(False)


def candidates(globs=None, since=None, tags=None, project=None, type=None, status=None, canonical_only=False, custom=None, filter=None, strict=True) -> Column:  # noqa: A002
    """All predicates of a search in one: globs are ORed, everything else is ANDed."""
    out = F.lit(True)
    if globs:
        some = F.lit(False)
        for g in [globs] if isinstance(globs, str) else globs:
            some = some | F.col("file").rlike(glob_pattern(g))
        out = out & some
    if since is not None:
        out = out & F.coalesce(F.col("mtime") >= F.to_timestamp(F.lit(str(since))), F.lit(False))
    for t in [tags] if isinstance(tags, str) else tags or []:
        out = out & F.coalesce(F.array_contains("meta.tags", t.removeprefix("#").lower()), F.lit(False))
    for field, value in (("project", project), ("type", type), ("status", status)):
        if value is not None:
            out = out & F.col(f"meta.{field}").eqNullSafe(value)
    if canonical_only:
        out = out & ~F.col("meta.canonical").eqNullSafe(F.lit(False))
    for key, value in (custom or {}).items():
        import json

        out = out & F.col("meta.custom")[key].eqNullSafe(json.dumps(value, ensure_ascii=False)) if not isinstance(value, list) else F.lit(False)
    if filter:
        out = out & compile_filter(filter, strict)
    return out
