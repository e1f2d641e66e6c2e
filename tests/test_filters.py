from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from notalith.operators.filters import FilterError, Parser, candidates, compile_filter, parse_filter, tokens
from notalith.schemas import META
from notalith.sources.markdown import parse_frontmatter


@pytest.fixture(scope="module")
def notes(spark):
    a = parse_frontmatter("tags: [engineering, backend]\nstatus: active\npriority: 3\ncreated: 2026-05-01\nlabels: [x, y]\nlevel: '2'")
    b = parse_frontmatter("status: archived\ncanonical: false")
    return spark.createDataFrame([("notes/a.md", "Alpha", a), ("b.md", "Beta", b)], f"file string, title string, meta {META}")


def test_tokens():
    got = tokens('tag:engineering AND (status != "archived" OR priority >= 2)')
    assert len(got) == 13 and '"archived"' in got
    assert tokens(r'a = "x \" y"') == ["a", "=", '"x " y"']


@pytest.mark.parametrize(("expression", "expected"), [
    ("tag:engineering", True), ("tag:frontend", False), ("tag:backend AND status:active", True), ("tag:frontend OR priority >= 3", True), ("NOT tag:draft", True), ("priority > 3", False),
    ("date >= 2026-01-01", True), ("date < 2026-01-01", False), ("tag != engineering", False), ("missing != 1", True), ("missing:1", False), ("status:2", False), ("status != 2", False), ("level:2", True), ("level != 2", False),
    ("labels:X", True), ("labels != z", True), ("NOT NOT tag:backend", True), ("file contains NOTES", True), ("title = alpha", True), ("status:act", True), ("status = act", False), ("engineering", False), ("tag:engineering status:active", True),
])
def test_evaluation(notes, expression, expected):
    assert bool(notes.where("file = 'notes/a.md'").where(compile_filter(expression)).count()) == expected


@pytest.mark.parametrize("bad", ["", "(a:b", "a:", "a:b )", "a = )", ">= 3"])
def test_errors(notes, bad):
    with pytest.raises(FilterError):
        parse_filter(bad)
    assert notes.where(compile_filter(bad, strict=False)).count() == 0


@given(st.text(max_size=40))
def test_any_text_parses_or_is_refused(text):
    try:
        Parser(text).parse()
    except FilterError:
        pass


def test_two_values(notes):
    for e in ("priority > 2", "owner:x", "canonical:true", "date >= 2026-01-01"):
        assert notes.where(compile_filter(e)).count() + notes.where(compile_filter(f"NOT ({e})")).count() == 2


def test_candidates(notes):
    assert [r.file for r in notes.where(candidates(globs=["notes/*", "zzz"], tags="#Backend", custom={"priority": 3})).collect()] == ["notes/a.md"]
    assert notes.where(candidates(custom={"priority": "3"})).count() == 0
    assert [r.file for r in notes.where(candidates(canonical_only=True)).collect()] == ["notes/a.md"]
