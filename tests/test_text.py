from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notalith.functions.text import edit_distance, glob_pattern, osa, similarity_limit, snippet, tokenize, trimmed


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("a", "b", "d"), [("search", "serach", 1), ("search", "seach", 1), ("search", "searchs", 1), ("ca", "abc", 3), ("", "ab", 2), ("same", "same", 0)])
def test_osa(a, b, d):
    assert osa(a, b) == d


@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_osa_is_a_distance_of_words(a, b):
    assert osa(a, b) == osa(b, a)
    assert (osa(a, b) == 0) == (a == b)
    assert abs(len(a) - len(b)) <= osa(a, b) <= max(len(a), len(b))
    assert min(osa(a, b, 1), 2) == min(osa(a, b), 2)


def test_tokenize(spark):
    assert one(spark, tokenize(F.col("t")), t="The C# and c++ in V8, go! не код I/O x") == ["c#", "c++", "v8", "go", "код"]
    assert one(spark, tokenize(F.lit(None).cast("string"))) == []


def test_snippet_and_trim(spark):
    assert one(spark, snippet(F.col("t"), 5), t="a \n  b\tc") == "a b c"
    assert one(spark, trimmed(F.col("t")), t="  x y  ") == "x y"


def test_limits(spark):
    df = spark.createDataFrame([("ab",), ("abc",), ("abcdefgh",)], "t string")
    assert [r[0] for r in df.select(similarity_limit(F.col("t"))).collect()] == [0, 1, 2]
    assert spark.createDataFrame([("architecure", "architecture")], "a string, b string").select(edit_distance("a", "b")).first()[0] == 1


def test_globs():
    import re

    assert re.match(glob_pattern("notes/*.md"), "Notes/a.MD")
    assert not re.match(glob_pattern("notes/*.md"), "notes/x/a.md")
    assert re.match(glob_pattern("**/a.md"), "x/y/a.md")
    with pytest.raises(ValueError):
        glob_pattern("a|b")
