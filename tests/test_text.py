from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assetloom.functions import text
from assetloom.operators.cleaning import default_description, sanitize

CASES = [
    ("  Hello   World  ", "Hello World"),
    ("Happy 🚀 Day! ✨", "Happy Day!"),
    ("wide　space", "wide space"),
    ("test_🚀_func", "test_func"),
    ("a  _b__c", "a _b_c"),
    ("\x1c　 x\t\n", "x"),
    ("keep ️", "keep ️"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("raw, clean", CASES)
def test_clean_text(spark, raw, clean):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.clean_text(F.col("t"))).first()[0] == clean


def test_clean_code_keeps_layout(spark):
    df = spark.createDataFrame([("# 🚀 Rocket command",), ("a　=  1__2 ",), (None,)], "t string")
    got = [r[0] for r in df.select(text.clean_code(F.col("t"))).collect()]
    assert got == ["#  Rocket command", "a =  1__2 ", ""]


def test_sanitize_drops_empty_tags(spark):
    schema = "name string, code string, description string, tags array<string>"
    rows = [("test_🚀_func", "x = 1", " d ", ["ai", "🚀"]), ("", "", "", []), ("n", "c", "d", None)]
    got = sanitize(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in got] == [
        ("test_func", "x = 1", "d", ["ai"]),
        ("", "", "", []),
        ("n", "c", "d", []),
    ]


def test_default_description(spark):
    df = spark.createDataFrame([(" \t",), (None,), ("kept",)], "d string")
    got = [r[0] for r in df.select(default_description(F.col("d"), "2024-02-01 10:11:12")).collect()]
    draft = "Draft automatically saved by AI on 2024-02-01 10:11:12"
    assert got == [draft, draft, "kept"]


def test_strip_equals_python(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0     　ab​"), min_size=300, max_size=400))
    def check(values):
        df = spark.createDataFrame([(v,) for v in values], "t string")
        assert [r[0] for r in df.select(text.strip(F.col("t"))).collect()] == [v.strip() for v in values]

    check()


def test_list_literal_prints_like_python(spark):
    values = [[], ["a"], ["a", "b c"], ["back\\slash"]]
    df = spark.createDataFrame([(v,) for v in values], "t array<string>")
    assert [r[0] for r in df.select(text.list_literal(F.col("t"))).collect()] == [str(v) for v in values]
