"""Fill-in-the-middle against a plain version; marks, odd rows, long texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from assetloom.llm import fill_middle
from tests.llm import brute

DOCS = "doc_id long, text string, fim string, fim_n int, fim_text int, output string"


def transformed(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1, 2, "y") for d, t in rows], DOCS)
    out = fill_middle.fill_in_middle(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    return out.select("doc_id", "text", "fim.*", fill_middle.restored(F.col("fim.output"), F.col("fim.form")).alias("again")).collect()


@pytest.mark.parametrize("block", [1000, 3])
def test_equals_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    rng = random.Random(4)
    parts = ["ab", "C", " ", "\n", "<", "<P", ">", "S>", "<M", "é", "\U0001f600", "\U0001d4d0", "$1", "\\", "\r\n", "\x00", "0", "{2}+"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(500, None), (501, ""), (None, "no id here at all"), (502, "a<P>b"), (503, "<M>"), (504, "x"), (504, "x")]
    for r in transformed(spark, rows):
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute.filled_in_middle(r.doc_id, r.text)
        assert r.again == (r.text or "")
    assert len({brute.filled_in_middle(*row)[1] for row in rows}) == 3


def test_very_long_texts(spark):
    rows = [(d, t) for d in (1, 2, 3) for t in ("a" * 2_000_000, "a b" * 400_000, "\U0001f600" * 300_000)]
    for r in transformed(spark, rows):
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute.filled_in_middle(r.doc_id, r.text)


def test_empty_table_and_no_python(spark):
    assert transformed(spark, []) == []
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = fill_middle.fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
