"""Importance resampling against a plain version, whatever the head holds."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from assetloom.llm import importance
from tests.llm import brute

DOCS = "doc_id long, text string, score string, rank string, drawn_id int, `all` int"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 1, 2) for d, t in rows], DOCS)


def some_rows():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeé9") for _ in range(rng.randint(1, 6))) for _ in range(80)] + ["日本語" * 30, "Long" * 40]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "\x7f"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 70))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "One"), (903, "one TWO"), (None, text(40)), (None, text(40)), (904, rows[3][1]), (3, rows[3][1])]
    return rows, [text(30) for _ in range(5)] + [None, ""]


@pytest.mark.parametrize(("head", "paired"), [(8192, 1024), (20, 5), (0, 0)])
def test_equals_plain_version(spark, monkeypatch, head, paired):
    monkeypatch.setattr(importance, "HEAD", head)
    monkeypatch.setattr(importance, "PAIRED", paired)
    monkeypatch.setattr(importance, "frequent_words", lambda docs, found=importance.frequent_words: found(docs) if head else [])
    rows, target = some_rows()
    out = importance.resample(documents(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"))
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()), key=str)
    # Scores that are equal without an id may be ranked either way.
    assert got == sorted(brute.resampled(rows, target), key=str)
    assert any(r[4] for r in got)


def test_drawn_rows_keep_their_columns(spark):
    rows, target = some_rows()
    target = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.drawn(documents(spark, rows), target, percent=50)
    ranked = importance.resample(documents(spark, rows), target, percent=50).where("rank IS NOT NULL").count()
    assert out.columns == documents(spark, rows).columns and out.count() >= ranked > 0


def test_empty_tables(spark):
    none = documents(spark, [])
    assert importance.resample(none, none).count() == 0 and importance.drawn(none, none).count() == 0
    rows = importance.resample(documents(spark, [(1, "a b " * 30)]), none).collect()
    assert [(r.doc_id, r.n_words, r["rank"]) for r in rows] == [(1, 60, None)]


def test_states_go_on_as_direct_hashes_do():
    rng = random.Random(1)
    words = [bytes(rng.randrange(97, 120) for _ in range(rng.choice([1, 2, 5, 63, 64, 65, 300]))) for _ in range(60)]
    head = importance.Head.of(words[::2])
    work = importance._Work(words, [(0, len(words), 0)])
    for run, (at, buckets) in enumerate(importance.feature_buckets(work, head), 1):
        direct = [zlib.crc32(b" ".join(words[i - run + 1 : i + 1])) % importance.BUCKETS for i in at]
        assert np.array_equal(buckets, direct) and len(at) == len(words) - run + 1


def test_parts_share_their_bordering_words(monkeypatch):
    rows, _ = some_rows()
    texts = [(t or "").encode() for _, t in rows]
    head = importance.Head.of([b"a", b"b", b"c"])
    found = []
    for piece in (1 << 20, 1, 7, 40):
        monkeypatch.setattr(importance, "PIECE", piece)
        total = np.zeros(importance.BUCKETS, np.int64)
        for work in importance._blocks(texts):
            for _, buckets in importance.feature_buckets(work, head):
                total += np.bincount(buckets, minlength=importance.BUCKETS)
        found.append(total)
    assert found[0].sum() == sum(len(brute.n_grams(t)) for _, t in rows)
    assert all(np.array_equal(found[0], f) for f in found)


def test_long_text_in_parts(spark):
    text = ("alpha Beta gamma, delta " * 90_000) + "end"
    rows = [(1, text), (2, "x" * 3_000_000)]
    out = importance.resample(documents(spark, rows), spark.createDataFrame([("beta gamma",)], "text string")).collect()
    assert {r.doc_id: (r.n_features, r.weight, r.score) for r in out} == {r[0]: r[1:4] for r in brute.resampled(rows, ["beta gamma"])}
