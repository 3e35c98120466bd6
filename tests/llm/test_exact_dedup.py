"""Exact dedup against a plain version; the perfect hash, growth of an index, odd rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from assetloom.llm import exact_dedup
from tests.llm import brute

DOCS = "doc_id long, text string, keep_id string, kept string, place int, kept_id int"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 1, 2) for d, t in rows], DOCS)


def some_rows():
    rng = random.Random(2)
    rows = [(i, rng.choice(["a b c", "ab  c", "x", "same text here"]) if i % 3 else f"text {i % 70} of{' ' * (i % 4)} it") for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, " "), (None, "same text here"), (None, "lone"), (None, "lone"), (404, "lone 2")]
    rows += [(405, "twice"), (405, "twice"), (406, "A"), (407, "a"), (9, "other text of id nine"), (408, "long " * 300_000), (409, "long" * 300_000)]
    return rows


@pytest.mark.parametrize(("slots", "piece"), [(1 << 15, 1 << 17), (4, 10)])
def test_equals_plain_version(spark, monkeypatch, slots, piece):
    monkeypatch.setattr(exact_dedup, "SHARD_SLOTS", slots)
    monkeypatch.setattr(exact_dedup, "PIECE_ROWS", piece)
    rows = some_rows()
    got = exact_dedup.duplicates(documents(spark, rows)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got], key=str) == sorted(brute.exact_groups(rows), key=str)
    bare = {hashlib.sha256("".join((t or "").translate({ord(c): None for c in brute.BLANKS})).encode()).digest() for _, t in rows}
    assert {bytes(r.digest) for r in got} == bare


def test_keeps_one_of_each_group(spark):
    rows = some_rows()
    kept = exact_dedup.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    stay = [(d, t) for (d, t), r in zip(rows, brute.exact_groups(rows), strict=True) if r[3]]
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted(stay, key=str)
    assert exact_dedup.keep_one(documents(spark, [])).count() == 0
    assert exact_dedup.duplicates(documents(spark, [])).count() == 0


def test_index_grows_by_instalments(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_SLOTS", 8)
    rows = exact_dedup.text_rows(documents(spark, some_rows()))
    index = exact_dedup.Index.empty(spark)
    for part in range(3):
        index = index.with_rows(rows.where(f"pmod(place, 3) = {part}"))
    assert index.depth > 2 and index.shards.count() > 4
    entries = {bytes(r.digest): r.n for r in index.entries().collect()}
    counts = {bytes(r.digest): r["count"] for r in rows.groupBy("digest").count().collect()}
    assert entries == counts
    unseen = exact_dedup.text_rows(documents(spark, [(1, "never seen before"), (2, "same  text here")]))
    met = {r.doc_id: r.slot_n for r in index.look_up(unseen).collect()}
    assert met[1] is None and met[2] == counts[hashlib.sha256(b"sametexthere").digest()]


def test_perfect_hash_is_minimal_and_bytes_decide():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    words = exact_dedup.as_words(pa.array(digests))
    made, bits = exact_dedup.PerfectHash.build(words)
    again = exact_dedup.PerfectHash(made.sizes, bits)
    assert sorted(again.slots(words)) == list(range(5000)) and len(bits) < 5000
    [row] = exact_dedup._shard_rows(words, {c: pa.array(np.arange(5000)) for c in exact_dedup._SLOT}, 0)
    shard = exact_dedup._Shard(pa.Table.from_batches([row]))
    others = exact_dedup.as_words(pa.array([hashlib.sha256(f"x{i}".encode()).digest() for i in range(5000)]))
    assert (again.slots(others) >= 0).any() and (shard.find(others) < 0).all()
    assert np.array_equal(shard.values["n"].take(pa.array(shard.find(words))).to_numpy(), np.arange(5000))
