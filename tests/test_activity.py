from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assetloom.operators import activity

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    texts = ["Find x", "find x", " find x", "rare", "other", "Other "]
    rows = []
    for i in range(600):
        text = "find x" if rng.random() < 0.4 else rng.choice(texts)  # one hot text
        rows.append((i, START + timedelta(seconds=rng.randint(0, 300)), text))
    rows += [(600, START, "once"), (601, START, "twice"), (602, START, "Twice")]
    return rows, spark.createDataFrame(rows, "req_id long, ts timestamp_ntz, query string")


def _replay(rows, threshold):
    """The cache protocol request by request; every request counts towards popularity."""
    counts, cached, hits = Counter(), set(), {}
    for req_id, _, query in sorted(rows, key=lambda r: (r[1], r[0])):
        hits[req_id] = query in cached
        counts[query.lower().strip()] += 1
        if counts[query.lower().strip()] >= threshold:
            cached.add(query)
    return hits, cached


@pytest.mark.parametrize("threshold", [1, 3, 50])
def test_cache_hits_equal_replay(log, threshold):
    rows, df = log
    hits, cached = _replay(rows, threshold)
    assert {r["req_id"]: r["hit"] for r in activity.cache_hits(df, threshold).collect()} == hits
    stats = activity.cache_stats(df, threshold).first()
    total = sum(hits.values())
    assert stats["cache_size"] == len(cached) and stats["hit_count"] == total
    assert stats["miss_count"] == len(rows) - total and stats["hit_rate"] == f"{100 * total / len(rows):.2f}%"
    assert stats["total_queries"] == len({q.lower().strip() for _, _, q in rows})


def test_empty_log_has_zero_rate(log):
    stats = activity.cache_stats(log[1].limit(0)).first()
    assert (stats["hit_count"], stats["hit_rate"], stats["total_queries"]) == (0, "0.00%", 0)


def test_popular_queries(log):
    rows, df = log
    counts = Counter(q.lower().strip() for _, _, q in rows)
    got = {r["query"]: r["frequency"] for r in activity.popular_queries(df).collect()}
    assert got == {q: n for q, n in counts.items() if n >= 3}


def _sessions(rows, gap):
    out = []
    for user in {u for u, _ in rows}:
        times = sorted(t for u, t in rows if u == user)
        current = [times[0]]
        for t in times[1:]:
            if t - current[-1] > gap:
                out.append((user, current[0], current[-1] + gap, len(current)))
                current = []
            current.append(t)
        out.append((user, current[0], current[-1] + gap, len(current)))
    return sorted(out)


def test_sessions_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 2, 3]), START + timedelta(seconds=rng.randint(0, 40_000))) for _ in range(500)]
    # Neighbours exactly one gap apart share a session, as with the built-in window.
    rows += [(7, START), (7, START + timedelta(seconds=600)), (7, START + timedelta(seconds=1201))]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz")
    got = sorted(map(tuple, activity.activity_sessions(df, 600).select("user_id", "session_start", "session_end", "events").collect()))
    assert got == _sessions(rows, timedelta(seconds=600))
    built_in = df.groupBy("user_id", F.session_window("ts", "600 seconds").alias("s")).count()
    assert built_in.count() == len(got)


def test_usage_delta(spark):
    rows = [("a", START), ("a", START + timedelta(hours=1)), ("b", START)]
    df = spark.createDataFrame(rows, "name string, ts timestamp_ntz")
    got = {r["name"]: (r["calls"], r["last_ts"]) for r in activity.usage_delta(df).collect()}
    assert got == {"a": (2, START + timedelta(hours=1)), "b": (1, START)}


def test_rate_flags(spark):
    rows = [(1, START + timedelta(seconds=i)) for i in range(15)] + [(2, START + timedelta(seconds=50 * i)) for i in range(15)]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz")
    flagged = activity.rate_limit_flags(df, "1 minute", 10).collect()
    assert [(r["user_id"], r["calls"]) for r in flagged] == [(1, 15)]
