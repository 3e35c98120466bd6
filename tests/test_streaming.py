from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from assetloom import schemas
from assetloom.operators import activity, maintenance
from assetloom.operators.embeddings import latest_embeddings
from assetloom.plans import streams
from assetloom.plans.registry import Tables
from assetloom.session import shared_folder, work_path
from assetloom.sources import hub
from assetloom.streaming import jobs, sessions
from assetloom.streaming.changelog import ChangeLog
from tests.test_maintenance import AS_OF, REQUEST, by_name, functions_table, request

START = datetime(2024, 1, 1)
EVENT = "event_id long, name string, user_id int, ts timestamp_ntz"


def drop_file(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def events(spark, *rows):
    return spark.createDataFrame([(i, n, u, START + timedelta(seconds=s)) for i, n, u, s in rows], EVENT)


@pytest.fixture
def folders(spark):
    return {n: work_path(spark, f"test-{n}") for n in ("in", "out", "checkpoint", "changes", "vectors", "rejected", "failed", "base")}


def test_usage_counts_an_event_once_across_batches(spark, folders):
    first = events(spark, (1, "a", 1, 0), (2, "a", 1, 5), (2, "a", 1, 5), (3, "b", 2, 1))
    second = events(spark, (2, "a", 1, 5), (4, "a", 1, 60))
    for batch in (first, second):
        drop_file(batch, folders["in"])
        stream = jobs.file_stream(spark, folders["in"], "*.parquet", first)
        jobs.usage_stream(stream, folders["out"], folders["checkpoint"]).awaitTermination()
    got = by_name(jobs.usage_totals(spark, folders["out"]))
    unique = first.union(second).dropDuplicates(["event_id"])
    assert got == by_name(activity.usage_delta(unique).select("name", "calls", "last_ts"))


def test_sessions_close_behind_the_watermark(spark, folders):
    rows = [(1, "a", 1, 0), (2, "a", 1, 500), (3, "a", 2, 100), (4, "a", 1, 5000)]
    flush = (9, "a", 99, 1_000_000)
    drop_file(events(spark, *rows), folders["in"])
    like = events(spark, *rows)

    def run():
        stream = jobs.session_stream(jobs.file_stream(spark, folders["in"], "*.parquet", like), 600, "10 minutes")
        handle = lambda df, i: df.write.mode("overwrite").parquet(f"{folders['out']}/batch={i}")
        jobs.start(stream, handle, folders["checkpoint"]).awaitTermination()

    run()
    drop_file(events(spark, flush), folders["in"])
    run()
    late = events(spark, (10, "a", 1, 3))  # far behind the watermark: dropped
    drop_file(late, folders["in"])
    run()
    got = spark.read.parquet(folders["out"]).filter("user_id != 99").select("user_id", "session_start", "session_end", "events")
    as_ntz = got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
    expected = activity.activity_sessions(events(spark, *rows), 600).select(*got.columns)
    assert sorted(map(tuple, as_ntz.collect())) == sorted(map(tuple, expected.collect()))


def test_rate_windows(spark, folders):
    rows = [(i, "a", 1, i) for i in range(15)] + [(20 + i, "a", 2, i * 50) for i in range(5)]
    drop_file(events(spark, *rows), folders["in"])
    stream = jobs.rate_stream(jobs.file_stream(spark, folders["in"], "*.parquet", events(spark, *rows)), "1 minute", 10)
    jobs.start(stream, lambda df, i: df.write.mode("overwrite").parquet(folders["out"]), folders["checkpoint"], "complete").awaitTermination()
    got = spark.read.parquet(folders["out"]).collect()
    assert [(r["user_id"], r["calls"]) for r in got] == [(1, 15)]


@pytest.fixture
def base(spark):
    return functions_table(spark, a={"code": "x = 1", "description": "one", "status": "verified", "call_count": 4, "test_cases": "[]"})


def test_hub_stream_equals_batch_merges(spark, folders, base, tmp_path):
    log = ChangeLog.over(folders["changes"], base, parts=4)
    (tmp_path / "bad.json").write_text("{")
    files = [
        {"name": "a", "code": "x = 2", "description": "one"},
        {"name": "n", "code": "z = 1", "tags": ["t"], "quality_score": 12.5},
        {"name": "a", "code": "x = 3", "description": "one", "updated_at": "2024-03-01T00:00:00"},
    ]
    expected = base
    for i, record in enumerate(files):
        (tmp_path / f"r{i}.json").write_text(json.dumps(record, indent=1))
        records = hub.stream_hub_records(spark, str(tmp_path))
        jobs.hub_stream(
            records, log, lambda batch_id: AS_OF, folders["checkpoint"], folders["out"], folders["rejected"]
        ).awaitTermination()
        one = spark.read.schema(schemas.HUB_RECORD).option("multiLine", True).json(str(tmp_path / f"r{i}.json"))
        expected = maintenance.merge_hub(expected, one, AS_OF)
    assert by_name(log.current()) == by_name(expected)
    assert json.loads(by_name(log.current())["n"]["metadata"])["quality_score"] == 12.5
    refused = spark.read.parquet(folders["rejected"]).collect()
    assert [(r["reason"], r["file_path"].endswith("bad.json")) for r in refused] == [("unreadable", True)]
    compacted = log.compact(folders["base"])
    assert by_name(compacted.current()) == by_name(expected) and compacted.changes().count() == 0
    totals = spark.read.parquet(folders["out"]).agg(F.sum("insert"), F.sum("update"), F.sum("rejected")).first()
    assert tuple(totals) == (1, 2, 1)


def test_a_merged_batch_leaves_nothing_but_its_log(spark, folders, base, tmp_path):
    top = Path(shared_folder(spark).removeprefix("file://"), "assetloom")
    log = ChangeLog.over(folders["changes"], base, parts=4)
    records = [{"name": "a", "code": "x = 2"}, {"name": "a", "code": "x = 3", "updated_at": "2024-03-01T00:00:00"}, {"name": "n", "code": "z = 1"}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, records)))
    before = {p.name for p in top.iterdir()}
    stream = hub.stream_hub_records(spark, str(tmp_path), one_per_file=False)
    jobs.hub_stream(stream, log, lambda batch_id: AS_OF, folders["checkpoint"]).awaitTermination()
    named = {Path(f).name for f in folders.values()}
    left = [p for p in top.iterdir() if p.name not in before | named and any(f.name.startswith("part-") for f in p.rglob("*"))]
    assert left == []
    got = log.current()
    assert {n: r["code"] for n, r in by_name(got).items()} == {"a": "x = 3", "n": "z = 1"}
    assert by_name(got)["a"]["call_count"] == 4


def test_replayed_batch_changes_nothing(spark, folders, base):
    log = ChangeLog.over(folders["changes"], base, parts=4)
    changed = base.withColumn("code", F.lit("x = 9"))
    log.write(0, changed)
    once = by_name(log.current())
    log.write(0, changed)
    assert by_name(log.current()) == once and once["a"]["code"] == "x = 9"
    assert by_name(log.current(before=0))["a"]["code"] == "x = 1"


def test_save_stream(spark, folders, base):
    log = ChangeLog.over(folders["changes"], base, parts=4)
    verdicts = spark.createDataFrame([("t", "success"), ("f", "error")], "name string, status string")
    cases = '[{"input":{},"expected":1}]'
    first = request(spark, ("a", "new = 1", "d"), ("t", "k = 1", "d"), ("bad", "def (", "d")).withColumn(
        "test_cases", F.when(F.col("name") == "t", cases).otherwise("[]")
    )
    second = spark.createDataFrame([(5, "f", "k = 2", "d", ["x"], [], cases), (6, "u", "k = 3", "d", [], [], cases)], REQUEST)
    for batch in (first, second):
        drop_file(batch, folders["in"])
        stream = jobs.file_stream(spark, folders["in"], "*.parquet", first)
        out = jobs.SaveFolders(folders["vectors"], folders["rejected"], folders["failed"])
        jobs.save_stream(
            stream, log, out, verdicts, two_values, "m", 2, lambda batch_id: AS_OF, folders["checkpoint"]
        ).awaitTermination()
    rows = by_name(log.current())
    assert {n: r["status"] for n, r in rows.items()} == {
        "a": "pending_tests", "t": "verified", "bad": "broken", "f": "failed", "u": "error_internal",
    }
    assert rows["a"]["code"] == "new = 1" and rows["a"]["call_count"] == 4
    made = spark.read.parquet(folders["vectors"])
    assert {r["function_name"] for r in made.collect()} == set(rows) - {"u"}
    assert [tuple(r) for r in spark.read.parquet(folders["failed"]).select("name", "error").collect()] == [("u", "2 values wanted, got 1")]


def two_values(texts):
    return [[1.0] if "Name: u\n" in t else [1.0, 2.0] for t in texts]


def test_skipped_tests_rejections_and_newest_vectors(spark, folders, base):
    log = ChangeLog.over(folders["changes"], base, parts=4)
    verdicts = spark.createDataFrame([("s", "error")], "name string, status string")
    cases = '[{"input":{},"expected":1}]'
    key = "ghp_" + "a" * 36
    rows = [[(1, "s", "k = 1", "d", [], [], cases, True), (2, "x", f'k = "{key}"', "d", [], [], cases, True)],
            [(3, "s", "k = 2", "d", [], [], cases, None)]]
    out = jobs.SaveFolders(folders["vectors"], folders["rejected"], folders["failed"])
    status = []
    for batch in rows:
        drop_file(spark.createDataFrame(batch, REQUEST + ", skip_test boolean"), folders["in"])
        like = spark.createDataFrame(batch, REQUEST + ", skip_test boolean")
        stream = jobs.file_stream(spark, folders["in"], "*.parquet", like)
        by_code = lambda texts: [[float(t[-1]), 0.0] for t in texts]
        jobs.save_stream(stream, log, out, verdicts, by_code, "m", 2, lambda batch_id: AS_OF, folders["checkpoint"]).awaitTermination()
        status.append(by_name(log.current())["s"]["status"])
    assert status == ["verified", "failed"]
    assert [tuple(r)[:2] for r in spark.read.parquet(folders["rejected"]).select("seq", "name").collect()] == [(2, "x")]
    # Both vectors have one time; the later batch's is the newest.
    newest = latest_embeddings(spark.read.option("basePath", out.embeddings).parquet(out.embeddings))
    assert [r["vector"][0] for r in newest.collect()] == [2.0]


def test_usage_is_applied_once(spark, folders, base):
    config = spark.createDataFrame([("embedding_model", "m")], "key string, value string")
    for i, calls in enumerate([(1, 2), (3,)]):
        events(spark, *[(n, "a", 1, n) for n in calls]).groupBy("name").agg(
            F.count("*").alias("calls"), F.max("ts").alias("last_ts")
        ).withColumn("last_ts", F.col("last_ts").cast("timestamp")).write.parquet(f"{folders['out']}/batch={i}")
        first = jobs.apply_pending_usage(base, config, folders["out"])
        again = jobs.apply_pending_usage(first.functions, first.config, folders["out"])
        base, config = again.functions, again.config
    assert by_name(base)["a"]["call_count"] == 7
    assert {r["key"]: r["value"] for r in config.collect()} == {"embedding_model": "m", jobs.USAGE_MARK: "1"}


def test_record_files_and_index_do_not_grow_with_tasks(spark, folders):
    rows = [(f"n{i}", "code", None if i % 2 else f"d{i}", ["t"] if i % 3 else None) for i in range(60)]
    records = spark.createDataFrame(rows, "name string, code string, description string, tags array<string>").repartition(20)
    hub.write_hub_records(records.withColumn("test_cases", F.lit("[]")), folders["out"], shards=3, files_per_shard=2)
    files = spark.read.text(folders["out"]).select(F.col("_metadata.file_path").alias("f")).distinct().count()
    assert 3 <= files <= 6
    for part in (records, records.filter("name < 'n3'")):
        hub.write_hub_index(part, folders["in"])
        index = hub.read_hub_index(spark, folders["in"])
        assert sorted(map(str, index.collect())) == sorted(map(str, hub.build_hub_index(part).collect()))


def test_rate_windows_close_in_append_mode(spark, folders):
    rows = [(i, "a", 1, i) for i in range(15)]
    drop_file(events(spark, *rows), folders["in"])
    like = events(spark, *rows)

    def run():
        stream = jobs.rate_stream(jobs.file_stream(spark, folders["in"], "*.parquet", like), "1 minute", 10)
        handle = lambda df, i: df.write.mode("overwrite").parquet(f"{folders['out']}/batch={i}")
        jobs.start(stream, handle, folders["checkpoint"]).awaitTermination()

    run()
    drop_file(events(spark, (90, "a", 2, 100_000)), folders["in"])
    run()
    drop_file(events(spark, *[(100 + i, "a", 3, i) for i in range(15)]), folders["in"])  # far too late: never flagged
    run()
    assert [(r["user_id"], r["calls"]) for r in spark.read.parquet(folders["out"]).collect()] == [(1, 15)]


def test_counters_of_three_batches_equal_the_batch_form(spark, folders, base, tmp_path):
    files = [
        [{"name": "a", "code": "x = 2", "description": "one"}, {"name": "n", "code": "z = 1"}, {"name": "n", "code": "z = 0"}],
        [{"name": "a", "code": "x = 2", "description": "one"}, {"name": "m", "code": None}, {"name": ""}],
        [{"name": "n", "code": "z = 5"}, {"name": "k", "code": "y = 1"}],
    ]
    log = ChangeLog.over(folders["changes"], base, parts=4)
    listener = jobs.SyncCounters()
    spark.streams.addListener(listener)
    try:
        stored, expected = base, []
        for i, rows in enumerate(files):
            lines = "".join(json.dumps(r) + "\n" for r in rows) + ("{broken\n" if i == 1 else "")
            (tmp_path / f"r{i}.json").write_text(lines)
            records = hub.stream_hub_records(spark, str(tmp_path), one_per_file=False)
            jobs.hub_stream(records, log, lambda batch_id: AS_OF, folders["checkpoint"], folders["out"]).awaitTermination()
            one = hub.split_records(spark.read.schema(hub.HUB_LINES).option("columnNameOfCorruptRecord", hub.CORRUPT)
                                    .json(str(tmp_path / f"r{i}.json")).withColumn("file_path", F.lit("")))
            counted = hub.sync_counts(maintenance.hub_actions(stored, one.records)).first()
            expected.append((i, *counted, one.rejected.count()))
            stored = maintenance.merge_hub(stored, one.records, AS_OF)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    got = spark.read.parquet(folders["out"]).select("batch_id", *jobs.COUNTERS).orderBy("batch_id")
    assert [tuple(r) for r in got.collect()] == expected
    assert listener.total() == {"read": 9, "unreadable": 1} and by_name(log.current()) == by_name(stored)


def test_state_holds_open_sessions_only(spark, folders):
    """Sessions go out once, whatever the order of files; state shrinks to what may still grow."""
    rows = [(i, "a", i % 3, i * 100 % 5000) for i in range(60)] + [(70, "a", 1, 20_000), (71, "a", 1, 20_600), (72, "a", 2, 30_000)]
    like = events(spark, *rows)
    late = events(spark, (90, "a", 1, 7), (91, "a", 5, 8))
    flush = events(spark, (99, "a", 9, 1_000_000))
    for part in (events(spark, *rows[40:60]), events(spark, *rows[:40]), events(spark, *rows[60:]), flush, late):
        drop_file(part, folders["in"])
        stream = jobs.file_stream(spark, folders["in"], "*.parquet", like, files_per_batch=1)
        handle = lambda df, i: df.write.mode("overwrite").parquet(f"{folders['out']}/batch={i}")
        with sessions.state_beyond_the_heap(spark):
            jobs.start(sessions.session_state_stream(stream, 600, "2 hours"), handle, folders["checkpoint"]).awaitTermination()
    got = spark.read.parquet(folders["out"]).select("user_id", "session_start", "session_end", "events")
    as_ntz = got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
    expected = activity.activity_sessions(like, 600).select(*got.columns)
    assert sorted(map(tuple, as_ntz.collect())) == sorted(map(tuple, expected.collect()))
    state = spark.read.format("statestore").option("path", folders["checkpoint"]).option("stateVarName", "open").load()
    assert [r["key"]["user_id"] for r in state.collect()] == [9]


def test_sessions_join_in_any_order():
    rng = np.random.default_rng(4)
    for _ in range(200):
        at = rng.integers(0, 200, size=rng.integers(0, 30))
        held = (np.zeros(0, np.int64),) * 3
        for part in np.array_split(at, 3):
            new = (part, part, np.ones(len(part), np.int64))
            held = sessions.merged(*(np.concatenate(p) for p in zip(held, new)), 7)
        groups = [g.tolist() for g in np.split(np.sort(at), np.flatnonzero(np.diff(np.sort(at)) > 7) + 1) if len(g)]
        assert list(zip(*(x.tolist() for x in held))) == [(g[0], g[-1], len(g)) for g in groups]


class _Handle:
    """State and timers of one user, with every call on them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "get":
                return self.value
            if name in ("update", "clear"):
                self.value = args[0] if args else None
            elif name in ("registerTimer", "deleteTimer"):
                (self.timers.add if name == "registerTimer" else self.timers.remove)(args[0])

        return (lambda *_: self) if name == "getValueState" else call


def test_a_user_costs_few_calls_to_the_state():
    """One reading, one writing and at most one timer moved; the timer is always at the first end."""
    rng, handle = np.random.default_rng(8), _Handle()
    processor, seen, got = sessions.SessionProcessor(10), [], []
    processor.init(handle)
    for batch in range(40):
        times = TimerValues(0, batch * 20_000)
        at = (rng.integers(max(0, batch * 20 - 5), batch * 20 + 40, size=rng.integers(0, 4))).tolist()
        at = [a for a in at if a * 1000 >= batch * 20_000]
        seen += at
        handle.calls.clear()
        if at:
            rows = iter([Row(user_id=1, ts=datetime.fromtimestamp(a, UTC)) for a in at])
            got += processor.handleInputRows((1,), rows, times)
            assert len(handle.calls) <= 4 and set(handle.calls) <= {"get", "update", "clear", "registerTimer", "deleteTimer"}
        for due in [t for t in handle.timers if t <= batch * 20_000]:
            got += processor.handleExpiredTimer((1,), times, ExpiredTimerInfo(due))
            handle.timers.remove(due)
        ends = [last // 1000 + 10_000 + 1 for last in (handle.value or ([], [], []))[1]]
        assert handle.timers == ({min(ends)} if ends else set())
    groups = [g.tolist() for g in np.split(np.sort(seen), np.flatnonzero(np.diff(np.sort(seen)) > 10) + 1)]
    closed = [(g[0] * 10**6, (g[-1] + 10) * 10**6, len(g)) for g in groups]
    assert sorted((r["session_start"], r["session_end"], r["events"]) for r in got) == closed[: len(got)] and len(got) >= len(closed) - 5


def test_closed_sessions_from_micro_batches_of_many_files(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 500)
    t, batches = Tables(spark, "/root/testdata/sf0.01"), []
    real = jobs.file_stream
    monkeypatch.setattr(jobs, "file_stream", lambda *a, files_per_batch: batches.append(files_per_batch) or real(*a, files_per_batch=files_per_batch))
    got = streams.stream_sessions_closed(t)
    end = t.events.agg(F.max("ts")).first()[0] - timedelta(hours=2)
    expected = activity.activity_sessions(t.events).select(*got.columns).filter(F.col("session_end") < F.lit(end))
    assert batches == [4] and got.count() == expected.count() > 0 and not got.exceptAll(expected).count()
