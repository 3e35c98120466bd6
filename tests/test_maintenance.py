from __future__ import annotations

import json
import uuid

import pytest
from pyspark.sql import functions as F

from assetloom import schemas
from assetloom.operators import embeddings, lookup, maintenance, quality, retention, triage
from assetloom.operators.ranking import ranked
from assetloom.session import cut_lineage, work_path
from assetloom.sources import catalog, hub, record_files

AS_OF = "2024-02-01 00:00:00"
NOW = "2024-02-01T00:00:00"


def functions_table(spark, **rows):
    """Rows by name; missing columns are NULL."""
    data = [tuple({"name": n, **r}.get(c) for c in schemas.FUNCTIONS.names) for n, r in rows.items()]
    return spark.createDataFrame(data, schemas.FUNCTIONS)


def by_name(df):
    return {r["name"]: r.asDict() for r in df.collect()}


@pytest.fixture
def stored(spark):
    return functions_table(
        spark,
        a={"code": "x = 1", "description": "one", "status": "verified", "call_count": 4, "last_called_at": "2024-01-01T00:00:00",
           "created_at": "2023-01-01T00:00:00", "tags": "[]", "metadata": "{}", "test_cases": "[]"},
        b={"code": "y = 1", "description": "", "status": "deleted", "call_count": 0, "tags": '["t"]'},
    )


REQUEST = "seq long, name string, code string, description string, tags array<string>, dependencies array<string>, test_cases string"


def request(spark, *rows):
    return spark.createDataFrame([(i, n, c, d, [], ["numpy"], "[]") for i, (n, c, d) in enumerate(rows)], REQUEST)


def test_save_replaces_and_keeps_usage(spark, stored):
    batch = request(spark, ("a", "old = 1", "first"), ("a", "new = 1", "last"), ("c", "def (", ""), ("d", "k = 'ghp_" + "a" * 36 + "'", "x"))
    result = maintenance.save_assets(stored, batch, AS_OF)
    rows = by_name(result.accepted)
    assert set(rows) == {"a", "b", "c"}
    assert rows["a"]["code"] == "new = 1" and rows["a"]["call_count"] == 4
    assert rows["a"]["created_at"] == NOW and rows["a"]["last_called_at"] == "2024-01-01T00:00:00"
    assert rows["a"]["status"] == "pending" and rows["c"]["status"] == "broken"
    assert json.loads(rows["c"]["metadata"]) == {"dependencies": ["numpy"], "saved_at": NOW, "quality_score": 0}
    assert rows["c"]["description"] == "Draft automatically saved by AI on 2024-02-01 00:00:00"
    assert rows["b"] == by_name(stored)["b"]
    assert [tuple(r) for r in result.rejected.collect()] == [(3, "d", maintenance.SECRET_REJECTION)]


def test_rejected_request_does_not_replace(spark, stored):
    batch = request(spark, ("a", "good = 1", "d"), ("a", "k = 'ghp_" + "a" * 36 + "'", "d"))
    assert by_name(maintenance.save_assets(stored, batch, AS_OF).accepted)["a"]["code"] == "good = 1"


def test_strict_gate(spark, stored):
    batch = request(spark, ("u", "import os", "d"), ("v", "def (", "d"), ("w", "x = 1", "d"))
    result = maintenance.save_assets(stored, batch, AS_OF, gate="strict")
    assert set(by_name(result.accepted)) == {"a", "b", "w"}
    assert {r["name"] for r in result.rejected.collect()} == {"u", "v"}


def hub_batch(spark, *rows):
    data = [(n, c, d, ["t"], "[]", ["dep"], 80.0, u, p) for n, c, d, u, p in rows]
    return spark.createDataFrame(data, hub.HUB_LINES[:8].add("file_path", "string"))


def test_hub_merge_is_idempotent(spark, stored):
    records = hub_batch(
        spark, ("a", "x = 2", "one", "2024-01-02T00:00:00", "f1"), ("a", "x = 3", "one", "2024-01-02 00:00:00+00", "f2"),
        ("n", "z = 1", None, None, "f3"), ("b", "y = 1", None, None, "f4"), ("s", None, "no code", None, "f5"),
    )
    actions = {r["name"]: r["action"] for r in maintenance.hub_actions(stored, records).collect()}
    assert actions == {"a": "update", "n": "insert", "b": "unchanged", "s": "skipped"}
    assert tuple(hub.sync_counts(maintenance.hub_actions(stored, records)).first()) == (1, 1, 1, 1, 4)
    once = maintenance.merge_hub(stored, records, AS_OF)
    rows = by_name(once)
    assert rows["a"]["code"] == "x = 3" and rows["a"]["status"] == "verified" and rows["a"]["call_count"] == 4
    assert rows["n"]["status"] == "active" and rows["n"]["call_count"] == 0 and rows["n"]["created_at"] == NOW
    assert json.loads(rows["n"]["metadata"]) == {"dependencies": ["dep"], "quality_score": 80, "sync_source": "github-hub"}
    assert by_name(maintenance.merge_hub(once, records, AS_OF)) == rows


def test_delete_usage_status_archive(spark, stored):
    vectors = spark.createDataFrame([(1, "a", [1.0], "m", 1, NOW)], schemas.EMBEDDINGS)
    kept, kept_vectors = maintenance.delete_assets(stored, vectors, stored.filter("name = 'a'").select("name"))
    assert set(by_name(kept)) == {"b"} and kept_vectors.count() == 0
    delta = spark.createDataFrame([("a", 3, "2024-01-05 10:00:00.25"), ("gone", 1, "2024-01-05 10:00:00")], "name string, calls long, t string")
    used = by_name(maintenance.apply_usage(stored, delta.withColumn("last_ts", F.col("t").cast("timestamp_ntz"))))
    assert used["a"]["call_count"] == 7 and used["a"]["last_called_at"] == "2024-01-05T10:00:00.250000"
    assert set(used) == {"a", "b"} and used["b"]["updated_at"] is None
    archived = by_name(maintenance.archive_assets(stored, stored.filter("name = 'a'"), AS_OF))
    assert (archived["a"]["status"], archived["a"]["updated_at"]) == ("archived", NOW)
    assert archived["b"]["status"] == "deleted"


def test_hub_folder_scan(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"name": "g", "code": "x",\n "tags": ["a"], "test_cases": [{"input": {"k": 1}, "expected": 2}]}')
    (tmp_path / "bad.json").write_text('{"name": "b", "code": ')
    (tmp_path / "nameless.json").write_text('{"code": "x"}')
    scan = hub.read_hub_records(spark, str(tmp_path))
    record = scan.records.first()
    assert scan.records.count() == 1 and record["name"] == "g"
    assert json.loads(record["test_cases"]) == [{"input": {"k": 1}, "expected": 2}]
    assert sorted(r["reason"] for r in scan.rejected.collect()) == ["no name", "unreadable"]


def test_export_defaults_and_round_trip(spark, stored):
    records = hub.export_hub_records(stored, AS_OF)
    assert [r["name"] for r in records.collect()] == ["a"]
    folder = work_path(spark, "test-records")
    hub.write_hub_records(records, folder, shards=2)
    again = hub.read_hub_records(spark, folder, one_per_file=False).records.drop("file_path")
    assert again.collect() == records.select(*again.columns).collect()


def test_snapshots_are_immutable(spark, stored):
    base = work_path(spark, "test-catalog")
    catalog.write_snapshot(stored, base, "functions", 1)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        catalog.write_snapshot(stored, base, "functions", 1)


def test_old_layout_reads_with_defaults(spark, stored):
    base = work_path(spark, "test-catalog")
    catalog.write_snapshot(stored.drop("call_count"), base, "functions", 1)
    catalog.write_snapshot(spark.createDataFrame([(1, [1.0])], "id long, vector array<float>"), base, "embeddings", 1)
    catalog.write_snapshot(spark.createDataFrame([], schemas.CONFIG), base, "config", 1)
    tables = catalog.read_catalog(spark, base, 1)
    assert {r["call_count"] for r in tables.functions.collect()} == {0}
    assert tables.embeddings.first()["function_name"] is None


def test_stored_nulls_are_no_missing_columns(spark, stored):
    base = work_path(spark, "test-catalog")
    nulls = stored.withColumns({"status": F.lit(None).cast("string"), "call_count": F.lit(None).cast("int")})
    catalog.write_snapshot(nulls, base, "functions", 1)
    catalog.write_snapshot(spark.createDataFrame([], schemas.EMBEDDINGS), base, "embeddings", 1)
    catalog.write_snapshot(spark.createDataFrame([], schemas.CONFIG), base, "config", 1)
    functions = catalog.read_catalog(spark, base, 1).functions
    assert {(r["status"], r["call_count"]) for r in functions.collect()} == {(None, None)}
    assert lookup.publishable(functions).count() == 0


def test_upsert_keeps_one_row_per_asset(spark):
    held = [(1, "a", [1.0], "m", 1, "2024-01-01T00:00:00"), (2, "a", [2.0], "m", 1, "2024-01-01 00:00:01+00"), (3, "b", [3.0], "m", 1, NOW)]
    new = [(9, "b", [4.0, 5.0], "m2", 2, "2023-01-01T00:00:00")]
    table = spark.createDataFrame(held, schemas.EMBEDDINGS)
    got = embeddings.upsert_embeddings(table, spark.createDataFrame(new, schemas.EMBEDDINGS), one_per_asset=False)
    assert sorted((r["function_name"], r["id"]) for r in got.collect()) == [("a", 2), ("b", 9)]
    again = embeddings.upsert_embeddings(got, spark.createDataFrame(new, schemas.EMBEDDINGS))
    assert sorted((r["function_name"], r["id"]) for r in again.collect()) == [("a", 2), ("b", 9)]


def test_stale_and_provider_failures(spark):
    functions = functions_table(spark, a={"code": "x"}, b={"code": "y"}, c={"code": "z"})
    held = spark.createDataFrame([(1, "a", [1.0], "m", 1, NOW), (2, "b", [1.0], "old", 1, NOW), (3, "b", [1.0], "m", 1, NOW)], schemas.EMBEDDINGS)
    stale = {r["name"]: r["reason"] for r in embeddings.stale_embeddings(functions, held, "m", 1).collect()}
    assert stale == {"b": "outdated", "c": "missing"}

    def provider(texts):
        return [None if "Name: c" in t else [7.0] for t in texts]

    fresh = embeddings.refresh_embeddings(functions, held, provider, "m", 1, AS_OF)
    assert sorted((r["function_name"], list(r["vector"])) for r in fresh.embeddings.collect()) == [("a", [1.0]), ("b", [7.0])]
    assert [tuple(r) for r in fresh.failed.collect()] == [("c", "provider gave no vector")]
    longer = embeddings.refresh_embeddings(functions, held, provider, "m", 2, AS_OF)
    assert {r["name"]: r["error"] for r in longer.failed.collect()}["b"] == "2 values wanted, got 1"
    assert sorted((r["function_name"], list(r["vector"])) for r in longer.embeddings.collect()) == sorted(
        (r["function_name"], list(r["vector"])) for r in held.collect()
    )

    def down(texts):
        raise RuntimeError("provider down")

    failed = embeddings.embed(functions.select("name", F.col("code").alias("text")), down).collect()
    assert all(r["vector"] is None and r["error"] == "provider down" for r in failed)


def test_provider_gets_bounded_pieces_of_a_batch(spark):
    """One Arrow batch of many and of long texts: each keeps its own vector, whatever the pieces."""
    sizes = [i % 7 for i in range(1200)] + [300_000] * 30 + [3_000_000, 5]
    texts = [("x" * n) if n != 6 else None for n in sizes]
    df = spark.createDataFrame(list(enumerate(texts)), "name int, text string").coalesce(1)

    def provider(batch):
        whole = sum(len(t or "") for t in batch)
        return [[len(batch), whole, -1 if t is None else len(t)] for t in batch]

    got = {r["name"]: r["vector"] for r in embeddings.embed(df, provider).collect()}
    assert [got[i][2] for i in range(len(sizes))] == [-1 if t is None else len(t) for t in texts]
    assert max(v[0] for v in got.values()) <= 500
    assert all(v[1] <= 2 * 1024 * 1024 or v[0] == 1 for v in got.values())


def test_retention_dates(spark):
    meta = '{"quality_score": 10}'
    functions = functions_table(
        spark,
        idle={"created_at": "2024-01-01", "call_count": 0, "metadata": meta, "status": "pending"},
        used={"created_at": "2024-01-01 00:00:00", "last_called_at": "2024-01-31T23", "call_count": 0, "metadata": meta, "status": "pending"},
        aware={"created_at": "2023-01-01T00:00:00+00:00", "call_count": 0, "metadata": meta, "status": "pending"},
        tagged={"created_at": "2023-01-01", "call_count": 0, "metadata": meta, "status": "pending", "tags": '["core"]'},
        nostatus={"created_at": "2023-01-01", "call_count": 0, "metadata": meta},
        default={"created_at": "2023-01-01", "call_count": 0, "metadata": "{}", "status": "pending"},
        bad={"created_at": "2023-01-01", "call_count": 0, "metadata": '{"quality_score": "abc"}', "status": "pending"},
    )
    scores = by_name(retention.retention_score(functions, AS_OF))
    assert scores["idle"]["days_inactive"] == 31 and scores["used"]["days_inactive"] == 0
    assert scores["aware"]["days_inactive"] == 0
    assert scores["default"]["score"] == 0.5 and scores["bad"]["bad_quality"] and scores["bad"]["score"] is None
    assert set(by_name(retention.forget_candidates(functions, AS_OF))) == {"idle"}


def test_triage_rounding_and_advice(spark):
    rows = {n: {"metadata": f'{{"quality_score": {v}}}', "status": s} for n, v, s in [
        ("half_even_up", "69.5", "pending"), ("half_even_down", "68.5", "pending"), ("text", '"50"', "broken"),
        ("words", '"abc"', "failed"), ("gone", "1", "deleted"), ("low", "1", "failed")]}
    functions = functions_table(spark, **rows)
    got = [(r["name"], r["quality_score"]) for r in triage.broken_assets(functions).collect()]
    assert got == [("low", 1), ("text", 50), ("half_even_down", 68)]
    advice = {r["name"]: r["actionable_advice"] for r in triage.diagnostic_report(functions).collect()}
    assert advice["low"] == [triage.ADVICE_POOR, triage.ADVICE_FAILED]
    assert advice["text"] == [triage.ADVICE_BROKEN] and advice["words"] == [triage.ADVICE_FAILED]
    assert advice["half_even_up"] == [triage.ADVICE_STABLE]


def test_quality_scores(spark):
    functions = functions_table(spark, clean={"code": "x = 1"}, lint={"code": "x = 1"}, form={"code": "x = 1"}, hit={"code": "x", "metadata": '{"dependencies": ["Flask==1"]}'})
    lint = spark.createDataFrame([("lint", 1, "E1", "m"), ("lint", 1, "E2", "m")], "name string, row_no int, code_id string, message string")
    formats = spark.createDataFrame([("clean", True), ("form", False)], "name string, passed boolean")
    static = spark.createDataFrame([], "name string, line_no int, severity string, message string")
    advisories = spark.createDataFrame([("flask", "A", "t")], "package string, advisory_id string, advisory string")
    report = quality.quality_report(functions, lint, formats, static, advisories)
    got = {r["name"]: (r["final_score"], r["reliability"]) for r in report.collect()}
    assert got == {"clean": (100, "high"), "lint": (30, "low"), "form": (70, "medium"), "hit": (70, "medium")}
    reviews = spark.createDataFrame(
        [("clean", 'x {"score": 51} y'), ("lint", '{"score": null}'), ("form", '{"score": "9"}'), ("hit", '{"feedback": "f"}')],
        "name string, llm_output string",
    )
    blended = {r["name"]: (r["final_score"], r["quality_feedback"]) for r in quality.blend_review(report, reviews).collect()}
    assert blended["clean"][0] == 75 and blended["lint"] == (30, "") and blended["form"] == (70, "")
    assert blended["hit"] == (60, "AI: f | Hub: ")


def test_case_verdicts(spark):
    rows = [("a", 0, "5", "5.0", None), ("a", 1, '{"k":1}', '{"k":2}', None), ("a", 2, "1", None, "boom"), ("b", 0, None, None, None),
            ("b", 1, '{"x": 1, "y": [2]}', '{"y":[2],"x":1}', None)]
    results = spark.createDataFrame(rows, "name string, case_no long, expected string, actual string, trace string")
    got = {r["name"]: (r["failures"], r["status"]) for r in quality.evaluate_test_results(results).collect()}
    assert got == {"a": (2, "error"), "b": (0, "success")}
    errors = sorted(tuple(r) for r in quality.case_errors(results).collect())
    assert errors == [("a", 1, 'Test 2: Expected {"k":1}, got {"k":2}'), ("a", 2, "Test 3: Runtime Error - boom")]
    whole = [tuple(r) for r in quality.joined_errors(results, 1000).collect()]
    assert whole == [("a", 0, "; ".join(e[2] for e in errors))]
    parts = {r["part_no"]: r["error"] for r in quality.joined_errors(results, 20).collect()}
    assert [parts[i] for i in sorted(parts)] == [e[2] for e in errors]


def test_case_values_compare_exactly(spark):
    pairs = [("9007199254740993", "9007199254740992", False), ("9007199254740993", "9007199254740993", True),
             ("9007199254740993", "9007199254740992.0", False), ("1", "1.0", True), ("1e2", "100", True), ("0.1", "0.10", True),
             ("true", "1", True), ("false", "0.0", True), ("true", "0", False), ("1e-30", "0", False), ("-0", "0", True),
             ('"1"', "1", False), ("null", "0", False), (None, "0", False), ("[1, 2]", "[1,2]", True), ("1e400", "2e400", True)]
    rows = [("a", i, e, g, None) for i, (e, g, _) in enumerate(pairs)]
    results = spark.createDataFrame(rows, "name string, case_no long, expected string, actual string, trace string")
    failed = {r["case_no"] for r in quality.case_errors(results).collect()}
    assert failed == {i for i, p in enumerate(pairs) if not p[2]}


def test_repeated_rows_never_multiply_assets(spark):
    table = functions_table(spark, a={"status": "pending"}, b={"status": "pending"})
    twice = spark.createDataFrame([("a", "verified"), ("a", "failed"), ("a", "verified")], "name string, status string")
    assert {n: r["status"] for n, r in by_name(maintenance.apply_status(table, twice, AS_OF)).items()} == {"a": "failed", "b": "pending"}
    assert maintenance.apply_status(table, twice, AS_OF).count() == 2
    verdicts = spark.createDataFrame([("a", "success"), ("a", "error")], "name string, status string")
    assert quality.verification_status(table, verdicts, skipped=twice.select("name")).count() == 2
    formats = spark.createDataFrame([("a", True), ("a", False)], "name string, passed boolean")
    assert [r["formatted"] for r in quality.format_penalty(formats).collect()] == [False]


def test_advisories_of_untidy_requirements(spark):
    table = functions_table(spark, a={"metadata": '{"dependencies":["  Requests ==2.19","flask"]}'})
    known = spark.createDataFrame([("requests", "A1", "leak")], "package string, advisory_id string, advisory string")
    assert [r["advisory_penalty"] for r in quality.advisory_penalty(table, known).collect()] == [30]


def test_ranks_split_hot_groups(spark):
    rows = [("hot", (i * 7919) % 3000) for i in range(3000)] + [("cold", i) for i in range(50)]
    got = ranked(spark.createDataFrame(rows, "g string, v int"), ["g"], ["v"], "test-ranks")
    assert got.filter("rank != v + 1").count() == 0 and got.count() == 3050


def test_equal_texts_are_embedded_once_and_failures_again(spark, tmp_path):
    def provider(texts):
        for t in texts:
            (tmp_path / uuid.uuid4().hex).write_text(t)
        return [None if t == "bad" else [float(len(t)), 1.0] for t in texts]

    def asked():
        texts = sorted(p.read_text() for p in tmp_path.iterdir())
        for p in tmp_path.iterdir():
            p.unlink()
        return texts

    texts = "name string, text string"
    first = spark.createDataFrame([("a", "one"), ("b", "one"), ("c", "bad"), ("d", None), ("e", ""), ("f", "three")], texts)
    made = embeddings.embed_reusing(first, spark.createDataFrame([], embeddings.VECTOR_STORE), provider, "m", 2)
    got = {r["name"]: (r["vector"], r["error"]) for r in made.made.collect()}
    assert got["a"] == got["b"] == ([3.0, 1.0], None) and got["c"] == (None, "provider gave no vector") and got["d"] == got["e"]
    assert asked() == ["", "bad", "one", "three"]
    store = cut_lineage(made.store, "store")
    assert store.count() == 3
    second = spark.createDataFrame([("a", "one"), ("c", "bad"), ("g", "sixsix"), ("f", "three")], texts)
    again = embeddings.embed_reusing(second, store, provider, "m", 2)
    assert {r["name"]: r["vector"] for r in again.made.collect()} == {"a": [3.0, 1.0], "c": None, "g": [6.0, 1.0], "f": [5.0, 1.0]}
    assert asked() == ["bad", "sixsix"] and again.store.count() == 4
    other = embeddings.embed_reusing(second, store, provider, "other", 2)
    assert other.made.count() == 4 and len(asked()) == 4


def test_one_file_per_asset(spark, tmp_path):
    names = ["a", "b/c", "d e", "\u00e9\U0001f680", "long" * 100, "long" * 99 + "x"]
    rows = [(n, f"code {n}", None, ["t"], [], '[{"input":{"k":1},"expected":2}]', 50.0, NOW) for n in names]
    schema = "name string, code string, description string, tags array<string>, dependencies array<string>, test_cases string, quality_score double, updated_at string"
    records, folder = spark.createDataFrame(rows, schema).repartition(3), str(tmp_path / "records")
    for written in (records, records.filter("name != 'a'")):
        record_files.write_record_files(written, folder)
        files = [p for p in (tmp_path / "records").rglob("*") if p.is_file() and not p.name.endswith(".crc")]
        assert len(files) == written.count() and not any(p.name.startswith("_pending") for p in (tmp_path / "records").iterdir())
        read = record_files.read_record_files(spark, folder).records.drop("file_path")
        assert sorted(map(str, read.select(*written.columns).collect())) == sorted(map(str, written.collect()))
    assert hub.read_hub_records(spark, folder).records.count() == len(names) - 1  # the built-in scan reads them too
    (tmp_path / "records" / "bad.json").write_text("{")
    assert [r["reason"] for r in record_files.read_record_files(spark, folder).rejected.collect()] == ["unreadable"]


def test_failed_exports_leave_nothing(spark, tmp_path):
    folder = str(tmp_path / "records")
    schema = "name string, code string, test_cases string"
    good = spark.createDataFrame([("a", "x", "[]")], schema)
    record_files.write_record_files(good, folder)
    bad = spark.createDataFrame([(f"n{i}", "x", "[]") for i in range(8)], schema).repartition(4)
    broken = bad.withColumn("code", F.expr("if(name = 'n5', raise_error('no code'), code)"))
    with pytest.raises(Exception, match="no code"):
        record_files.write_record_files(broken, folder)
    assert [r["name"] for r in record_files.read_record_files(spark, folder).records.collect()] == ["a"]
    assert not [p for p in (tmp_path / "records").iterdir() if p.name.startswith("_pending")]
