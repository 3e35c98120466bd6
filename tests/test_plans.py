"""Physical plans: what is scanned, pushed down, shuffled and run in Python."""

from __future__ import annotations

import contextlib
import io
import json
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assetloom.operators import deps, embeddings, lookup, maintenance, ranking, retention, search, triage
from assetloom.plans import registry
from assetloom.plans.catalog import hub_records, save_batch
from assetloom.plans.registry import AS_OF, Tables
from assetloom.session import cut_lineage, sparing_disk, work_path, work_scope
from assetloom.sources import catalog, hub
from assetloom.streaming import jobs
from assetloom.streaming.changelog import ChangeLog

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def stored(spark):
    path = work_path(spark, "plan-functions")
    Tables(spark, SF_DIR).fx_functions.write.parquet(path)
    return spark.read.parquet(path)


PYTHON = ("ArrowEvalPython", "MapInArrow", "FlatMapGroupsInArrow", "FlatMapCoGroupsInArrow", "FlatMapCoGroupsInPandas")
# Queries with Python in any of their jobs: parsing, the provider, scoring, walks of bundles.
USES_PYTHON = {
    "bundle_code",
    "code_facts", "security_verdict", "security_violations", "syntax_status", "required_packages", "internal_edges",
    "internal_dependencies", "save_assets", "save_rejected", "embed_refresh", "embed_reused", "embed_failures", "search_topk", "search_boosted",
    "search_batch", "search_batch_blocks", "search_popularity", "search_hybrid", "search_select", "search_attach_code", "search_pruned",
    "stream_saves", "stream_save_rejected", "stream_embed_failures",
}


def executed(spark, build) -> list[str]:
    """Final plans of every job that ``build`` and reading its result run, intermediate tables included."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = store.executionsCount()
    build().write.format("noop").mode("overwrite").save()
    bus.waitUntilEmpty(30_000)
    seen = store.executionsList(before, 10_000)
    assert seen.size() == store.executionsCount() - before > 0
    return [seen.apply(i).physicalPlanDescription() for i in range(seen.size())]


def exchanged(plans: list[str]) -> list[str]:
    """Columns that each shuffle or broadcast moves."""
    return [m for p in plans for m in re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: (.*)", p)]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_plans_of_every_query(spark, name):
    plans = executed(spark, lambda: registry.queries()[name](spark, SF_DIR))
    assert plans
    for text in plans:
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text
        if "Window" in text:
            assert not re.search(r"Exchange SinglePartition[^\n]*\n(.*\n)?.*Window \(", text)
    assert any(p in text for p in PYTHON for text in plans) == (name in USES_PYTHON)


def test_listing_reads_three_columns_and_sorts_only_the_top(stored):
    text = plan(lookup.list_assets(stored))
    assert "ReadSchema: struct<name:string,description:string,status:string>" in text and "TakeOrderedAndProject" in text


def test_masked_view_never_scans_code(stored):
    assert "code:string" not in plan(catalog.masked_view(stored))


def test_status_filter_reaches_the_scan(stored):
    text = plan(retention.forget_candidates(stored, AS_OF))
    assert "Not(In(status, [archived,deleted]))" in text or "In(status" in text
    assert "code:string" not in text
    assert "Not(EqualTo(status,deleted))" in plan(triage.broken_assets(stored))


def test_single_search_ships_neither_vectors_nor_all_names(spark, stored):
    vectors = Tables(spark, SF_DIR).fx_embeddings
    plans = executed(spark, lambda: search.cosine_topk(vectors, stored, [0.5] * 64))
    moved = exchanged(plans)
    assert moved and all("vector" not in m for m in moved)
    # What is moved are candidates and their names; of the functions, only rows that met one.
    for text in plans:
        for join in re.findall(r"\(\d+\) (\w+Join) LeftSemi", text):
            assert join == "BroadcastHashJoin"


def test_descriptions_move_once_and_never_by_query(spark, stored):
    t = Tables(spark, SF_DIR)
    hits = cut_lineage(t.fx_embeddings.selectExpr("id AS query_id", "function_name", "0.5D AS score", "1 AS rank"), "plan-hits")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = exchanged(executed(spark, lambda: search.boosted_ranks(hits, stored)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    texts = [m for m in moved if "description" in m]
    assert texts and not any("query_id" in m for m in texts)


@pytest.mark.parametrize("name", ["search_hybrid", "search_select"])
def test_hybrid_search_moves_no_descriptions(spark, name):
    moved = exchanged(executed(spark, lambda: registry.queries()[name](spark, SF_DIR)))
    assert moved and not [m for m in moved if "description" in m]


def test_batch_search_prunes_before_the_shuffle_and_moves_no_vectors(spark, stored):
    t = Tables(spark, SF_DIR)
    queries = t.fx_embeddings.selectExpr("id AS query_id", "vector")
    plans = executed(spark, lambda: search.batch_topk(t.fx_embeddings, stored, queries, 64))
    assert any("WindowGroupLimit" in p for p in plans)
    assert exchanged(plans) and all("vector" not in m for m in exchanged(plans))


def test_dealt_search_brings_only_counts_to_the_driver(spark, stored, monkeypatch):
    t = Tables(spark, SF_DIR)
    queries = t.fx_embeddings.selectExpr("id AS query_id", "vector")

    def refused(*_):
        raise AssertionError("rows reach the driver")

    for name in ("toArrow", "collect", "toLocalIterator", "take"):
        monkeypatch.setattr(type(queries), name, refused)
    plans = executed(spark, lambda: search.batch_topk(t.fx_embeddings, stored, queries, 64, query_bytes=8 * 64 * 50, shard_bytes=8 * 64 * 70))
    monkeypatch.undo()
    assert "FlatMapCoGroupsInArrow" in plans[-1] and "WindowGroupLimit" in plans[-1]
    assert not any("vector" in m for p in plans for m in re.findall(r"\(\d+\) BroadcastExchange\nInput \[\d+\]: (.*)", p))


def test_merge_reads_stored_code_once(spark, stored):
    t = Tables(spark, SF_DIR)
    plans = executed(spark, lambda: maintenance.merge_hub(stored, hub_records(t), AS_OF))
    scans = re.findall(r"Location: InMemoryFileIndex \[.*plan-functions.*\n(?:PushedFilters.*\n)?ReadSchema: (.*)", plans[-1])
    assert sorted("code:string" in s for s in scans) == [False, True]


def test_saves_are_parsed_once_whatever_the_gate(spark):
    t = Tables(spark, SF_DIR)

    def both(gate):
        made = maintenance.prepare_saves(save_batch(t), AS_OF, gate)
        return made.accepted.select("name").unionByName(made.rejected.select("name"))

    for gate in ("draft", "strict"):
        plans = executed(spark, lambda: both(gate))  # noqa: B023
        assert sum(p.count("ArrowEvalPython (") for p in plans) == sum("ArrowEvalPython (" in p for p in plans) == 1


def test_label_rounds_move_only_candidates(spark):
    t = Tables(spark, SF_DIR)
    edges, roots = deps.declared_edges(t.fx_functions), t.fx_functions.select("name")
    moved = exchanged(executed(spark, lambda: deps.bundle_order(edges, roots, t.fx_functions, most_calls=0)))
    assert any("label" in m for m in moved) and not any(re.search(r"(?<!\w)_(root|label)#", m) for m in moved)


def test_bundle_texts_move_once(spark):
    t = Tables(spark, SF_DIR)
    order = cut_lineage(t.fx_functions.selectExpr("name AS root", "name AS node", "1L AS position"), "order")
    plans = executed(spark, lambda: deps.bundle_code(order, t.fx_functions, t.fx_functions, part_bytes=1000))
    assert sum("section" in m or "code" in m for m in exchanged(plans)) <= 3  # to the part, its text, to the asked roots


def test_usage_and_upsert_leave_the_large_tables_in_place(spark, stored):
    t = Tables(spark, SF_DIR)
    few = cut_lineage(t.fx_new_embeddings.limit(5), "few")
    plans = executed(spark, lambda: embeddings.upsert_embeddings(t.fx_embeddings, few))
    assert sum("vector" in m for m in exchanged(plans)) <= 1  # only the new ones
    held = cut_lineage(t.fx_held_embeddings, "held")
    plans = executed(spark, lambda: embeddings.upsert_embeddings(held, few, one_per_asset=False, layout="written"))
    assert not any("vector" in m for m in exchanged(plans))


def test_small_batch_leaves_the_stored_table_in_place(spark, stored):
    t = Tables(spark, SF_DIR)
    names = t.fx_names.limit(20)
    path = work_path(spark, "few-names")
    names.write.parquet(path)
    text = plan(lookup.get_details(stored, spark.read.parquet(path)))
    assert not re.findall(r"\(\d+\) Exchange\n", text)


def test_bucketed_versions_need_no_exchange(spark, stored):
    t, base = Tables(spark, SF_DIR), work_path(spark, "bucketed")
    catalog.write_bucketed_snapshot(catalog.Catalog(stored, t.fx_held_embeddings, t.fx_config), base, 1, buckets=8)
    # As in another session, which knows the files but no table.
    for name in ("functions", "embeddings"):
        spark.sql(f"DROP TABLE {catalog._table_name(catalog.version_path(base, name, 1))}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = catalog.read_catalog(spark, base, 1)
        stale = executed(spark, lambda: embeddings.stale_embeddings(read.functions, read.embeddings, "model-a", 64))
        assert "SortMergeJoin" in stale[-1] and not exchanged(stale)
        names = cut_lineage(t.fx_names, "names")
        gone = executed(spark, lambda: maintenance.delete_assets(read.functions, read.embeddings, names)[1])
        assert "SortMergeJoin" in gone[-1] and exchanged(gone) and not any("vector" in m for m in exchanged(gone))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    few = cut_lineage(t.fx_new_embeddings, "new")
    put = executed(spark, lambda: embeddings.upsert_embeddings(read.embeddings, few, one_per_asset=False, layout="bucketed"))
    assert not any("vector" in m for m in exchanged(put))
    assert read.embeddings.count() == t.fx_held_embeddings.count() and read.functions.count() == stored.count()


def test_work_scope_leaves_no_folder(spark):
    with work_scope(spark) as folder:
        cut_lineage(spark.range(3), "t").count()
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        assert fs.exists(path)
    assert not fs.exists(path)


def test_library_never_uses_local_checkpoints_or_row_udfs():
    source = "\n".join(p.read_text() for p in Path(__file__).parents[1].joinpath("assetloom").rglob("*.py"))
    for banned in ("localCheckpoint", "crossJoin", ".rdd", "toPandas", "F.udf("):
        assert banned not in source


def test_micro_batches_read_only_the_parts_of_their_names(spark, stored, tmp_path):
    log = ChangeLog.over(work_path(spark, "log"), stored, parts=16)
    records, checkpoint = hub.stream_hub_records(spark, str(tmp_path), one_per_file=False), work_path(spark, "checkpoint")

    def run(name):
        (tmp_path / f"{name}.json").write_text(json.dumps({"name": name, "code": "x = 1"}))
        jobs.hub_stream(records, log, lambda _: AS_OF, checkpoint).awaitTermination()
        return spark.range(0)

    run("fn_5")
    plans = executed(spark, lambda: run("fn_3"))
    part = log.touched(stored.filter("name = 'fn_3'"))
    scans = [s for p in plans for s in re.findall(rf"Location: InMemoryFileIndex \[[^\n]*{log.path}/(?:base|changes)[^\n]*\n([^\n]*)", p)]
    assert len(part) == 1 and len(scans) >= 3
    assert all(re.match(rf"PartitionFilters: .*\(part#\d+ = {part[0]}\)", s) for s in scans), scans
    assert log.current().filter("name = 'fn_3'").first()["code"] == "x = 1"
    assert log.current().count() == stored.count()


@pytest.mark.parametrize("name", ["stream_saves", "stream_save_rejected", "stream_embed_failures"])
def test_requests_are_written_by_many_tasks(spark, name):
    plans = executed(spark, lambda: registry.queries()[name](spark, SF_DIR))
    assert not any(re.search(r"\(\d+\) Coalesce\b", p) for p in plans)


@pytest.fixture
def small_partitions(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "16k")
    yield
    spark.conf.set(key, before)


def _files(spark, folder: str) -> int:
    return len({r.f for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).selectExpr("path AS f").collect()})


def test_a_large_shard_is_split_into_files(spark, small_partitions):
    records = spark.range(0, 400, 1, 8).selectExpr(
        "concat('n', id) AS name", "concat_ws('', transform(sequence(1, 20), i -> sha2(cast(id * 100 + i AS string), 512))) AS code", "'[]' AS test_cases"
    )
    folder = work_path(spark, "shards")
    hub.write_hub_records(records, folder, shards=2)
    assert _files(spark, folder) > 8
    assert sorted(r.name for r in hub.read_hub_records(spark, folder, one_per_file=False).records.select("name").collect()) == sorted(
        f"n{i}" for i in range(400)
    )


def test_a_large_part_of_changes_is_split_into_files(spark, stored, small_partitions):
    log = ChangeLog.over(work_path(spark, "split-log"), stored, parts=2)
    changed = stored.withColumn("code", F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.sha2(F.concat("name", i.cast("string")), 512))))
    log.write(0, changed.repartition(8))
    assert _files(spark, f"{log.path}/changes/batch=0") > 8
    assert sorted(log.current().select("name", "code").collect()) == sorted(changed.select("name", "code").collect())


def test_a_merge_moves_no_stored_texts(spark, stored):
    log = ChangeLog.over(work_path(spark, "light-log"), stored, parts=4)
    log.write(0, stored.filter("call_count > 2").withColumn("code", F.lit("x = 1")))
    last = stored.select("name", "code", "description")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = [exchanged([plan(df)]) for df in (log.current(), maintenance.record_actions(stored, last).select("name", "action"))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all(moved) and not any(re.search(r"[\[ ](code|description)#", m) for m in sum(moved, [])), moved


@pytest.mark.parametrize("copied", [10**6, 0])
def test_rows_are_found_by_their_places(spark, monkeypatch, copied):
    monkeypatch.setattr(ranking, "_COPIED", copied)
    path = work_path(spark, "numbers")
    spark.range(0, 70_000, 1, 1).write.parquet(path)
    spark.range(70_000, 70_300, 1, 3).write.mode("append").parquet(path)
    rows = ranking.placed(spark.read.parquet(path))
    wanted = F.col("id").isin(0, 7, 8, 32_767, 32_768, 65_535, 65_536, 69_999) | (F.col("id") % 1000 == 77) | (F.col("id") >= 70_250)
    places = rows.filter(wanted).select("_file", "_row")
    there, rest = (ranking.at_places(rows, places, "numbers-places", there=t) for t in (True, False))
    expected = {r.id for r in spark.range(70_300).filter(wanted).collect()}
    assert sorted(r.id for r in there.collect()) == sorted(expected)
    assert sorted(r.id for r in rest.collect()) == sorted(set(range(70_300)) - expected)


def test_shuffles_of_a_sparing_query_go_with_it(spark):
    def files() -> int:
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    spark.range(10).count()
    for _ in range(20):  # those of earlier tests go when the driver collects its garbage
        spark._jvm.System.gc()
        before = files()
        time.sleep(0.3)
        if files() == before:
            break
    with sparing_disk(spark):
        spark.range(0, 20_000, 1, 8).repartition(8, "id").write.parquet(work_path(spark, "sparing"))
        assert spark.conf.get("spark.sql.parquet.compression.codec") == "zstd"
    for _ in range(20):
        if files() <= before:
            break
        time.sleep(0.3)
    assert files() <= before
    assert spark.conf.get("spark.sql.parquet.compression.codec") == "snappy"
