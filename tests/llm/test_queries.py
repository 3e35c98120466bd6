"""The named queries: against their SQL where there is some, the pipeline against a plain version."""

from __future__ import annotations

import math

import numpy as np
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from assetloom.llm import quality, queries
from tests.compare import differences, duck_connection
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_sql(spark, duck, name):
    assert differences(driver.queries()[name](spark, SF_DIR), duck, driver.oracle_sql()[name]) == ""


def test_quality_query(spark):
    out = driver.queries()["op2_quality"](spark, SF_DIR)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert out.where("predicted = int(score >= 0.3)").count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_simhash_query_equals_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in driver.queries()["op6_simhash"](spark, SF_DIR).collect()}
    groups = brute.near_groups(docs)
    assert got == {d: (f"{brute.fingerprint(t):016x}", groups[d]) for d, t in docs}


def test_embedding_query_equals_brute_force(spark):
    rows = driver.queries()["op9_embedding_dedup"](spark, SF_DIR).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()}
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in vectors.items()}
    ids = sorted(unit)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sum(x * y for x, y in zip(unit[a], unit[b], strict=True)) >= 0.9]
    assert {r.vec_id: r.component_id for r in rows} == brute.components(ids, pairs)
    assert sum(r.n_links for r in rows) == 2 * len(pairs)


def test_decontamination_query_equals_plain_search(spark):
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    got = {r.doc_id for r in driver.queries()["op10_decontaminate"](spark, SF_DIR).collect()}
    assert got == {d.doc_id for d in docs if brute.holds_item(d.text, items)} and got


def test_pipeline_equals_plain_version(spark):
    read = lambda t: spark.read.parquet(f"{SF_DIR}/{t}.parquet")
    docs = read("documents")
    model = quality.train(docs, read("labels"))
    x = {r.doc_id: r.x for r in quality.with_statistics(docs).collect()}
    score = {d: float(model.score(np.array([v]))[0]) for d, v in x.items()}
    rows = {r.doc_id: (r.text, r.source) for r in docs.collect() if score[r.doc_id] >= corpus_pipeline.LEAST_SCORE}
    kept = brute.line_dedup([(d, t) for d, (t, _) in rows.items()])
    rows = {d: (kept[d][2], s) for d, (_, s) in rows.items()}
    groups = brute.near_groups([(d, t) for d, (t, _) in rows.items()])
    items = [r.text for r in read("benchmark").collect()]
    rows = {d: v for d, v in rows.items() if groups[d] == d and not brute.holds_item(v[0], items)}
    plain = brute.taken([(d, t, s) for d, (t, s) in rows.items()])
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert got.keys() == plain.keys()
    for d, (size, source_size, target, taken) in plain.items():
        assert (got[d]["size"], got[d].source_size, got[d].taken) == (size, source_size, taken)
        assert math.isclose(got[d].target, target)


@pytest.mark.parametrize("step", [s for s in corpus_pipeline.STAGES[:-1]], ids=lambda s: s[0])
def test_stages_take_odd_rows(spark, step):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, h1 int, taken int"
    rows = [(1, None, None, None, None, "x", 1, 2), (1, None, None, None, None, "x", 1, 2), (None, "", "en", "s", 0, None, None, None),
            (2, "words " * 50_000, "en", "s", 5, "x", 1, 2), (3, "A line that three of the documents hold.\n", "en", "s", 5, "x", 1, 2)]
    for own in (rows, []):
        docs = spark.createDataFrame(own, schema)
        out = step[1](spark, docs, SF_DIR)
        assert out.columns == docs.columns and out.count() <= len(own)


def test_mixing_stage_takes_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.mix_sources(spark, docs, SF_DIR).count() == 0
