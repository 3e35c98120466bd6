"""Scans, lookups, cleaning, maintenance, retention and triage."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.functions import text
from assetloom.operators import cleaning, embeddings, lookup, maintenance, retention, triage
from assetloom.plans import duck
from assetloom.plans.registry import AS_OF, AS_OF_ISO, Tables, query
from assetloom.session import cut_lineage, work_path
from assetloom.sources import catalog, hub, record_files



def joined(column: str):
    return F.array_join(column, "|").alias(column)


def save_batch(t: Tables) -> DataFrame:
    return t.fx_save_requests.withColumn("tags", F.from_json("tags", "array<string>")).withColumn(
        "dependencies", F.array(F.lit("numpy"))
    )


def hub_records(t: Tables) -> DataFrame:
    records = t.fx_hub_records
    return records.withColumns({c: F.from_json(c, "array<string>") for c in ("tags", "dependencies")}).withColumn(
        "quality_score", F.col("quality_score").cast("double")
    )


def digest_vectors(texts: list[str]) -> list[list[float]]:
    """A stand-in provider: the bytes of the text's MD5 digest, four times."""
    return [[float(b) for b in hashlib.md5(t.encode()).digest()] * 4 for t in texts]


def fragile_vectors(texts: list[str]) -> list[list[float] | None]:
    """The same, but no vector where the first byte is below 64, and too short a one below 128."""
    made = digest_vectors(texts)
    return [None if v[0] < 64 else v[:16] if v[0] < 128 else v for v in made]


def no_vectors(texts: list[str]) -> list[list[float] | None]:
    return [None] * len(texts)


# --- scans and lookups ------------------------------------------------------

@query("catalog_snapshot", """
SELECT name, code, description, tags, metadata, nullif(status, 'failed') AS status, test_cases, nullif(call_count, 3) AS call_count,
  last_called_at, created_at, updated_at
FROM fx_functions""")
def catalog_snapshot(t):
    """A stored NULL is no missing column: it reads as NULL."""
    base = work_path(t.spark, "catalog")
    nulls = {"status": F.nullif("status", F.lit("failed")), "call_count": F.nullif("call_count", F.lit(3))}
    catalog.write_snapshot(t.fx_functions.withColumns(nulls), base, "functions", 1)
    catalog.write_snapshot(t.fx_embeddings, base, "embeddings", 1)
    catalog.write_snapshot(t.fx_config, base, "config", 1)
    return catalog.read_catalog(t.spark, base, 1).functions


@query("catalog_older_layout", "SELECT name, 'active' AS status, 0 AS call_count FROM fx_functions")
def catalog_older_layout(t):
    """A version written before there were statuses and counters."""
    base = work_path(t.spark, "catalog")
    catalog.write_snapshot(t.fx_functions.drop("status", "call_count"), base, "functions", 1)
    catalog.write_snapshot(t.fx_embeddings, base, "embeddings", 1)
    catalog.write_snapshot(t.fx_config, base, "config", 1)
    return catalog.read_catalog(t.spark, base, 1).functions.select("name", "status", "call_count")


@query("catalog_typed", f"""
SELECT name, {duck.joined(duck.strings('tags'))} AS tags,
  {duck.joined(duck.meta_strings('metadata', 'internal_dependencies'))} AS calls,
  CAST(json_extract(metadata, '$.quality_score') AS DOUBLE) AS quality_score,
  CAST(json_array_length(test_cases) AS INTEGER) AS cases,
  CAST(last_called_at AS TIMESTAMP) AS last_called_at, CAST(created_at AS TIMESTAMP) AS created_at
FROM fx_functions""")
def catalog_typed(t):
    return catalog.typed_view(t.fx_functions).select(
        "name", joined("tags"), F.array_join("metadata.internal_dependencies", "|").alias("calls"),
        F.col("metadata.quality_score").alias("quality_score"), F.size("test_cases").alias("cases"),
        "last_called_at", "created_at",
    )


@query("catalog_list", "SELECT name, status, description FROM fx_functions ORDER BY name LIMIT 100")
def catalog_list(t):
    return lookup.list_assets(t.fx_functions)


@query("catalog_code", """
SELECT n.name, f.name IS NOT NULL AS found,
  CASE WHEN f.name IS NULL THEN concat('Function ''', n.name, ''' not found.') ELSE f.code END AS code
FROM fx_names n LEFT JOIN fx_functions f ON f.name = n.name""")
def catalog_code(t):
    return lookup.get_code(t.fx_functions, t.fx_names)


@query("catalog_details", f"""
SELECT n.name, f.status, f.description, {duck.joined(duck.strings('f.tags'))} AS tags, f.call_count, f.last_called_at,
  f.code, f.metadata, CASE WHEN f.name IS NULL THEN concat('Function ''', n.name, ''' not found') END AS error
FROM fx_names n LEFT JOIN fx_functions f ON f.name = n.name""")
def catalog_details(t):
    return lookup.get_details(t.fx_functions, t.fx_names).drop("found").withColumn("tags", F.array_join("tags", "|"))


@query("publishable", "SELECT name, status FROM fx_functions WHERE status != 'deleted'")
def publishable(t):
    return lookup.publishable(t.fx_functions).select("name", "status")


@query("masked_view", """
SELECT name, description, tags, metadata, status, test_cases, call_count, last_called_at, created_at, updated_at
FROM fx_functions""")
def masked_view(t):
    return catalog.masked_view(t.fx_functions)


@query("review_prompts", """
SELECT name, concat('A function from the asset catalogue is up for review.', chr(10), 'Name: ', name, chr(10), 'Description: ',
  description, chr(10), 'Code:', chr(10), code, chr(10), chr(10),
  'Judge how sound, safe and clear this code is. Answer with one JSON object: "feedback", a sentence, ',
  'and "score", a number from 0 (unusable) to 100 (dependable).') AS prompt
FROM fx_functions""")
def review_prompts(t):
    return lookup.review_prompts(t.fx_functions)


# --- record folders ---------------------------------------------------------

HUB_EXPORT_SQL = f"""
SELECT name, code, description, {duck.joined(duck.strings('tags'))} AS tags, test_cases,
  {duck.joined(duck.meta_strings('metadata', 'dependencies'))} AS dependencies,
  coalesce(CAST(json_extract(metadata, '$.quality_score') AS DOUBLE), 0) AS quality_score, '{AS_OF_ISO}' AS updated_at
FROM fx_functions WHERE status != 'deleted'"""


@query("hub_export", HUB_EXPORT_SQL)
def hub_export(t):
    records = hub.export_hub_records(t.fx_functions, AS_OF)
    return records.withColumns({c: F.array_join(c, "|") for c in ("tags", "dependencies")})


@query("hub_round_trip", HUB_EXPORT_SQL)
def hub_round_trip(t):
    """Export, write as JSON records, scan them again."""
    folder = work_path(t.spark, "records")
    hub.write_hub_records(hub.export_hub_records(t.fx_functions, AS_OF), folder, shards=4)
    records = hub.read_hub_records(t.spark, folder, one_per_file=False).records
    return records.drop("file_path").withColumns({c: F.array_join(c, "|") for c in ("tags", "dependencies")})


@query("hub_files", HUB_EXPORT_SQL)
def hub_files(t):
    """The same through one file per asset."""
    folder = work_path(t.spark, "record-files")
    record_files.write_record_files(hub.export_hub_records(t.fx_functions, AS_OF), folder)
    records = record_files.read_record_files(t.spark, folder).records
    return records.drop("file_path").withColumns({c: F.array_join(c, "|") for c in ("tags", "dependencies")})


@query("hub_index", f"""
SELECT name, description, {duck.joined(duck.strings('tags'))} AS tags FROM fx_hub_records""")
def hub_index(t):
    return hub.build_hub_index(hub_records(t)).withColumn("tags", F.array_join("tags", "|"))


_ACTIONS = """
SELECT h.*, CASE WHEN h.code IS NULL THEN 'skipped' WHEN f.name IS NULL THEN 'insert' WHEN h.code IS DISTINCT FROM f.code
  OR h.description IS DISTINCT FROM f.description THEN 'update' ELSE 'unchanged' END AS action,
  f.status AS f_status, f.test_cases AS f_tests, f.call_count AS f_calls, f.last_called_at AS f_last, f.created_at AS f_created
FROM (SELECT * FROM fx_hub_records QUALIFY row_number() OVER (PARTITION BY name ORDER BY updated_at DESC) = 1) h
LEFT JOIN fx_functions f ON f.name = h.name"""


HUB_MERGE_SQL = f"""
WITH a AS ({_ACTIONS})
SELECT name, code, description, tags, '{{"dependencies":[],"quality_score":80,"sync_source":"github-hub"}}' AS metadata,
  CASE action WHEN 'insert' THEN 'active' ELSE f_status END AS status, f_tests AS test_cases,
  CASE action WHEN 'insert' THEN 0 ELSE f_calls END AS call_count, f_last AS last_called_at,
  CASE action WHEN 'insert' THEN '{AS_OF_ISO}' ELSE f_created END AS created_at, '{AS_OF_ISO}' AS updated_at
FROM a WHERE action IN ('insert', 'update')
UNION ALL
SELECT name, code, description, tags, metadata, status, test_cases, call_count, last_called_at, created_at, updated_at
FROM fx_functions WHERE name NOT IN (SELECT name FROM a WHERE action IN ('insert', 'update'))"""


@query("hub_merge", HUB_MERGE_SQL)
def hub_merge(t):
    return maintenance.merge_hub(t.fx_functions, hub_records(t), AS_OF)


@query("sync_counts", f"""
WITH a AS ({_ACTIONS})
SELECT count(*) FILTER (WHERE action = 'insert') AS "insert", count(*) FILTER (WHERE action = 'update') AS "update",
  count(*) FILTER (WHERE action = 'unchanged') AS unchanged, count(*) FILTER (WHERE action = 'skipped') AS skipped,
  count(*) AS total FROM a""")
def sync_counts(t):
    return hub.sync_counts(maintenance.hub_actions(t.fx_functions, hub_records(t)))


# --- cleaning ---------------------------------------------------------------

@query("clean_text", f"""
SELECT doc_id, {duck.clean_text('text')} AS text, {duck.clean_text('f.description')} AS description
FROM documents d JOIN fx_functions f ON f.name = concat('fn_', CAST(d.doc_id AS VARCHAR))""")
def clean_text(t):
    docs = t.documents.select("doc_id", text.clean_text(F.col("text")).alias("text"),
                              F.concat(F.lit("fn_"), "doc_id").alias("name"))
    cleaned = t.fx_functions.select("name", text.clean_text(F.col("description")).alias("description"))
    return docs.join(cleaned, "name").drop("name")


@query("clean_code", f"SELECT seq, {duck.clean_code('code')} AS code FROM fx_save_requests")
def clean_code(t):
    return t.fx_save_requests.select("seq", text.clean_code(F.col("code")).alias("code"))


@query("sanitize", f"""
SELECT seq, {duck.clean_text('name')} AS name, {duck.clean_code('code')} AS code, {duck.clean_text('description')} AS description,
  {duck.joined(f"list_filter(list_transform({duck.strings('tags')}, lambda x: {duck.clean_text('x')}), lambda x: x != '')")} AS tags
FROM fx_save_requests""")
def sanitize(t):
    return cleaning.sanitize(save_batch(t)).select("seq", "name", "code", "description", joined("tags"))


def described(now: str) -> str:
    return f"""CASE WHEN {duck.strip("coalesce(description, '')")} = ''
  THEN concat('Draft automatically saved by AI on ', {now}) ELSE description END"""


@query("default_description", f"SELECT seq, {described(f"'{AS_OF}'")} AS description FROM fx_save_requests")
def default_description(t):
    return t.fx_save_requests.select(
        "seq", cleaning.default_description(F.col("description"), AS_OF).alias("description")
    )


# --- maintenance ------------------------------------------------------------

# The code of a request parses unless its document's rule says otherwise.
def judged_saves(now: str) -> str:
    return f"""
SELECT seq, {duck.clean_text('name')} AS name, {duck.clean_code('code')} AS code,
  {duck.clean_text(described(now))} AS description, '["a b"]' AS tags, seq % 13 != 4 AS parses, test_cases,
  CASE WHEN seq % 17 IN (3, 4, 5) THEN 'REJECTED: Secret detected in code.' END AS reason
FROM fx_save_requests"""


_SAVES = judged_saves(f"'{AS_OF}'")
LAST_SAVES = f"""
WITH s AS ({_SAVES}),
last AS (SELECT * FROM s WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC) = 1)"""


@query("save_assets", f"""{LAST_SAVES}
SELECT l.name, l.code, l.description, l.tags,
  concat('{{"dependencies":["numpy"],"saved_at":"{AS_OF_ISO}","quality_score":', CASE WHEN parses THEN '50' ELSE '0' END, '}}')
    AS metadata,
  CASE WHEN parses THEN 'pending' ELSE 'broken' END AS status, l.test_cases, coalesce(f.call_count, 0) AS call_count,
  f.last_called_at, '{AS_OF_ISO}' AS created_at, '{AS_OF_ISO}' AS updated_at
FROM last l LEFT JOIN fx_functions f ON f.name = l.name
UNION ALL
SELECT name, code, description, tags, metadata, status, test_cases, call_count, last_called_at, created_at, updated_at
FROM fx_functions WHERE name NOT IN (SELECT name FROM last)""")
def save_assets(t):
    return maintenance.save_assets(t.fx_functions, save_batch(t), AS_OF).accepted


@query("save_rejected", f"WITH s AS ({_SAVES}) SELECT seq, name, reason FROM s WHERE reason IS NOT NULL")
def save_rejected(t):
    return maintenance.prepare_saves(save_batch(t), AS_OF).rejected


@query("delete_assets", "SELECT name, status FROM fx_functions WHERE name NOT IN (SELECT name FROM fx_names)")
def delete_assets(t):
    return maintenance.delete_assets(t.fx_functions, t.fx_embeddings, t.fx_names)[0].select("name", "status")


@query("delete_embeddings", "SELECT id, function_name FROM fx_embeddings WHERE function_name NOT IN (SELECT name FROM fx_names)")
def delete_embeddings(t):
    return maintenance.delete_assets(t.fx_functions, t.fx_embeddings, t.fx_names)[1].select("id", "function_name")


VERDICTS = """SELECT name, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'verified' END AS status
FROM fx_verdicts GROUP BY name"""


@query("apply_status", f"""
SELECT f.name, coalesce(v.status, f.status) AS status,
  CASE WHEN v.name IS NULL THEN f.updated_at ELSE '{AS_OF_ISO}' END AS updated_at
FROM fx_functions f LEFT JOIN ({VERDICTS}) v ON v.name = f.name""")
def apply_status(t):
    return maintenance.apply_status(t.fx_functions, t.fx_verdicts, AS_OF).select("name", "status", "updated_at")


# --- retention and triage ---------------------------------------------------

def _days(expr: str) -> str:
    return f"greatest(0, CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(CAST({expr} AS TIMESTAMP))) / 86400000000) AS INTEGER))"


_RETENTION = f"""
SELECT name, status, tags,
  (call_count / ({_days('created_at')} + 1)) * 5.0
    + (coalesce(CAST(json_extract(metadata, '$.quality_score') AS DOUBLE), 50) / 100.0) * 1.0 AS score,
  {_days("coalesce(nullif(last_called_at, ''), created_at)")} AS days_inactive
FROM fx_functions"""

_FORGET = f"""
SELECT name, round(score, 9) AS score, days_inactive FROM ({_RETENTION})
WHERE status NOT IN ('deleted', 'archived') AND days_inactive >= 14 AND score < 0.5
  AND NOT list_has_any({duck.strings('tags')}, ['protected', 'core', 'stable'])"""


@query("retention_score", f"SELECT name, round(score, 9) AS score, days_inactive FROM ({_RETENTION})")
def retention_score(t):
    scored = retention.retention_score(t.fx_functions, AS_OF)
    return scored.select("name", F.round("score", 9).alias("score"), "days_inactive")


@query("forget_candidates", _FORGET)
def forget_candidates(t):
    return retention.forget_candidates(t.fx_functions, AS_OF).withColumn("score", F.round("score", 9))


@query("archive_assets", f"""
SELECT name, CASE WHEN name IN (SELECT name FROM ({_FORGET})) THEN 'archived' ELSE status END AS status,
  CASE WHEN name IN (SELECT name FROM ({_FORGET})) THEN '{AS_OF_ISO}' ELSE updated_at END AS updated_at
FROM fx_functions""")
def archive_assets(t):
    candidates = retention.forget_candidates(t.fx_functions, AS_OF)
    return maintenance.archive_assets(t.fx_functions, candidates, AS_OF).select("name", "status", "updated_at")


_QUALITY = duck.rounded_int("metadata", "quality_score")


@query("triage_broken", f"""
SELECT name, status, {_QUALITY} AS quality_score, description FROM fx_functions
WHERE {_QUALITY} < 70 AND status != 'deleted' ORDER BY {_QUALITY}, name LIMIT 5""")
def triage_broken(t):
    return triage.broken_assets(t.fx_functions)


@query("triage_report", f"""
SELECT name, status, {_QUALITY} AS quality_score, code, '' AS errors, '' AS verification_error, '' AS quality_feedback,
  '{{}}' AS security_report, coalesce(nullif(concat_ws('|',
    CASE WHEN status = 'broken' THEN 'CRITICAL: Syntax error detected. Use Cursor or your preferred AI to fix the code structure before deployment.' END,
    CASE WHEN {_QUALITY} < 50 THEN 'NOTE: Quality score is very low. Consider adding docstrings, type hints, and running a formatter.' END,
    CASE WHEN status = 'failed' THEN 'WARNING: Unit tests failed. Review the test_results for specific failures.' END), ''), 'Logic is stable. Minor refinements may improve the quality score further.') AS actionable_advice,
  {duck.joined(duck.meta_strings('metadata', 'dependencies'))} AS dependencies,
  {duck.joined(duck.meta_strings('metadata', 'internal_dependencies'))} AS internal_dependencies
FROM fx_functions""")
def triage_report(t):
    lists = ("errors", "actionable_advice", "dependencies", "internal_dependencies")
    return triage.diagnostic_report(t.fx_functions).withColumns({c: F.array_join(c, "|") for c in lists})


# --- embeddings -------------------------------------------------------------

_V0 = "round(CAST(vector[1] AS DOUBLE), 6) AS first_value"


def _embedding_columns(df: DataFrame) -> DataFrame:
    first = F.round(F.col("vector")[0].cast("double"), 6).alias("first_value")
    return df.select("id", "function_name", "model_name", "dimension", "encoded_at", first)


def _text_sql(deps: bool) -> str:
    dep_line = f"chr(10), 'Deps: ', {duck.list_literal(duck.meta_strings('metadata', 'dependencies'))}," if deps else ""
    return f"""concat('Name: ', name, chr(10), 'Desc: ', description, chr(10), 'Tags: ', {duck.list_literal(duck.strings('tags'))},
  {dep_line} chr(10), 'Code:', chr(10), code)"""


@query("embedding_text", f"SELECT name, {_text_sql(True)} AS text FROM fx_functions")
def embedding_text(t):
    return embeddings.embedding_text(t.fx_functions)


@query("embedding_text_short", f"SELECT name, {_text_sql(False)} AS text FROM fx_functions")
def embedding_text_short(t):
    return embeddings.embedding_text(t.fx_functions, with_deps=False)


_STALE = """
SELECT DISTINCT f.name, CASE WHEN e.function_name IS NULL THEN 'missing' ELSE 'outdated' END AS reason
FROM fx_functions f LEFT JOIN fx_embeddings e ON f.name = e.function_name
WHERE e.model_name != 'model-a' OR e.dimension != 64 OR e.function_name IS NULL"""


@query("embedding_text_compatible", f"SELECT name, replace({_text_sql(True)}, code, substring(code, 1, 500)) AS text FROM fx_functions")
def embedding_text_compatible(t):
    return embeddings.embedding_text(t.fx_functions, code_chars=embeddings.COMPATIBLE_CODE_CHARS)


@query("embeddings_stale", _STALE)
def embeddings_stale(t):
    return embeddings.stale_embeddings(t.fx_functions, t.fx_embeddings, "model-a", 64)


_HELD_ORDER = "CAST(replace(replace(encoded_at, '+00', ''), 'T', ' ') AS TIMESTAMP)"


_UPSERT = f"""
WITH held AS (SELECT * FROM fx_held_embeddings WHERE function_name NOT IN (SELECT function_name FROM fx_new_embeddings)
  QUALIFY row_number() OVER (PARTITION BY function_name ORDER BY {_HELD_ORDER} DESC, id DESC) = 1)
SELECT id, function_name, model_name, dimension, encoded_at, {_V0} FROM held
UNION ALL SELECT id, function_name, model_name, dimension, encoded_at, {_V0} FROM fx_new_embeddings"""


@query("embeddings_upsert", _UPSERT)
def embeddings_upsert(t):
    held = cut_lineage(t.fx_held_embeddings, "held")
    return _embedding_columns(embeddings.upsert_embeddings(held, t.fx_new_embeddings, one_per_asset=False, layout="written"))


def bucketed_version(t: Tables) -> catalog.Catalog:
    base = work_path(t.spark, "catalog")
    catalog.write_bucketed_snapshot(catalog.Catalog(t.fx_functions, t.fx_held_embeddings, t.fx_config), base, 1, buckets=8)
    return catalog.read_catalog(t.spark, base, 1)


@query("bucketed_upsert", _UPSERT)
def bucketed_upsert(t):
    held = bucketed_version(t).embeddings
    return _embedding_columns(embeddings.upsert_embeddings(held, t.fx_new_embeddings, one_per_asset=False, layout="bucketed"))


@query("bucketed_stale", _STALE.replace("fx_embeddings", "fx_held_embeddings"))
def bucketed_stale(t):
    stored = bucketed_version(t)
    return embeddings.stale_embeddings(stored.functions, stored.embeddings, "model-a", 64)


@query("embedding_drift", """
SELECT e.function_name, round(list_cosine_similarity(CAST(e.vector AS DOUBLE[]), CAST(n.vector AS DOUBLE[])), 6) AS score
FROM fx_embeddings e JOIN fx_new_embeddings n ON n.function_name = e.function_name""")
def embedding_drift(t):
    drift = embeddings.embedding_drift(t.fx_embeddings, t.fx_new_embeddings)
    return drift.select("function_name", F.round("score", 6).alias("score"))


_REFRESHED = f"""
WITH stale AS ({_STALE}),
fresh AS (SELECT name, md5({_text_sql(True)}) AS digest FROM fx_functions WHERE name IN (SELECT name FROM stale))
SELECT function_name, model_name, dimension, encoded_at, {_V0} FROM fx_embeddings
WHERE function_name NOT IN (SELECT name FROM stale)
UNION ALL
SELECT name AS function_name, 'model-a' AS model_name, 64 AS dimension, '{AS_OF_ISO}' AS encoded_at,
  CAST(CAST(concat('0x', substring(digest, 1, 2)) AS INTEGER) AS DOUBLE) AS first_value FROM fresh"""


@query("embed_refresh", _REFRESHED)
def embed_refresh(t):
    refreshed = embeddings.refresh_embeddings(t.fx_functions, t.fx_embeddings, digest_vectors, "model-a", 64, AS_OF)
    return _embedding_columns(refreshed.embeddings).drop("id")


@query("embed_reused", _REFRESHED)
def embed_reused(t):
    """The same once a first run has stored its vectors: the second makes none itself."""
    none = t.spark.createDataFrame([], embeddings.VECTOR_STORE)
    stored = embeddings.refresh_embeddings(t.fx_functions, t.fx_embeddings, digest_vectors, "model-a", 64, AS_OF, store=none).store
    again = embeddings.refresh_embeddings(
        t.fx_functions, t.fx_embeddings, no_vectors, "model-a", 64, AS_OF, store=cut_lineage(stored, "vector-store")
    )
    return _embedding_columns(again.embeddings).drop("id")


@query("embed_failures", f"""
WITH stale AS ({_STALE}),
d AS (SELECT name, CAST(concat('0x', substring(md5({_text_sql(True)}), 1, 2)) AS INTEGER) AS head FROM fx_functions)
SELECT name, CASE WHEN head < 64 THEN 'provider gave no vector' ELSE '64 values wanted, got 16' END AS error
FROM d WHERE head < 128 AND name IN (SELECT name FROM stale)""")
def embed_failures(t):
    return embeddings.refresh_embeddings(t.fx_functions, t.fx_embeddings, fragile_vectors, "model-a", 64, AS_OF).failed


@query("model_version", """
SELECT key, value FROM fx_config WHERE key != 'embedding_model' UNION ALL SELECT 'embedding_model' AS key, 'model-z' AS value""")
def model_version(t):
    return embeddings.model_version_check(t.fx_config, "model-z")
