"""Catalogue tables derived from the given test tables.

Each text is one SELECT that Spark SQL and DuckDB both run unchanged, so a
query and its check start from equal rows. Every view covers its whole source
table; variety comes from CASE expressions, never from dropped rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    "fx_functions": """
SELECT
  concat('fn_', cast(doc_id AS string)) AS name,
  concat(
    CASE doc_id % 6 WHEN 0 THEN 'import os' WHEN 1 THEN 'import numpy as np'
      WHEN 2 THEN 'from sklearn.linear_model import Ridge' WHEN 3 THEN 'import cv2, json'
      WHEN 4 THEN 'import math' ELSE 'import yaml' END, chr(10),
    CASE doc_id % 17 WHEN 3 THEN concat('KEY = "ghp_', repeat('a', 36), '"', chr(10))
      WHEN 4 THEN concat('KEY = "AIza', repeat('b', 35), '"', chr(10))
      WHEN 5 THEN concat('KEY = "sk-', repeat('c', 48), '"', chr(10)) ELSE '' END,
    'def ', CASE WHEN doc_id % 13 = 4 THEN '(' ELSE '' END, 'fn_', cast(doc_id AS string), '(a, b):', chr(10),
    repeat(concat('    # note', chr(10)), cast((doc_id % 8) * 20 AS int)),
    CASE WHEN doc_id % 11 = 5 THEN concat('    eval("1")', chr(10)) ELSE '' END,
    CASE doc_id % 29 WHEN 6 THEN concat('    a.system()', chr(10)) WHEN 7 THEN concat('    a.__class__', chr(10))
      WHEN 8 THEN concat('    from subprocess import run', chr(10)) WHEN 9 THEN concat('    from . import x', chr(10)) ELSE '' END,
    CASE WHEN doc_id > 0 THEN concat('    fn_', cast(cast(floor(doc_id / 2) AS bigint) AS string), '(a, b)', chr(10)) ELSE '' END,
    '    return a + b', chr(10)) AS code,
  concat(CASE WHEN doc_id % 5 = 0 THEN '  🚀 ' ELSE '' END, replace(text, chr(10), ' ')) AS description,
  concat('["', lang, '","', source, '"', CASE WHEN doc_id % 10 = 0 THEN ',"core"' ELSE '' END, ']') AS tags,
  concat('{"dependencies":[',
    CASE doc_id % 5 WHEN 0 THEN '"numpy>=1.20"' WHEN 1 THEN '"  requests==2.19","numpy"' WHEN 2 THEN ''
      WHEN 3 THEN '"pandas","scipy"' ELSE '"Flask==1.0"' END,
    '],"internal_dependencies":[',
    CASE WHEN doc_id > 0 THEN concat('"fn_', cast(cast(floor(doc_id / 2) AS bigint) AS string), '"') ELSE '' END, ']',
    CASE WHEN doc_id % 19 = 0 THEN '' ELSE concat(',"quality_score":', cast((doc_id * 37) % 101 AS string)) END, '}') AS metadata,
  CASE WHEN doc_id % 23 = 1 THEN 'deleted' WHEN doc_id % 13 = 4 THEN 'broken'
       WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'verified' ELSE 'pending' END AS status,
  CASE WHEN doc_id % 2 = 0 THEN '[{"input":{"a":2,"b":3},"expected":5}]' ELSE '[]' END AS test_cases,
  cast((doc_id * 7) % 5 AS int) AS call_count,
  CASE WHEN doc_id % 4 = 0 THEN concat('2024-01-', lpad(cast(1 + doc_id % 28 AS string), 2, '0'), ' 12:00:00') END AS last_called_at,
  concat('2023-12-', lpad(cast(1 + doc_id % 28 AS string), 2, '0'), 'T08:30:00') AS created_at,
  concat('2024-01-', lpad(cast(1 + doc_id % 28 AS string), 2, '0'), 'T08:30:00') AS updated_at
FROM documents""",
    # Beside the assets, chains and cycles of 200 that call the next one.
    "fx_linked": """
SELECT name, code, metadata FROM fx_functions
UNION ALL SELECT concat('chain_', cast(doc_id AS string)) AS name, concat('step(', cast(doc_id AS string), ')') AS code,
  concat('{"internal_dependencies":[', CASE WHEN doc_id % 200 < 199 THEN concat('"chain_', cast(doc_id + 1 AS string), '"') ELSE '' END, ']}')
    AS metadata FROM documents
UNION ALL SELECT concat('ring_', cast(doc_id AS string)) AS name, concat('turn(', cast(doc_id AS string), ')') AS code,
  concat('{"internal_dependencies":["ring_', cast(doc_id + CASE WHEN doc_id % 200 < 199 THEN 1 ELSE -199 END AS string), '"]}') AS metadata
FROM documents""",
    "fx_bundles": """
SELECT name FROM fx_names
UNION SELECT concat(CASE doc_id % 200 WHEN 0 THEN 'chain_' WHEN 100 THEN 'ring_' ELSE 'gone_' END, cast(doc_id AS string)) AS name
FROM documents""",
    "fx_embeddings": """
SELECT cast(vec_id AS bigint) AS id, concat('fn_', cast(vec_id AS string)) AS function_name, embedding AS vector,
  CASE WHEN vec_id % 29 = 0 THEN 'old-model' ELSE 'model-a' END AS model_name,
  64 AS dimension, '2024-01-01T00:00:00' AS encoded_at
FROM embeddings""",
    # Stored rows of an asset may repeat: each vector is held twice, encoded a day apart.
    "fx_held_embeddings": """
SELECT id, function_name, vector, model_name, dimension, encoded_at FROM fx_embeddings
UNION ALL
SELECT id + 1000000 AS id, function_name, vector, 'model-b' AS model_name, dimension,
  CASE WHEN id % 3 = 0 THEN '2023-12-31 00:00:00' ELSE '2024-01-02 00:00:00.5+00' END AS encoded_at
FROM fx_embeddings""",
    "fx_new_embeddings": """
SELECT id + 2000000 AS id, concat('fn_', cast(id + 250 AS string)) AS function_name, vector,
  'model-c' AS model_name, dimension, '2024-01-03T00:00:00' AS encoded_at
FROM fx_embeddings""",
    "fx_query_log": """
SELECT event_id AS req_id, ts, user_id,
  concat(CASE event_id % 3 WHEN 0 THEN 'Find ' WHEN 1 THEN 'find ' ELSE ' find ' END,
         event_type, ' ', cast(user_id % 40 AS string)) AS query
FROM events""",
    "fx_usage": """
SELECT event_id, concat('fn_', cast(user_id AS string)) AS name, ts FROM events""",
    "fx_lint_findings": """
SELECT concat('fn_', cast(l_orderkey AS string)) AS name, l_linenumber AS row_no,
  CASE WHEN l_returnflag = 'R' THEN 'F401' ELSE 'E501' END AS code_id, 'lint message' AS message
FROM lineitem""",
    "fx_static_findings": """
SELECT concat('fn_', cast(o_orderkey AS string)) AS name, cast(o_custkey AS int) AS line_no,
  CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'HIGH' WHEN '2' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  'static message' AS message
FROM orders""",
    "fx_format_results": """
SELECT concat('fn_', cast(doc_id AS string)) AS name, doc_id % 4 <> 1 AS passed FROM documents
UNION ALL SELECT concat('fn_', cast(doc_id AS string)) AS name, true AS passed FROM documents""",
    "fx_advisories": """
SELECT * FROM (VALUES ('requests', 'ADV-1', 'header leak'), ('flask', 'ADV-2', 'dos'), ('flask', 'ADV-3', 'xss'))
  AS t(package, advisory_id, advisory)""",
    # Every asset has a second review that says nothing, and sorts before the first.
    "fx_reviews": """
SELECT concat('fn_', cast(doc_id AS string)) AS name,
  CASE doc_id % 4 WHEN 0 THEN concat('Result: {"feedback":"ok","score":', cast((doc_id * 13) % 101 AS string), '} done')
    WHEN 1 THEN '{"feedback":"no score"}' WHEN 2 THEN 'no json' ELSE '{bad json}' END AS llm_output
FROM documents
UNION ALL SELECT concat('fn_', cast(doc_id AS string)) AS name, 'A remark' AS llm_output FROM documents""",
    # Cases 7 mod 20 differ in the last of 16 digits; those 8 and 9 mod 10 are equal as values, not as text.
    "fx_test_results": """
SELECT concat('fn_', cast(user_id AS string)) AS name, event_id AS case_no,
  CASE event_id % 10 WHEN 7 THEN '9007199254740993' WHEN 8 THEN 'true' WHEN 9 THEN '{"k": [1, 2], "m": 3}' ELSE props END AS expected,
  CASE WHEN event_type = 'error' THEN cast(NULL AS string) WHEN event_id % 20 = 7 THEN '9007199254740992'
    WHEN event_id % 20 = 17 THEN '9007199254740993' WHEN event_id % 10 = 8 THEN '1.0'
    WHEN event_id % 10 = 9 THEN '{"m":3,"k":[1,2]}' WHEN event_type = 'click' THEN '{"k": 0}' ELSE props END AS actual,
  CASE WHEN event_type = 'error' THEN 'Traceback: boom' END AS trace
FROM events""",
    # Records without code, and an older record for every name.
    "fx_hub_records": """
SELECT CASE WHEN doc_id % 5 = 1 THEN concat('hub_', cast(doc_id AS string)) ELSE name END AS name,
  CASE WHEN doc_id % 11 = 2 THEN cast(NULL AS string) WHEN doc_id % 3 = 0 THEN code ELSE concat('# v2', chr(10), code) END AS code,
  description, tags, '[]' AS dependencies, 80 AS quality_score, '2024-01-20T00:00:00' AS updated_at
FROM (SELECT f.*, cast(substring(f.name, 4) AS bigint) AS doc_id FROM fx_functions f) x
UNION ALL
SELECT CASE WHEN doc_id % 5 = 1 THEN concat('hub_', cast(doc_id AS string)) ELSE name END AS name, concat('# v1', chr(10), code) AS code,
  'older' AS description, tags, '[]' AS dependencies, 10 AS quality_score, '2024-01-19T23:59:59' AS updated_at
FROM (SELECT f.*, cast(substring(f.name, 4) AS bigint) AS doc_id FROM fx_functions f) y""",
    "fx_save_requests": """
SELECT doc_id AS seq,
  concat(CASE WHEN doc_id % 3 = 0 THEN ' fn__' WHEN doc_id % 3 = 1 THEN 'fn_' ELSE 'new_🚀_' END,
         cast(cast(floor(doc_id / 2) AS bigint) AS string)) AS name,
  concat('# ☕ draft', chr(10), code) AS code,
  CASE WHEN doc_id % 4 = 0 THEN '   ' ELSE description END AS description,
  '["a  b","🚀"]' AS tags, test_cases
FROM (SELECT f.*, cast(substring(f.name, 4) AS bigint) AS doc_id FROM fx_functions f) x""",
    # Names to look up or delete: labelled documents; toxic ones stand for unknown names.
    "fx_names": """
SELECT concat(CASE toxic WHEN 1 THEN 'gone_' ELSE 'fn_' END, cast(doc_id AS string)) AS name FROM labels""",
    # Two verdicts for each asset; those of toxic ones disagree.
    "fx_verdicts": """
SELECT concat('fn_', cast(doc_id AS string)) AS name, CASE quality WHEN 1 THEN 'verified' ELSE 'failed' END AS status
FROM labels
UNION ALL SELECT concat('fn_', cast(doc_id AS string)) AS name,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'verified' ELSE 'failed' END AS status FROM labels""",
    "fx_rerank": """
SELECT doc_id AS query_id,
  CASE WHEN quality = 1 THEN concat('fn_', cast(doc_id + 1 AS string)) WHEN toxic = 1 THEN '' ELSE concat('hub_', cast(doc_id AS string)) END
    AS selected_name
FROM labels""",
    "fx_config": """
SELECT 'embedding_model' AS key, max(model_name) AS value FROM fx_embeddings
UNION ALL SELECT concat('label_', cast(label AS string)) AS key, cast(count(*) AS string) AS value FROM embeddings GROUP BY label""",
}


_SOURCE = re.compile(r"\b(?:FROM|JOIN)\s+(\w+)")


def _views_for(body: str) -> dict[str, str]:
    """Views a SELECT reads, each after those it needs itself."""
    needed: dict[str, str] = {}

    def add(text: str) -> None:
        for name in _SOURCE.findall(text):
            if name in VIEWS and name not in needed:
                add(VIEWS[name])
                needed[name] = VIEWS[name]

    add(body)
    return needed


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """A SELECT (with CTEs of its own or not) behind the views it reads."""
    ctes = {**(extra or {}), **_views_for(body)}
    if not ctes:
        return body
    body = body.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    head = ",\n".join(f"{name} AS ({text.strip()})" for name, text in ctes.items())
    keyword = "WITH RECURSIVE" if own and own.group(1) else "WITH"
    return f"{keyword} {head}" + (",\n" + body[own.end():] if own else "\n" + body)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or derived view as a DataFrame; no temporary view is left behind."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    body = f"SELECT * FROM {name}"
    read = {b for text in [body, *_views_for(body).values()] for b in _SOURCE.findall(text) if b in BASE}
    bases = {b: f"SELECT * FROM parquet.`{sf_dir}/{b}.parquet`" for b in sorted(read)}
    return spark.sql(with_views(body, bases))
