"""Secrets, syntax, security verdicts, dependencies and bundles.

The views' code is generated from the document number, so SQL can state what a
parse must find without parsing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom.functions import json
from assetloom.operators import deps, facts, security
from assetloom.plans import duck
from assetloom.plans.registry import query

_ID = duck.doc_id()
_BROKEN = f"{_ID} % 13 = 4"
_SYNTAX = f"concat('Syntax Error: invalid syntax (<unknown>, line ', CASE WHEN {_ID} % 17 IN (3, 4, 5) THEN '3' ELSE '2' END, ')')"
_PARENT = f"concat('fn_', CAST(CAST(floor({_ID} / 2) AS BIGINT) AS VARCHAR))"
TOKEN_PATTERN = 'token = "[0-9a-f]{40}"'


@query("secret_scan", f"""
SELECT name, CASE WHEN {_ID} % 17 = 3 THEN concat('ghp_', repeat('a', 36)) WHEN {_ID} % 17 = 4 THEN concat('AIza', repeat('b', 35))
  WHEN {_ID} % 17 = 5 THEN concat('sk-', repeat('c', 48)) ELSE '' END AS secret, {_ID} % 17 IN (3, 4, 5) AS has_secret
FROM fx_functions""")
def secret_scan(t):
    return security.scan_secrets(t.fx_functions, "code").select("name", "secret", "has_secret")


@query("secret_matches", f"""
SELECT doc_id, 0 AS pattern_no, unnest(regexp_extract_all(text, '{TOKEN_PATTERN}')) AS secret FROM documents""")
def secret_matches(t):
    return security.all_secrets(t.documents, "doc_id", "text", [TOKEN_PATTERN])


@query("code_facts", f"""
SELECT name, 'syntax_error' AS kind, {_SYNTAX} AS value FROM fx_functions WHERE {_BROKEN}
UNION ALL
SELECT name, CASE {_ID} % 6 WHEN 2 THEN 'import_from' ELSE 'import' END AS kind,
  unnest(CASE {_ID} % 6 WHEN 0 THEN ['os'] WHEN 1 THEN ['numpy'] WHEN 2 THEN ['sklearn.linear_model']
    WHEN 3 THEN ['cv2', 'json'] WHEN 4 THEN ['math'] ELSE ['yaml'] END) AS value FROM fx_functions WHERE NOT {_BROKEN}
UNION ALL SELECT name, 'call' AS kind, 'eval' AS value FROM fx_functions WHERE NOT {_BROKEN} AND {_ID} % 11 = 5
UNION ALL SELECT name, 'call' AS kind, {_PARENT} AS value FROM fx_functions WHERE NOT {_BROKEN} AND {_ID} > 0
UNION ALL SELECT name, CASE {_ID} % 29 WHEN 6 THEN 'attr_call' WHEN 7 THEN 'dunder' ELSE 'import_from' END AS kind,
  CASE {_ID} % 29 WHEN 6 THEN 'system' WHEN 7 THEN '__class__' ELSE 'subprocess' END AS value
FROM fx_functions WHERE NOT {_BROKEN} AND {_ID} % 29 IN (6, 7, 8)""")
def code_facts(t):
    return facts.fact_rows(facts.with_facts(t.fx_functions)).select("name", "kind", "value")


_MESSAGE = f"""CASE WHEN {_BROKEN} THEN {_SYNTAX}
  WHEN {_ID} % 6 = 0 THEN 'Security Block: Import of ''os'' is forbidden.'
  WHEN {_ID} % 29 = 8 THEN 'Security Block: Import from ''subprocess'' is forbidden.'
  WHEN {_ID} % 11 = 5 THEN 'Security Block: Direct call to ''eval'' is forbidden.'
  WHEN {_ID} % 29 = 6 THEN 'Security Block: Attribute call ''system'' is forbidden.'
  WHEN {_ID} % 29 = 7 THEN 'Security Block: Access to dunder attribute ''__class__'' is forbidden.' ELSE '' END"""


@query("security_verdict", f"SELECT name, {_MESSAGE} = '' AS is_safe, {_MESSAGE} AS message FROM fx_functions")
def security_verdict(t):
    return security.security_verdict(facts.with_facts(t.fx_functions))


@query("security_violations", f"""
SELECT name, 'Security Block: Import of ''os'' is forbidden.' AS message FROM fx_functions WHERE NOT {_BROKEN} AND {_ID} % 6 = 0
UNION ALL SELECT name, 'Security Block: Direct call to ''eval'' is forbidden.' AS message FROM fx_functions
WHERE NOT {_BROKEN} AND {_ID} % 11 = 5
UNION ALL SELECT name, CASE {_ID} % 29 WHEN 6 THEN 'Security Block: Attribute call ''system'' is forbidden.'
  WHEN 7 THEN 'Security Block: Access to dunder attribute ''__class__'' is forbidden.'
  ELSE 'Security Block: Import from ''subprocess'' is forbidden.' END AS message
FROM fx_functions WHERE NOT {_BROKEN} AND {_ID} % 29 IN (6, 7, 8)""")
def security_violations(t):
    return security.violations(facts.with_facts(t.fx_functions)).select("name", "message")


@query("syntax_status", f"""
SELECT name, CASE WHEN {_BROKEN} THEN 'broken' ELSE 'pending' END AS status,
  CASE WHEN {_BROKEN} THEN 0 ELSE 50 END AS quality_score FROM fx_functions""")
def syntax_status(t):
    return security.syntax_status(facts.with_facts(t.fx_functions))


@query("required_packages", f"""
SELECT name, CASE WHEN {_BROKEN} THEN '' ELSE CASE {_ID} % 6 WHEN 1 THEN 'numpy' WHEN 2 THEN 'scikit-learn'
  WHEN 3 THEN 'opencv-python' WHEN 5 THEN 'PyYAML' ELSE '' END END AS packages FROM fx_functions""")
def required_packages(t):
    return deps.required_packages(facts.with_facts(t.fx_functions)).withColumn("packages", F.array_join("packages", "|"))


@query("internal_edges", f"SELECT name AS src, {_PARENT} AS dst FROM fx_functions WHERE NOT {_BROKEN} AND {_ID} > 0")
def internal_edges(t):
    return deps.internal_edges(facts.with_facts(t.fx_functions), t.fx_functions)


@query("internal_dependencies", f"""
SELECT name, CASE WHEN NOT {_BROKEN} AND {_ID} > 0 THEN {_PARENT} ELSE '' END AS calls FROM fx_functions""")
def internal_dependencies(t):
    edges = deps.internal_edges(facts.with_facts(t.fx_functions), t.fx_functions)
    return deps.internal_dependencies(edges, t.fx_functions).withColumn("calls", F.array_join("calls", "|"))


# Every asset of the view calls one other at most, so a walk is a path; it ends where a ring closes.
_WALK = f"""
WITH RECURSIVE next AS (
  SELECT name, json_extract_string(metadata, '$.internal_dependencies[0]') AS called FROM fx_linked),
walk AS (
  SELECT name AS root, name AS node, 0 AS depth FROM next WHERE name IN (SELECT name FROM fx_bundles)
  UNION ALL SELECT w.root, k.name AS node, w.depth + 1 AS depth
  FROM walk w JOIN next n ON n.name = w.node JOIN next k ON k.name = n.called WHERE k.name <> w.root AND w.depth < 1000)"""


@query("bundle_closure", f"{_WALK} SELECT root, node, depth FROM walk")
def bundle_closure(t):
    return deps.bundle_closure(deps.declared_edges(t.fx_linked), t.fx_bundles, t.fx_linked)


@query("bundle_code", f"""{_WALK},
sections AS (SELECT root, depth, concat('# --- ', name, ' ---', chr(10), code) AS section FROM walk JOIN fx_linked ON name = node)
SELECT root, 0 AS part_no, string_agg(section, concat(chr(10), chr(10)) ORDER BY depth DESC) AS code FROM sections GROUP BY root
UNION ALL
SELECT name AS root, 0 AS part_no, 'Not found.' AS code FROM fx_bundles WHERE name NOT IN (SELECT name FROM fx_linked)""")
def bundle_code(t):
    order = deps.bundle_order(deps.declared_edges(t.fx_linked), t.fx_bundles, t.fx_linked)
    return deps.bundle_code(order, t.fx_linked, t.fx_bundles, part_bytes=1 << 20)


_DEPS = duck.meta_strings("metadata", "dependencies")
_LOWERED = f"array_to_string(list_sort(list_transform({_DEPS}, lambda d: lower(trim(d)))), '|')"
_BARE = f"list_transform({_DEPS}, lambda d: lower(trim(split_part(split_part(d, '==', 1), '>=', 1))))"


_OFFERED = {
    "data-science": "['numpy', 'pandas', 'scipy', 'scikit-learn', 'matplotlib']",
    "web-scraping": "['requests', 'beautifulsoup4', 'httpx', 'lxml']",
}


def _base(name: str) -> str:
    offered = _OFFERED[name]
    fits = f"len(list_filter({_BARE}, lambda d: NOT list_contains({offered}, d))) = 0"
    digest = f"substring(sha256(array_to_string(list_sort({offered}), '|')), 1, 8)"
    return f"WHEN {fits} THEN concat('base_{name}_', {digest})"


_ENVIRONMENT = f"""CASE WHEN len({_DEPS}) = 0 THEN 'default' {' '.join(map(_base, _OFFERED))}
  ELSE substring(sha256({_LOWERED}), 1, 12) END"""


@query("env_fingerprint", f"SELECT name, {_ENVIRONMENT} AS environment FROM fx_functions")
def env_fingerprint(t):
    wanted = json.metadata_list(F.col("metadata"), "dependencies")
    return t.fx_functions.select("name", deps.env_fingerprint(wanted).alias("environment"))


@query("environment_plan", f"""
SELECT environment, count(*) AS assets, min(wanted) AS sample_requirements
FROM (SELECT {_ENVIRONMENT} AS environment, {_LOWERED} AS wanted FROM fx_functions) GROUP BY environment""")
def environment_plan(t):
    return deps.environment_plan(t.fx_functions)
