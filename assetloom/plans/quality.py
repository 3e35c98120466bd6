"""Penalties, reports, reviews and test verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.operators import quality
from assetloom.plans import duck
from assetloom.plans.registry import Tables, query

_LINES = "(length(code) - length(replace(code, chr(10), '')) + 1)"
_LINT = f"""
SELECT f.name, coalesce(n, 0) AS lint_errors, least(coalesce(n, 0) / {_LINES} * 500, 70) AS lint_penalty
FROM fx_functions f LEFT JOIN (SELECT name, count(*) AS n FROM fx_lint_findings GROUP BY name) l ON l.name = f.name"""
_FORMATS = "SELECT name, bool_and(passed) AS passed FROM fx_format_results GROUP BY name"
_FEEDBACK = "CASE WHEN {} THEN 'Code is formatted correctly (Ruff).' ELSE 'Code requires formatting (Ruff).' END"
_STATIC = """
SELECT name, count(*) AS static_findings, CAST(least(sum(CASE severity WHEN 'HIGH' THEN 40 WHEN 'MEDIUM' THEN 20 ELSE 5 END), 80) AS BIGINT)
  AS static_penalty FROM fx_static_findings GROUP BY name"""
_HITS = f"""
SELECT d.name, a.package, a.advisory_id, a.advisory FROM (
  SELECT name, unnest({duck.meta_strings('metadata', 'dependencies')}) AS dep FROM fx_functions) d
JOIN fx_advisories a ON a.package = lower(regexp_extract(d.dep, '^\\s*([^<>=!~;\\[\\s]*)', 1))"""
_ADVISORY = f"""
SELECT name, count(*) AS advisories, least(count(*) * 30, 90) AS advisory_penalty FROM ({_HITS}) GROUP BY name"""


@query("lint_penalty", f"SELECT name, lint_errors, round(lint_penalty, 6) AS lint_penalty FROM ({_LINT})")
def lint_penalty(t):
    scored = quality.lint_penalty(t.fx_functions, t.fx_lint_findings)
    return scored.withColumn("lint_penalty", F.round("lint_penalty", 6))


@query("format_penalty", f"""
SELECT name, passed AS formatted, {_FEEDBACK.format('passed')} AS format_feedback,
  CASE WHEN passed THEN 0 ELSE 30 END AS format_penalty FROM ({_FORMATS})""")
def format_penalty(t):
    return quality.format_penalty(t.fx_format_results)


@query("static_penalty", _STATIC)
def static_penalty(t):
    return quality.static_penalty(t.fx_static_findings)


@query("advisory_penalty", _ADVISORY)
def advisory_penalty(t):
    return quality.advisory_penalty(t.fx_functions, t.fx_advisories)


@query("finding_lines", f"""
SELECT name, 'lint' AS tool, row_no AS line_no, concat('Line ', CAST(row_no AS VARCHAR), ' [', code_id, ']: ', message) AS text,
  count(*) AS copies FROM fx_lint_findings GROUP BY ALL
UNION ALL
SELECT name, 'static' AS tool, line_no, concat('Line ', CAST(line_no AS VARCHAR), ' [', severity, ']: ', message) AS text,
  count(*) AS copies FROM fx_static_findings GROUP BY ALL
UNION ALL
SELECT name, 'advisory' AS tool, CAST(NULL AS INTEGER) AS line_no,
  concat('Dependency [', package, '] (ID: ', advisory_id, '): ', advisory) AS text, count(*) AS copies FROM ({_HITS}) GROUP BY ALL""")
def finding_lines(t):
    return quality.finding_lines(t.fx_lint_findings, t.fx_static_findings, t.fx_functions, t.fx_advisories)


def report(t: Tables) -> DataFrame:
    return quality.quality_report(
        t.fx_functions, t.fx_lint_findings, t.fx_format_results, t.fx_static_findings, t.fx_advisories
    )


def _tier(score: str) -> str:
    return f"CASE WHEN {score} >= 80 THEN 'high' WHEN {score} >= 50 THEN 'medium' ELSE 'low' END"


_REPORT = f"""
SELECT l.name, CAST(floor(greatest(0, 100 - lint_penalty - CASE WHEN p.passed THEN 0 ELSE 30 END
  - (coalesce(static_penalty, 0) + coalesce(advisory_penalty, 0)))) AS INTEGER) AS final_score,
  lint_errors, p.passed AS formatted, coalesce(static_findings, 0) AS static_findings, coalesce(advisories, 0) AS advisories
FROM ({_LINT}) l JOIN ({_FORMATS}) p ON p.name = l.name LEFT JOIN ({_STATIC}) s ON s.name = l.name
LEFT JOIN ({_ADVISORY}) a ON a.name = l.name"""


@query("quality_report", f"""
SELECT name, final_score, {_tier('final_score')} AS reliability, lint_errors = 0 AS lint_passed, lint_errors, formatted,
  {_FEEDBACK.format('formatted')} AS feedback, static_findings, advisories
FROM ({_REPORT})""")
def quality_report(t):
    return report(t).select(
        "name", "final_score", "reliability", F.col("linter.passed").alias("lint_passed"),
        F.col("linter.errors").alias("lint_errors"), F.col("formatter.passed").alias("formatted"),
        F.col("formatter.feedback").alias("feedback"), F.col("security.static.findings").alias("static_findings"),
        F.col("security.advisories.findings").alias("advisories"),
    )


_ID = duck.doc_id()
_BLENDED = f"""CASE {_ID} % 4 WHEN 0 THEN CAST(trunc((final_score + ({_ID} * 13) % 101) / 2) AS INTEGER)
  WHEN 1 THEN CAST(trunc((final_score + 50) / 2) AS INTEGER) ELSE final_score END"""


@query("quality_blend", f"""
SELECT name, {_BLENDED} AS final_score, {_tier(_BLENDED)} AS reliability,
  CASE WHEN {_ID} % 4 < 2 THEN concat('AI: ', CASE {_ID} % 4 WHEN 0 THEN 'ok' ELSE 'no score' END, ' | Hub: ',
    {_FEEDBACK.format('formatted')}) ELSE '' END AS quality_feedback
FROM ({_REPORT})""")
def quality_blend(t):
    blended = quality.blend_review(report(t), t.fx_reviews)
    return blended.select("name", "final_score", "reliability", "quality_feedback")


_CASES = """
SELECT name, case_no, CASE WHEN trace IS NOT NULL THEN concat('Test ', CAST(case_no + 1 AS VARCHAR), ': Runtime Error - ', trace)
  WHEN case_no % 10 IN (8, 9) THEN NULL
  WHEN case_no % 20 = 7 OR expected IS DISTINCT FROM actual THEN concat('Test ', CAST(case_no + 1 AS VARCHAR), ': Expected ', expected, ', got ', actual)
  END AS message FROM fx_test_results"""
_VERDICTS = f"""
SELECT name, count(*) AS cases, count(message) AS failures, CASE WHEN count(message) > 0 THEN 'error' ELSE 'success' END AS status
FROM ({_CASES}) GROUP BY name"""


@query("test_verdicts", _VERDICTS)
def test_verdicts(t):
    return quality.evaluate_test_results(t.fx_test_results)


@query("test_errors", f"SELECT name, case_no, message FROM ({_CASES}) WHERE message IS NOT NULL")
def test_errors(t):
    return quality.case_errors(t.fx_test_results)


@query("test_error_texts", f"""
SELECT name, part_no, string_agg(message, '; ' ORDER BY case_no) AS error FROM (
  SELECT name, case_no, message, CAST(floor((sum(octet_length(encode(message)) + 2) OVER (PARTITION BY name ORDER BY case_no)
    - octet_length(encode(message)) - 2) / 500) AS BIGINT) AS part_no FROM ({_CASES}) WHERE message IS NOT NULL) GROUP BY ALL""")
def test_error_texts(t):
    return quality.joined_errors(t.fx_test_results, part_bytes=500)


@query("verification_status", f"""
SELECT f.name, CASE WHEN f.status = 'broken' THEN 'broken' WHEN s.name IS NOT NULL THEN 'verified'
  WHEN f.test_cases = '[]' THEN 'pending_tests' WHEN v.status = 'success' THEN 'verified' WHEN v.status = 'error' THEN 'failed'
  ELSE 'error_internal' END AS status
FROM fx_functions f LEFT JOIN ({_VERDICTS}) v ON v.name = f.name LEFT JOIN fx_names s ON s.name = f.name""")
def verification_status(t):
    verdicts = quality.evaluate_test_results(t.fx_test_results)
    return quality.verification_status(t.fx_functions, verdicts, skipped=t.fx_names)
