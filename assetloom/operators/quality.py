"""Scores and verdicts from tables of findings.

Penalties come from counts, which fold before the shuffle; finding texts stay
one row each in ``finding_lines``, so no asset's findings meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions import json
from assetloom.functions.text import line_count, strip
from assetloom.operators.ranking import running_total

# Penalty weights, caps and tiers.
LINT_WEIGHT, LINT_CAP = 500, 70
FORMAT_PENALTY = 30
SEVERITY_WEIGHTS, OTHER_WEIGHT, STATIC_CAP = {"HIGH": 40, "MEDIUM": 20}, 5, 80
ADVISORY_WEIGHT, ADVISORY_CAP = 30, 90
HIGH_FROM, MEDIUM_FROM = 80, 50
NEUTRAL_SCORE = 50
FORMATTED, UNFORMATTED = "Code is formatted correctly (Ruff).", "Code requires formatting (Ruff)."


def reliability(score: Column) -> Column:
    return F.when(score >= HIGH_FROM, "high").when(score >= MEDIUM_FROM, "medium").otherwise("low")


def lint_penalty(functions: DataFrame, findings: DataFrame) -> DataFrame:
    """Errors per line of code, scaled and capped."""
    counts = findings.groupBy("name").agg(F.count("*").alias("lint_errors"))
    errors = F.coalesce("lint_errors", F.lit(0))
    density = errors / F.col("lines")
    lines = functions.select("name", line_count(F.col("code")).alias("lines"))
    return lines.join(counts, "name", "left").select(
        "name",
        errors.alias("lint_errors"),
        F.least(density * LINT_WEIGHT, F.lit(float(LINT_CAP))).alias("lint_penalty"),
    )


def format_penalty(results: DataFrame) -> DataFrame:
    """A repeated asset passes when all its rows do."""
    passed = F.col("passed")
    return results.groupBy("name").agg(F.bool_and("passed").alias("passed")).select(
        "name",
        passed.alias("formatted"),
        F.when(passed, FORMATTED).otherwise(UNFORMATTED).alias("format_feedback"),
        F.when(passed, 0).otherwise(FORMAT_PENALTY).alias("format_penalty"),
    )


def static_penalty(findings: DataFrame) -> DataFrame:
    weight = F.lit(OTHER_WEIGHT)
    for severity, points in SEVERITY_WEIGHTS.items():
        weight = F.when(F.col("severity") == severity, points).otherwise(weight)
    return findings.groupBy("name").agg(
        F.count("*").alias("static_findings"), F.least(F.sum(weight), F.lit(STATIC_CAP)).alias("static_penalty")
    )


def _bare_package(requirement: Column) -> Column:
    return F.lower(strip(F.regexp_replace(strip(requirement), r"(?s)[<>=!~;\[ ].*$", "")))


def advisory_hits(functions: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies that an advisory names, one row per pair."""
    deps = json.metadata_list(F.col("metadata"), "dependencies")
    wanted = functions.select("name", F.explode(deps).alias("d")).select("name", _bare_package(F.col("d")).alias("package"))
    return wanted.join(advisories.withColumn("package", F.lower("package")), "package")


def advisory_penalty(functions: DataFrame, advisories: DataFrame) -> DataFrame:
    hits = advisory_hits(functions, advisories).groupBy("name").agg(F.count("*").alias("advisories"))
    points = F.least(F.col("advisories") * ADVISORY_WEIGHT, F.lit(ADVISORY_CAP))
    return hits.withColumn("advisory_penalty", points)


def finding_lines(lint: DataFrame, static: DataFrame, functions: DataFrame, advisories: DataFrame) -> DataFrame:
    """Every finding as printed text, equal copies folded (before they are printed) with their count."""

    def folded(findings: DataFrame, tool: str, line_no: Column, *parts: str | Column) -> DataFrame:
        keys = [c for c in ("name", "row_no", "line_no", "code_id", "severity", "message", "package", "advisory_id", "advisory")
                if c in findings.columns]
        counted = findings.groupBy(*keys).agg(F.count("*").alias("copies"))
        text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
        return counted.select("name", F.lit(tool).alias("tool"), line_no.alias("line_no"), text.alias("text"), "copies")

    col = F.col
    hits = advisory_hits(functions, advisories)
    tables = [
        folded(lint, "lint", col("row_no"), "Line ", col("row_no"), " [", col("code_id"), "]: ", col("message")),
        folded(static, "static", col("line_no"), "Line ", col("line_no"), " [", col("severity"), "]: ", col("message")),
        folded(hits, "advisory", F.lit(None).cast("int"), "Dependency [", col("package"), "] (ID: ", col("advisory_id"), "): ", col("advisory")),
    ]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def quality_report(
    functions: DataFrame, lint: DataFrame, formats: DataFrame, static: DataFrame, advisories: DataFrame
) -> DataFrame:
    """Score, tier and the nested report header per asset."""
    joined = (
        lint_penalty(functions, lint)
        .join(format_penalty(formats), "name", "left")
        .join(static_penalty(static), "name", "left")
        .join(advisory_penalty(functions, advisories), "name", "left")
    )
    zeros = {c: 0 for c in ("format_penalty", "static_penalty", "advisory_penalty", "static_findings", "advisories")}
    joined = joined.fillna({**zeros, "formatted": True, "format_feedback": ""})
    security = F.col("static_penalty") + F.col("advisory_penalty")
    score = F.floor(F.greatest(F.lit(0.0), 100 - F.col("lint_penalty") - F.col("format_penalty") - security)).cast("int")
    scored = joined.withColumn("final_score", score)
    return scored.select(
        "name",
        "final_score",
        reliability(F.col("final_score")).alias("reliability"),
        F.struct((F.col("lint_errors") == 0).alias("passed"), F.col("lint_errors").alias("errors")).alias("linter"),
        F.struct(F.col("formatted").alias("passed"), F.col("format_feedback").alias("feedback")).alias("formatter"),
        F.struct(
            F.struct(
                (F.col("static_penalty") == 0).alias("passed"),
                F.col("static_findings").alias("findings"),
                F.col("static_penalty").alias("score_penalty"),
            ).alias("static"),
            F.struct(
                (F.col("advisory_penalty") == 0).alias("passed"),
                F.col("advisories").alias("findings"),
                F.col("advisory_penalty").alias("score_penalty"),
            ).alias("advisories"),
        ).alias("security"),
        F.lit("").alias("quality_feedback"),
    )


def blend_review(report: DataFrame, reviews: DataFrame) -> DataFrame:
    """Average the static score with a model's review where one can be read.

    The review is the text from the first ``{`` to the last ``}``. A missing
    score counts as neutral; a null or non-numeric one leaves the report as is.
    Of several reviews of an asset, the last in text order counts.
    """
    reviews = reviews.groupBy("name").agg(F.max("llm_output").alias("llm_output"))
    body = F.regexp_extract("llm_output", r"(?s)\{.*\}", 0)
    review = F.try_parse_json(F.nullif(body, F.lit("")))
    parsed = reviews.select(
        "name",
        review.isNotNull().alias("readable"),
        F.get_json_object(body, "$.feedback").alias("feedback"),
        F.schema_of_variant(F.try_variant_get(review, "$.score", "variant")).alias("score_type"),
        F.try_variant_get(review, "$.score", "double").alias("score"),
    )
    numeric = F.col("score_type").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    missing = F.col("score_type").isNull()
    ai_score = F.when(missing, F.lit(float(NEUTRAL_SCORE))).when(numeric, F.col("score"))
    usable = F.coalesce(F.col("readable"), F.lit(False)) & ai_score.isNotNull()
    blended = ((F.col("final_score") + ai_score) / 2).try_cast("int")
    feedback = F.concat(
        F.lit("AI: "), F.coalesce("feedback", F.lit("")), F.lit(" | Hub: "), F.col("formatter.feedback")
    )
    joined = report.join(parsed, "name", "left").withColumns(
        {
            "final_score": F.when(usable, blended).otherwise(F.col("final_score")),
            "quality_feedback": F.when(usable, feedback).otherwise(F.col("quality_feedback")),
        }
    )
    return joined.withColumn("reliability", reliability(F.col("final_score"))).select(*report.columns)


def _same_number(a: Column, b: Column) -> Column:
    """Equal numbers, exactly; ``true`` and ``false`` are 1 and 0, as in the language of the tests.

    Doubles that are equal may stand for different decimals, so the digits decide
    where 38 of them can hold both.
    """
    a, b = (F.when(x == "true", "1").when(x == "false", "0").otherwise(x) for x in (a, b))
    exact = a.try_cast("decimal(38,18)") == b.try_cast("decimal(38,18)")
    whole = a.rlike(r"^-?\d+$") & b.rlike(r"^-?\d+$") & (a.try_cast("double") != 0)
    return F.when(whole, a == b).otherwise((a.try_cast("double") == b.try_cast("double")) & F.coalesce(exact, F.lit(True)))


def _same_value(a: Column, b: Column) -> Column:
    """Equal as JSON text, as numbers when both are, or as JSON values whatever their key order.

    Only values that are objects or lists are parsed as such.
    """
    nested = a.rlike(r"^\s*[\[{]") & b.rlike(r"^\s*[\[{]")
    as_values = F.when(nested, F.to_json(F.try_parse_json(a)) == F.to_json(F.try_parse_json(b)))
    same = F.when(nested, as_values).otherwise(_same_number(a, b))
    return F.when(a.eqNullSafe(b), True).otherwise(F.coalesce(same, F.lit(False)))


def failed_cases(results: DataFrame) -> DataFrame:
    """One row per failed case with its message; cases count from 1 in messages."""
    shown = F.col("case_no") + 1
    crashed = F.concat(F.lit("Test "), shown, F.lit(": Runtime Error - "), F.col("trace"))
    differs = F.concat(
        F.lit("Test "), shown, F.lit(": Expected "), F.coalesce("expected", F.lit("None")), F.lit(", got "),
        F.coalesce("actual", F.lit("None")),
    )
    wrong = ~_same_value(F.col("expected"), F.col("actual"))
    message = F.when(F.col("trace").isNotNull(), crashed).when(wrong, differs)
    return results.select("name", "case_no", message.alias("message"))


def evaluate_test_results(results: DataFrame) -> DataFrame:
    """Verdict per asset from counts alone."""
    failed = F.count("message")
    return failed_cases(results).groupBy("name").agg(
        F.count("*").alias("cases"), failed.alias("failures"), F.when(failed > 0, "error").otherwise("success").alias("status")
    )


def case_errors(results: DataFrame) -> DataFrame:
    """The failed cases, one row each, whatever their number."""
    return failed_cases(results).filter("message IS NOT NULL").select("name", "case_no", "message")


def joined_errors(results: DataFrame, part_bytes: int) -> DataFrame:
    """Error texts in case order joined by ``; ``, in parts of about ``part_bytes``.

    For readers that want text. Rows are dealt by range, and sizes summed within
    ranges, so no asset's messages meet in one task or one row.
    """
    cases = case_errors(results).withColumn("size", F.octet_length("message") + 2)
    placed = running_total(cases, ["name"], ["case_no", "message"], "size", "case-errors")
    part = F.floor(F.col("before") / part_bytes).cast("long").alias("part_no")
    ordered = F.array_sort(F.collect_list(F.struct("case_no", "message")))
    text = F.array_join(F.transform(ordered, lambda m: m["message"]), "; ")
    return placed.groupBy("name", part).agg(text.alias("error"))


def verification_status(functions: DataFrame, verdicts: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Next status per asset.

    Skipped: verified. No tests: pending_tests. Tests without any verdict: the
    runner failed, error_internal. A broken asset stays broken. Of several
    verdicts of an asset an error counts.
    """
    has_tests = F.coalesce(F.size(F.from_json("test_cases", "array<string>")) > 0, F.lit(False))
    base = functions.select("name", "status", has_tests.alias("has_tests"))
    judged = verdicts.groupBy("name").agg(F.min("status").alias("verdict"))
    joined = base.join(judged, "name", "left")
    skip = F.lit(False)
    if skipped is not None:
        joined = joined.join(skipped.select("name").distinct().withColumn("skip", F.lit(True)), "name", "left")
        skip = F.coalesce("skip", F.lit(False))
    outcome = (
        F.when(F.col("status") == "broken", "broken")
        .when(skip, "verified")
        .when(~F.col("has_tests"), "pending_tests")
        .when(F.col("verdict") == "success", "verified")
        .when(F.col("verdict") == "error", "failed")
        .otherwise("error_internal")
    )
    return joined.select("name", outcome.alias("status"))
