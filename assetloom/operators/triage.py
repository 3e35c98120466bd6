"""Low-quality assets and what to do about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.functions import json

# Cutoffs and advice texts.
BROKEN_LIMIT, QUALITY_CUTOFF, POOR_BELOW = 5, 70, 50
ADVICE_BROKEN = (
    "CRITICAL: Syntax error detected. Use Cursor or your preferred AI to fix the code structure before deployment."
)
ADVICE_POOR = (
    "NOTE: Quality score is very low. Consider adding docstrings, type hints, and running a formatter."
)
ADVICE_FAILED = "WARNING: Unit tests failed. Review the test_results for specific failures."
ADVICE_STABLE = "Logic is stable. Minor refinements may improve the quality score further."


def broken_assets(functions: DataFrame, limit: int = BROKEN_LIMIT, cutoff: int = QUALITY_CUTOFF) -> DataFrame:
    """Worst assets first; the code is not scanned."""
    quality = json.rounded_int(F.col("metadata"), "$.quality_score")
    scored = functions.filter("status != 'deleted'").select("name", "status", quality.alias("quality_score"), "description")
    return scored.filter(F.col("quality_score") < cutoff).orderBy("quality_score", "name").limit(limit)


def diagnostic_report(functions: DataFrame) -> DataFrame:
    """Advice and the metadata fields behind it, for every asset."""
    meta = F.col("metadata")
    quality = json.rounded_int(meta, "$.quality_score")
    problems = F.array_compact(
        F.array(
            F.when(F.col("status") == "broken", ADVICE_BROKEN),
            F.when(quality < POOR_BELOW, ADVICE_POOR),
            F.when(F.col("status") == "failed", ADVICE_FAILED),
        )
    )
    advice = F.when(F.size(problems) > 0, problems).otherwise(F.array(F.lit(ADVICE_STABLE)))

    def text(field: str, default: str):
        return F.coalesce(F.get_json_object(meta, f"$.{field}"), F.lit(default))

    return functions.select(
        "name", "status", quality.alias("quality_score"), "code",
        json.metadata_list(meta, "errors").alias("errors"),
        text("verification_error", "").alias("verification_error"),
        text("quality_feedback", "").alias("quality_feedback"),
        text("security", "{}").alias("security_report"),
        advice.alias("actionable_advice"),
        json.metadata_list(meta, "dependencies").alias("dependencies"),
        json.metadata_list(meta, "internal_dependencies").alias("internal_dependencies"),
    )
