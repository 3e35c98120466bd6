"""How long an asset survives, and which ones go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.functions import dates, json

# Weights, limits and tags that protect an asset.
FREQUENCY_WEIGHT, QUALITY_WEIGHT = 5.0, 1.0
DEFAULT_QUALITY = 50
THRESHOLD, GRACE_DAYS = 0.5, 14
PROTECTED_TAGS = ["protected", "core", "stable"]
EXEMPT_STATUS = ["deleted", "archived"]


def retention_score(functions: DataFrame, as_of: str) -> DataFrame:
    """Use per day alive plus quality; ``score`` is NULL where the quality is no number."""
    stored = F.get_json_object("metadata", "$.quality_score")
    quality = F.when(stored.isNull(), F.lit(float(DEFAULT_QUALITY))).otherwise(json.number(F.col("metadata"), "$.quality_score"))
    active = dates.days_since(F.col("created_at"), as_of) + 1
    last = F.coalesce(F.nullif("last_called_at", F.lit("")), F.col("created_at"))
    score = (F.col("call_count") / active) * FREQUENCY_WEIGHT + (quality / 100.0) * QUALITY_WEIGHT
    return functions.select(
        "name",
        score.alias("score"),
        dates.days_since(last, as_of).alias("days_inactive"),
        quality.isNull().alias("bad_quality"),
    )


def forget_candidates(
    functions: DataFrame, as_of: str, threshold: float = THRESHOLD, grace_days: int = GRACE_DAYS
) -> DataFrame:
    protected = F.arrays_overlap(json.string_list(F.col("tags")), F.array(*map(F.lit, PROTECTED_TAGS)))
    open_to_forget = functions.filter(~F.col("status").isin(EXEMPT_STATUS)).filter(~F.coalesce(protected, F.lit(False)))
    scored = retention_score(open_to_forget, as_of)
    return scored.filter((F.col("days_inactive") >= grace_days) & (F.col("score") < threshold)).select(
        "name", "score", "days_inactive"
    )
