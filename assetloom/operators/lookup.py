"""Listings and lookups by a table of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.functions import json


def matching(stored: DataFrame, names: DataFrame, key: str = "name", named: str = "name") -> DataFrame:
    """Stored rows whose ``key`` is among the column ``named`` of ``names``.

    An outer join from a small batch to a large table cannot copy the batch, as
    the batch is the side to keep; this semi-join can, so the large table stays
    where it is and only matching rows go on to the outer join.
    """
    return stored.join(names.select(F.col(named).alias(key)), key, "left_semi")


def list_assets(functions: DataFrame, limit: int = 100) -> DataFrame:
    """The first assets by name; only three columns are scanned."""
    return functions.select("name", "status", "description").orderBy("name").limit(limit)


def get_code(functions: DataFrame, names: DataFrame) -> DataFrame:
    stored = matching(functions.select("name", "code"), names).withColumn("found", F.lit(True))
    # Fixed value: the answer for an unknown name, and below the same without a point.
    message = F.concat(F.lit("Function '"), F.col("name"), F.lit("' not found."))
    return names.select("name").join(stored, "name", "left").select(
        "name",
        F.coalesce("found", F.lit(False)).alias("found"),
        F.when(F.col("found"), F.col("code")).otherwise(message).alias("code"),
    )


def get_details(functions: DataFrame, names: DataFrame) -> DataFrame:
    stored = matching(functions, names).select(
        "name",
        F.lit(True).alias("found"),
        "status",
        "description",
        json.string_list(F.col("tags")).alias("tags"),
        "call_count",
        "last_called_at",
        "code",
        F.coalesce(F.when(F.col("metadata") != "", F.col("metadata")), F.lit("{}")).alias("metadata"),
    )
    missing = F.concat(F.lit("Function '"), F.col("name"), F.lit("' not found"))
    return (
        names.select("name")
        .join(stored, "name", "left")
        .withColumn("found", F.coalesce("found", F.lit(False)))
        .withColumn("error", F.when(~F.col("found"), missing))
    )


def publishable(functions: DataFrame) -> DataFrame:
    """Everything not deleted; an asset without a status is left out too."""
    return functions.filter("status != 'deleted'")


def review_prompts(functions: DataFrame, store: str = "asset catalogue") -> DataFrame:
    """One review prompt per asset for an offline model run."""
    task = (
        "Judge how sound, safe and clear this code is. Answer with one JSON object: "
        "\"feedback\", a sentence, and \"score\", a number from 0 (unusable) to 100 (dependable)."
    )
    lead = F.lit(f"A function from the {store} is up for review.\nName: ")
    description, code = F.coalesce("description", F.lit("")), F.coalesce("code", F.lit(""))
    prompt = F.concat(
        lead, "name", F.lit("\nDescription: "), description, F.lit("\nCode:\n"), code, F.lit(f"\n\n{task}")
    )
    return functions.select("name", prompt.alias("prompt"))
