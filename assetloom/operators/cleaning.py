"""Whole-corpus sanitising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions import dates, text


def sanitize(assets: DataFrame) -> DataFrame:
    """Clean name, code, description and the ``tags`` array in place."""
    return assets.withColumns(
        {
            "name": text.clean_text(F.col("name")),
            "code": text.clean_code(F.col("code")),
            "description": text.clean_text(F.col("description")),
            "tags": text.clean_tags(F.col("tags")),
        }
    )


def default_description(description: Column, as_of: str) -> Column:
    """A blank description becomes a dated draft note; apply before sanitising."""
    stamp = F.date_format(dates.instant(as_of), "yyyy-MM-dd HH:mm:ss")
    return F.when(text.is_blank(description), F.concat(F.lit("Draft automatically saved by AI on "), stamp)).otherwise(
        description
    )
