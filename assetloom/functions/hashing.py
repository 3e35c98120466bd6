"""Stable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetloom.functions.text import strip


def normalised_query(query: Column) -> Column:
    return strip(F.lower(query))


def query_key(query: Column) -> Column:
    return F.md5(query.cast("binary"))


def secret_key(key: Column) -> Column:
    return F.sha2(key.cast("binary"), 256)
