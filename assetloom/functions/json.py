"""Typed access to the JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetloom import schemas


def string_list(text: Column) -> Column:
    """JSON list of strings; NULL, empty or malformed text gives an empty array."""
    return F.coalesce(F.from_json(text, schemas.STRING_LIST), F.array().cast("array<string>"))


def metadata(text: Column) -> Column:
    return F.from_json(text, schemas.METADATA)


def metadata_list(text: Column, field: str) -> Column:
    return string_list(F.get_json_object(text, f"$.{field}"))


def rounded_int(text: Column, path: str) -> Column:
    """JSON number as int, half to even; anything that is no number gives NULL."""
    number = F.get_json_object(text, path).try_cast("double")
    return F.rint(number).try_cast("int")


def number(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).try_cast("double")
