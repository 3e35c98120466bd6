"""The named queries, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from assetloom.plans.tables import table, with_views

AS_OF = "2024-02-01 00:00:00"
AS_OF_ISO = AS_OF.replace(" ", "T")
DIMENSION = 64


@dataclass(frozen=True)
class Tables:
    """Attribute access to base tables and derived views."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


Build = Callable[[Tables], DataFrame]

_builds: dict[str, Build] = {}
_checks: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        _builds[name] = build
        if sql is not None:
            _checks[name] = with_views(sql)
        return build

    return add


def _load() -> None:
    from assetloom.plans import activity, catalog, code, quality, search, streams  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, b=build: b(Tables(spark, sf_dir))) for name, build in _builds.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_checks)
