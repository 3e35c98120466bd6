"""Catalogue snapshots: immutable Parquet folders, one per version."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom import schemas
from assetloom.functions import dates, json
from assetloom.session import path_exists

# The column by which a version written in buckets is dealt.
BUCKET_KEYS = {"functions": "name", "embeddings": "function_name"}
TABLES = {"functions": schemas.FUNCTIONS, "embeddings": schemas.EMBEDDINGS, "config": schemas.CONFIG}


@dataclass(frozen=True)
class Catalog:
    functions: DataFrame
    embeddings: DataFrame
    config: DataFrame


def version_path(base: str, table: str, version: int) -> str:
    return f"{base.rstrip('/')}/{table}/v{version:08d}"


def read_catalog(spark: SparkSession, base: str, version: int) -> Catalog:
    """One version of all three tables under their fixed schemas.

    A column the files lack (an older layout) takes its default; a stored NULL
    stays NULL. One footer of the version tells its columns. A version written
    in buckets is read as bucketed tables, so joins and folds by asset name need
    no exchange of it.
    """
    layout = version_path(base, "layout", version)
    if path_exists(spark, layout):
        buckets = spark.read.schema("buckets int").parquet(layout).first()[0]
        read = {t: _bucketed(spark, version_path(base, t, version), t, buckets) for t in BUCKET_KEYS}
    else:
        read = {t: spark.read.schema(TABLES[t]).parquet(version_path(base, t, version)) for t in BUCKET_KEYS}
    present = spark.read.parquet(version_path(base, "functions", version)).columns
    defaults = {"call_count": schemas.DEFAULT_CALL_COUNT, "status": schemas.DEFAULT_STATUS}
    filled = read["functions"].withColumns({c: F.lit(v) for c, v in defaults.items() if c not in present})
    config = spark.read.schema(schemas.CONFIG).parquet(version_path(base, "config", version))
    return Catalog(filled, read["embeddings"], config)


def typed_view(functions: DataFrame) -> DataFrame:
    """JSON text columns parsed and dates as timestamps."""
    return functions.select(
        "name",
        "code",
        "description",
        json.string_list(F.col("tags")).alias("tags"),
        json.metadata(F.col("metadata")).alias("metadata"),
        "status",
        F.from_json("test_cases", schemas.TEST_CASES).alias("test_cases"),
        "call_count",
        *[dates.parse_any(F.col(c)).alias(c) for c in ("last_called_at", "created_at", "updated_at")],
    )


def masked_view(functions: DataFrame) -> DataFrame:
    """What search may show: every column but the code, which is never scanned."""
    return functions.drop("code")


def write_snapshot(df: DataFrame, base: str, table: str, version: int) -> str:
    """Write a new version; an existing one is never touched."""
    path = version_path(base, table, version)
    df.write.mode("errorifexists").parquet(path)
    return path


def write_bucketed_snapshot(catalog: Catalog, base: str, version: int, buckets: int = 64) -> None:
    """Write a new version whose functions and embeddings are bucketed alike and sorted by asset name.

    They then join without an exchange, so the vectors of the largest table
    never cross the network. All rows of one name lie in one bucket: a few per
    asset, as a catalogue holds them, not a large share of a table.
    """
    spark = catalog.functions.sparkSession
    for table, key in BUCKET_KEYS.items():
        path = version_path(base, table, version)
        # One task per bucket, so that a bucket is one file.
        writer = getattr(catalog, table).repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
        writer.option("path", path).mode("errorifexists").saveAsTable(_table_name(path))
    write_snapshot(catalog.config, base, "config", version)
    # Last, as it makes the version a bucketed one.
    layout = spark.range(1).select(F.lit(buckets).alias("buckets"))
    write_snapshot(layout.coalesce(1), base, "layout", version)


def _table_name(path: str) -> str:
    return f"bucketed_{hashlib.md5(path.encode()).hexdigest()[:20]}"


def _bucketed(spark: SparkSession, path: str, table: str, buckets: int) -> DataFrame:
    """The files of a bucketed version as a table, named in this session if it is not yet."""
    name, key = _table_name(path), BUCKET_KEYS[table]
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({TABLES[table].toDDL()}) USING parquet "
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)
