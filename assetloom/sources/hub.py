"""JSON record folders: one file per asset, plus a light index."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom import schemas
from assetloom.functions import json

CORRUPT = "corrupt_record"
# Schema of record scans, with the text of a record that cannot be read.
HUB_LINES = T.StructType(schemas.HUB_RECORD.fields + [T.StructField(CORRUPT, T.StringType())])


class HubScan(NamedTuple):
    records: DataFrame
    rejected: DataFrame


def split_records(raw: DataFrame) -> HubScan:
    """Readable named records, and the rest with the reason it was skipped."""
    nameless = F.col("name").isNull() | (F.col("name") == "")
    reason = F.when(F.col(CORRUPT).isNotNull(), "unreadable").when(nameless, "no name")
    judged = raw.withColumn("reason", reason)
    records = judged.filter("reason IS NULL").drop("reason", CORRUPT)
    rejected = judged.filter("reason IS NOT NULL").select("file_path", "reason")
    return HubScan(records, rejected)


def _reader(source, one_per_file: bool):
    options = {"multiLine": one_per_file, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    if one_per_file:
        options["pathGlobFilter"] = "*.json"
    return source.schema(HUB_LINES).options(**options, recursiveFileLookup=True)


def read_hub_records(spark: SparkSession, folder: str, one_per_file: bool = True) -> HubScan:
    """Scan a record folder; ``one_per_file=False`` reads the JSON lines we write ourselves."""
    raw = _reader(spark.read, one_per_file).json(folder)
    return split_records(raw.withColumn("file_path", F.col("_metadata.file_path")))


def stream_hub_records(spark: SparkSession, folder: str, one_per_file: bool = True) -> DataFrame:
    """The same scan as a file stream; split it inside ``foreachBatch``."""
    raw = _reader(spark.readStream, one_per_file).json(folder)
    return raw.withColumn("file_path", F.col("_metadata.file_path"))


def export_hub_records(functions: DataFrame, as_of: str) -> DataFrame:
    """Record form of every asset that may be published."""
    meta = F.col("metadata")
    return functions.filter("status != 'deleted'").select(
        "name",
        "code",
        "description",
        json.string_list(F.col("tags")).alias("tags"),
        F.coalesce(F.when(F.col("test_cases") != "", F.col("test_cases")), F.lit("[]")).alias("test_cases"),
        json.metadata_list(meta, "dependencies").alias("dependencies"),
        F.coalesce(json.number(meta, "$.quality_score"), F.lit(0.0)).alias("quality_score"),
        F.lit(as_of.replace(" ", "T")).alias("updated_at"),
    )


def record_lines(records: DataFrame) -> Column:
    """The JSON text of each record. Test cases are spliced in as nested JSON, in their own key order."""
    plain = F.to_json(F.struct(*[c for c in records.columns if c != "test_cases"]))
    cases = F.when(F.try_parse_json("test_cases").isNotNull(), F.col("test_cases")).otherwise(F.lit("[]"))
    return F.concat(F.regexp_replace(plain, r"\}$", ""), F.lit(',"test_cases":'), cases, F.lit("}"))


def write_hub_records(records: DataFrame, folder: str, shards: int = 64, files_per_shard: int = 1, compression: str = "none") -> None:
    """One JSON line per record in ``shards`` folders by name hash, ``files_per_shard`` files in each.

    Records are moved to the task that writes their file, so the number of files
    does not grow with the number of tasks. Adaptive execution splits a shard
    that is too large for one task, into more files. Compressed files are read
    as wholes, each by one task.
    """
    salt = F.pmod(F.xxhash64("name", F.lit(1)), F.lit(files_per_shard))
    shard = F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int")
    lines = records.select(record_lines(records).alias("value"), shard.alias("shard"), salt.alias("salt"))
    dealt = lines.hint("rebalance", "shard", "salt").drop("salt")
    dealt.write.partitionBy("shard").text(folder, compression=compression)


def build_hub_index(records: DataFrame) -> DataFrame:
    return records.filter("name IS NOT NULL").select(
        "name",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def write_hub_index(records: DataFrame, folder: str, files: int = 1) -> None:
    """The index as JSON lines in ``files`` files, in place of an older one."""
    build_hub_index(records).repartition(files, "name").write.mode("overwrite").json(folder)


def read_hub_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("name string, description string, tags array<string>").json(folder)


def action_counts() -> list[Column]:
    """Counters of what a merge did: an aggregate, or metrics to observe while the actions are written."""
    kinds = [F.count_if(F.col("action") == a).alias(a) for a in ("insert", "update", "unchanged", "skipped")]
    return [*kinds, F.count(F.lit(1)).alias("total")]


def sync_counts(actions: DataFrame) -> DataFrame:
    """How many records were inserted, updated, left alone or skipped."""
    return actions.agg(*action_counts())
