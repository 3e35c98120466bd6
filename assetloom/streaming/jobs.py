"""Structured Streaming forms of usage counting, record sync, saving, sessions and rate flags."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from assetloom.functions import dates
from assetloom.operators.activity import IDLE_SECONDS, usage_delta
from assetloom.operators.embeddings import Provider, as_embedding_rows, embed, embedding_text, failures, of_dimension
from assetloom.operators.maintenance import CHANGED, apply_status, apply_usage, changed_rows, last_records, prepare_saves, record_actions, saved_rows
from assetloom.operators.quality import verification_status
from assetloom.operators.ranking import PLACE, at_places, placed
from assetloom.session import cut_lineage, delete_path, work_path, work_scope, written
from assetloom.sources.hub import CORRUPT, action_counts, split_records
from assetloom.streaming.changelog import ChangeLog


# The time of a micro-batch, from its id; a replay may get a later one and overwrites the first.
Clock = Callable[[int], str]


def system_clock(batch_id: int) -> str:
    return datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")


def file_stream(spark: SparkSession, folder: str, pattern: str, like: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files appearing in a folder, oldest first, with event times watermarks accept."""
    reader = spark.readStream.schema(like.schema).option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.parquet(folder)
    naive = dict(raw.dtypes).get("ts") == "timestamp_ntz"
    return raw.withColumn("ts", dates.utc_instant(F.col("ts"))) if naive else raw


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off what is there and stop; the same code runs forever with another trigger."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(handle).trigger(availableNow=True).start()


def usage_stream(events: DataFrame, deltas: str, checkpoint: str, watermark: str = "1 hour") -> StreamingQuery:
    """Count calls once per event id; every micro-batch adds one small delta folder."""
    unique = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])

    def handle(batch: DataFrame, batch_id: int) -> None:
        usage_delta(batch).write.mode("overwrite").parquet(f"{deltas}/batch={batch_id}")

    return start(unique, handle, checkpoint)


def usage_totals(spark: SparkSession, deltas: str, after: int = -1, upto: int | None = None) -> DataFrame:
    """Totals of the deltas of later batches than ``after``; only their folders are read."""
    rows = spark.read.option("basePath", deltas).parquet(deltas).filter(F.col("batch") > after)
    rows = rows if upto is None else rows.filter(F.col("batch") <= upto)
    return rows.groupBy("name").agg(F.sum("calls").alias("calls"), dates.utc_naive(F.max("last_ts")).alias("last_ts"))


USAGE_MARK = "usage_applied_upto"


class UsageResult(NamedTuple):
    functions: DataFrame
    config: DataFrame


def apply_pending_usage(functions: DataFrame, config: DataFrame, deltas: str) -> UsageResult:
    """Functions and config after the deltas not applied yet.

    The config keeps the id of the last delta applied. Written as one version
    with the functions, it makes applying twice count once.
    """
    spark = functions.sparkSession
    mark = config.filter(F.col("key") == USAGE_MARK).agg(F.max(F.col("value").cast("long"))).first()[0]
    mark = -1 if mark is None else mark
    last = spark.read.option("basePath", deltas).parquet(deltas).agg(F.max("batch")).first()[0]
    last = mark if last is None else max(mark, last)
    applied = apply_usage(functions, usage_totals(spark, deltas, mark, last))
    row = spark.range(1).select(F.lit(USAGE_MARK).alias("key"), F.lit(str(last)).alias("value"))
    return UsageResult(applied, config.filter(F.col("key") != USAGE_MARK).select("key", "value").unionByName(row))


def hub_stream(
    records: DataFrame, log: ChangeLog, as_of: Clock, checkpoint: str, counts: str | None = None, rejected: str | None = None
) -> StreamingQuery:
    """Merge record files as they appear, reading the parts of the catalogue that hold their names.

    ``counts`` is a folder for one row of totals per micro-batch, ``rejected``
    one for the files that were not taken in, with the reason. Totals are seen
    by the writes themselves; ``SyncCounters`` reads those of the scan. What a
    micro-batch writes on the way goes with it; large ones run inside
    ``sparing_disk``.
    """
    spark = records.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        totals, rows = {}, work_path(spark, "changed")
        with work_scope(spark):
            # Written once: the files are parsed, and the scan's own counters added up, a single time.
            with written(batch, "scanned") as scanned:
                scan = split_records(scanned)
                last = last_records(scan.records, written=True)  # a table of its own
                if rejected or counts:
                    refused = Observation()
                    kept = scan.rejected.observe(refused, F.count(F.lit(1)).alias("rejected"))
                    target = f"{rejected}/batch={batch_id}" if rejected else None
                    kept.write.mode("overwrite").parquet(target) if target else kept.write.format("noop").mode("overwrite").save()
                    totals |= refused.get
            current = log.current(before=batch_id, names=last)
            seen = Observation()
            actions = cut_lineage(record_actions(current, last).select("name", "action").observe(seen, *action_counts()), "actions")
            totals |= seen.get
            # Only changed records move, once to meet what they keep and once to the part they are written to.
            found = placed(last)
            places = found.select("name", *PLACE).join(actions.filter(CHANGED), "name", "left_semi").select(*PLACE)
            stored = changed_rows(current, at_places(found, places, "changed-places").drop(*PLACE), as_of(batch_id))
            stored.write.parquet(rows)
        try:
            log.write(batch_id, spark.read.schema(stored.schema).parquet(rows))
        finally:
            delete_path(spark, rows)
        if counts:
            row = spark.createDataFrame([(batch_id, *(totals[c] for c in COUNTERS))], "batch_id long, " + " long, ".join(COUNTERS) + " long")
            row.coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch={batch_id}")

    return start(counted_scan(records), handle, checkpoint)


COUNTERS = ["insert", "update", "unchanged", "skipped", "total", "rejected"]
SCAN_METRICS = "record_scan"


def counted_scan(records: DataFrame) -> DataFrame:
    """A record stream whose progress tells how many records a micro-batch read and how many were unreadable."""
    return records.observe(
        SCAN_METRICS, F.count(F.lit(1)).alias("read"), F.count_if(F.col(CORRUPT).isNotNull()).alias("unreadable")
    )


class SyncCounters(StreamingQueryListener):
    """Scan counters of every running sync, by run and micro-batch, as the queries report their progress."""

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(SCAN_METRICS)
        if row is not None:
            self.batches[(str(event.progress.runId), event.progress.batchId)] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def total(self) -> dict[str, int]:
        return {c: sum(b[c] for b in self.batches.values()) for c in ("read", "unreadable")}


class SaveFolders(NamedTuple):
    """Where a save stream puts what is not an asset, a folder per micro-batch below each."""

    embeddings: str
    rejected: str  # seq, name, reason
    failed: str  # name, error of the embedding


def save_stream(
    requests: DataFrame, log: ChangeLog, out: SaveFolders, verdicts: DataFrame, provider: Provider, model: str, dimension: int,
    as_of: Clock, checkpoint: str, gate: str = "draft", code_chars: int | None = None,
) -> StreamingQuery:
    """Save, judge and embed requests; one query keeps the batches in order.

    ``verdicts(name, status)`` holds the test results known so far; requests
    with ``skip_test`` need none. Every request ends as a stored asset, as
    replaced by a later request for its name, or as a rejected row; every stored
    asset has a vector or a failed row.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        now = as_of(batch_id)
        prepared = prepare_saves(batch, now, gate)
        accepted = cut_lineage(prepared.accepted, "accepted")
        prepared.rejected.write.mode("overwrite").parquet(f"{out.rejected}/batch={batch_id}")
        saved = cut_lineage(saved_rows(log.current(before=batch_id, names=accepted), accepted), "saved")
        status = verification_status(saved, verdicts, skipped=accepted.filter("skip_test"))
        written = log.write(batch_id, apply_status(saved, status, now))
        texts = embedding_text(written, with_deps=False, code_chars=code_chars)
        made = cut_lineage(of_dimension(embed(texts, provider), dimension), "embedded")
        as_embedding_rows(made, model, now).write.mode("overwrite").parquet(f"{out.embeddings}/batch={batch_id}")
        failures(made).write.mode("overwrite").parquet(f"{out.failed}/batch={batch_id}")

    return start(requests, handle, checkpoint)


def session_stream(events: DataFrame, gap_seconds: int = IDLE_SECONDS, watermark: str = "2 hours") -> DataFrame:
    """Sessions as they close: a session is out once the watermark passes its end."""
    gap = F.session_window("ts", f"{gap_seconds} seconds")
    sessions = events.withWatermark("ts", watermark).groupBy("user_id", gap.alias("s")).agg(F.count("*").alias("events"))
    return sessions.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def rate_stream(events: DataFrame, window: str, max_calls: int, slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Windows in which a user exceeds the limit."""
    counts = (
        events.withWatermark("ts", watermark)
        .groupBy("user_id", F.window("ts", window, slide).alias("w"))
        .agg(F.count("*").alias("calls"))
    )
    return counts.filter(F.col("calls") > max_calls).select(
        "user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "calls"
    )
