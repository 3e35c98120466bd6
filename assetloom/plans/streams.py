"""The streaming jobs over the given tables, worked off to the end.

Each is checked against the batch form of the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.functions import dates
from assetloom.operators.activity import IDLE_SECONDS
from assetloom.operators.embeddings import latest_embeddings
from assetloom.plans import activity as batch
from assetloom.plans.catalog import (
    HUB_MERGE_SQL, VERDICTS, fragile_vectors, hub_records, judged_saves, save_batch,
)
from assetloom.plans.registry import AS_OF, Tables, query
from assetloom.session import cut_lineage, sparing_disk, work_path
from assetloom.sources.hub import stream_hub_records, write_hub_records
from assetloom.streaming import jobs, sessions
from assetloom.streaming.changelog import ChangeLog


def _events(t: Tables) -> DataFrame:
    return jobs.file_stream(t.spark, t.sf_dir, "events.parquet", t.events)


def _complete(t: Tables, stream: DataFrame, label: str) -> DataFrame:
    """Final state of an aggregation, written by the executors, not gathered."""
    out = work_path(t.spark, label)

    def handle(state: DataFrame, batch_id: int) -> None:
        state.write.mode("overwrite").parquet(out)

    jobs.start(stream, handle, work_path(t.spark, "checkpoint"), "complete").awaitTermination()
    rows = t.spark.read.parquet(out)
    return rows.withColumns({c: dates.utc_naive(F.col(c)) for c, kind in rows.dtypes if kind == "timestamp"})


@query("stream_usage", batch.APPLIED)
def stream_usage(t):
    deltas = work_path(t.spark, "usage")
    named = _events(t).withColumn("name", F.concat(F.lit("fn_"), "user_id"))
    jobs.usage_stream(named, deltas, work_path(t.spark, "checkpoint")).awaitTermination()
    once = jobs.apply_pending_usage(t.fx_functions, t.fx_config, deltas)
    # Applying the same deltas again must change nothing.
    twice = jobs.apply_pending_usage(cut_lineage(once.functions, "applied"), cut_lineage(once.config, "config"), deltas)
    return twice.functions.select("name", "call_count", "last_called_at", "updated_at")


@query("stream_hub", HUB_MERGE_SQL)
def stream_hub(t):
    folder = work_path(t.spark, "records")
    with sparing_disk(t.spark):
        write_hub_records(hub_records(t).withColumn("test_cases", F.lit("[]")), folder, shards=3, compression="gzip")
        log = ChangeLog.over(work_path(t.spark, "changes"), t.fx_functions, parts=8)
        records = stream_hub_records(t.spark, folder, one_per_file=False)
        jobs.hub_stream(records, log, lambda batch_id: AS_OF, work_path(t.spark, "checkpoint")).awaitTermination()
    return log.current()


BATCHES = 3


def _batch_time(batch_id: int) -> str:
    return f"2024-02-0{batch_id + 1} 00:00:00"


def _save_run(t: Tables) -> tuple[ChangeLog, jobs.SaveFolders]:
    """The requests in three micro-batches by ``seq % 3``; every fifth skips its tests, some embeddings fail.

    The files of a micro-batch appear together, as many as the tasks that write
    them, and the stream works them off before those of the next.
    """
    requests = work_path(t.spark, "requests")
    batch = save_batch(t).withColumn("skip_test", F.col("seq") % 5 == 0)
    log = ChangeLog.over(work_path(t.spark, "changes"), t.fx_functions, parts=8)
    out = jobs.SaveFolders(*(work_path(t.spark, n) for n in ("vectors", "rejected", "failed")))
    verdicts = t.fx_verdicts.withColumn("status", F.when(F.col("status") == "verified", "success").otherwise("error"))
    checkpoint = work_path(t.spark, "checkpoint")
    for i in range(BATCHES):
        batch.filter(F.col("seq") % BATCHES == i).write.mode("append").parquet(requests)
        stream = jobs.file_stream(t.spark, requests, "*.parquet", batch)
        jobs.save_stream(stream, log, out, verdicts, fragile_vectors, "model-a", 64, _batch_time, checkpoint).awaitTermination()
    return log, out


# A request belongs to batch seq % 3; within a batch the last of a name counts, and later batches replace earlier ones.
_STREAMED = f"""
WITH s AS ({judged_saves("CAST('2024-02-0' || CAST(seq % 3 + 1 AS VARCHAR) || ' 00:00:00' AS VARCHAR)")}),
per_batch AS (SELECT *, seq % 3 AS batch FROM s WHERE reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY name, seq % 3 ORDER BY seq DESC) = 1),
last AS (SELECT * FROM per_batch QUALIFY row_number() OVER (PARTITION BY name ORDER BY batch DESC) = 1),
made AS (SELECT name, batch, CAST(concat('0x', substring(md5(concat('Name: ', name, chr(10), 'Desc: ', description, chr(10),
  'Tags: [''a b'']', chr(10), 'Code:', chr(10), code)), 1, 2)) AS INTEGER) AS head FROM per_batch)"""


@query("stream_saves", f"""{_STREAMED}
SELECT l.name, CASE WHEN NOT parses THEN 'broken' WHEN seq % 5 = 0 THEN 'verified' WHEN test_cases = '[]' THEN 'pending_tests'
  WHEN v.name IS NULL THEN 'error_internal' ELSE v.status END AS status,
  concat('2024-02-0', CAST(l.batch + 1 AS VARCHAR), 'T00:00:00') AS updated_at,
  coalesce(e.batch, -1) AS vector_batch
FROM last l LEFT JOIN ({VERDICTS}) v ON v.name = l.name
LEFT JOIN (SELECT name, max(batch) AS batch FROM made WHERE head >= 128 GROUP BY name) e ON e.name = l.name
UNION ALL
SELECT name, status, updated_at, -1 AS vector_batch FROM fx_functions WHERE name NOT IN (SELECT name FROM last)""")
def stream_saves(t):
    """Statuses and vectors of saved requests over three micro-batches; the newest vector of an asset counts."""
    log, out = _save_run(t)
    vectors = latest_embeddings(t.spark.read.option("basePath", out.embeddings).parquet(out.embeddings), layout="written")
    made = vectors.select(F.col("function_name").alias("name"), F.col("batch").cast("long").alias("made_in"))
    found = F.coalesce("made_in", F.lit(-1).cast("long")).alias("vector_batch")
    return log.current().join(made, "name", "left").select("name", "status", "updated_at", found)


@query("stream_save_rejected", f"{_STREAMED} SELECT seq, name, reason FROM s WHERE reason IS NOT NULL")
def stream_save_rejected(t):
    return t.spark.read.parquet(_save_run(t)[1].rejected).select("seq", "name", "reason")


@query("stream_embed_failures", f"""{_STREAMED}
SELECT name, CASE WHEN head < 64 THEN 'provider gave no vector' ELSE '64 values wanted, got 16' END AS error, batch
FROM made WHERE head < 128""")
def stream_embed_failures(t):
    failed = _save_run(t)[1].failed
    return t.spark.read.option("basePath", failed).parquet(failed).select("name", "error", F.col("batch").cast("long").alias("batch"))


@query("stream_sessions", batch.SESSIONS)
def stream_sessions(t):
    return _complete(t, jobs.session_stream(_events(t), IDLE_SECONDS), "sessions")


# Rows of a file of the session stream at least, where there is more than one a micro-batch.
FILE_ROWS = 10_000


@query("stream_sessions_closed", f"SELECT * FROM ({batch.SESSIONS}) WHERE session_end < (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def stream_sessions_closed(t):
    """Sessions as they close, by state kept per user: the earlier events, the later ones, then the first ones again, far too late."""
    folder, out = work_path(t.spark, "events"), work_path(t.spark, "closed")
    events = t.events.select("user_id", "ts")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    before = lambda share: F.col("ts") < F.lit(first + (last - first) * share)
    parts = before(0.5), ~before(0.5), before(0.25)
    # Each part is as many files as a micro-batch takes; files of thousands of rows are never empty, so none is missing.
    least = min(events.agg(*[F.count_if(part) for part in parts]).first())
    files = max(1, min(t.spark.sparkContext.defaultParallelism, least // FILE_ROWS))
    for part in parts:
        events.filter(part).repartition(files).write.mode("append").parquet(folder)
    stream = jobs.file_stream(t.spark, folder, "*.parquet", events, files_per_batch=files)
    with sessions.state_beyond_the_heap(t.spark):
        closed = sessions.session_state_stream(stream, IDLE_SECONDS)
        write = lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        jobs.start(closed, write, work_path(t.spark, "checkpoint")).awaitTermination()
    rows = t.spark.read.parquet(out).drop("batch")
    return rows.withColumns({c: dates.utc_naive(F.col(c)) for c in ("session_start", "session_end")})


@query("stream_rate_flags", batch.RATES)
def stream_rate_flags(t):
    return _complete(t, jobs.rate_stream(_events(t), "1 day", 3), "rates")
