"""Query-log, usage and session analytics over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetloom.functions.hashing import normalised_query, query_key, secret_key

# When a query counts as popular, idle gap.
POPULAR_FROM = 3
IDLE_SECONDS = 1800


def usage_delta(log: DataFrame) -> DataFrame:
    """Calls and last call per asset; folds before the shuffle."""
    return log.groupBy("name").agg(F.count("*").alias("calls"), F.max("ts").alias("last_ts"))


def popular_queries(log: DataFrame, threshold: int = POPULAR_FROM, top: int | None = None) -> DataFrame:
    """Queries asked ``threshold`` times or more; all of them, or the ``top`` most frequent."""
    counts = log.groupBy(normalised_query(F.col("query")).alias("query")).agg(
        F.count("*").alias("frequency"), F.max("ts").alias("last_accessed")
    )
    popular = counts.filter(F.col("frequency") >= threshold)
    return popular if top is None else popular.orderBy(F.desc("frequency"), "query").limit(top)


def cached_from(log: DataFrame, threshold: int = POPULAR_FROM) -> DataFrame:
    """Per exact query text, the request that put it into the cache.

    The ``threshold``-th request of a normalised text makes it popular: the
    row-number filter keeps at most ``threshold`` rows per text before the
    shuffle. From then on the first request of an exact text caches it.
    """
    when = F.struct("ts", "req_id").alias("at")
    requests = log.select(normalised_query(F.col("query")).alias("norm"), "query", when)
    nth = Window.partitionBy("norm").orderBy("at")
    popular = (
        requests.withColumn("nth", F.row_number().over(nth))
        .filter(F.col("nth") <= threshold)
        .filter(F.col("nth") == threshold)
        .select("norm", F.col("at").alias("popular_at"))
    )
    after = requests.join(popular, "norm").filter(F.col("at") >= F.col("popular_at"))
    return after.groupBy("query").agg(F.min("at").alias("cached_at"))


def _served(log: DataFrame, threshold: int) -> DataFrame:
    joined = log.select("req_id", "ts", "query").join(cached_from(log, threshold), "query", "left")
    hit = F.coalesce(F.struct("ts", "req_id") > F.col("cached_at"), F.lit(False))
    return joined.select("req_id", "query", hit.alias("hit"), F.col("cached_at").isNotNull().alias("cached"))


def cache_hits(log: DataFrame, threshold: int = POPULAR_FROM) -> DataFrame:
    """Would each request have been served from an unbounded popular-query cache?"""
    return _served(log, threshold).drop("cached")


def cache_stats(log: DataFrame, threshold: int = POPULAR_FROM) -> DataFrame:
    """Size, hits, misses, hit rate and distinct queries; the log is folded by exact query first."""
    by_query = _served(log, threshold).groupBy("query").agg(
        F.bool_or("cached").alias("cached"), F.count_if("hit").alias("hits"), F.count("*").alias("asked")
    )
    totals = by_query.agg(
        F.count_if("cached").alias("cache_size"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("hit_count"),
        F.coalesce(F.sum("asked"), F.lit(0)).alias("requests"),
        F.count_distinct(normalised_query(F.col("query"))).alias("total_queries"),
    )
    rate = F.coalesce(F.try_divide(F.col("hit_count"), F.col("requests")) * 100, F.lit(0.0))
    return totals.select(
        "cache_size", "hit_count", (F.col("requests") - F.col("hit_count")).alias("miss_count"),
        F.format_string("%.2f%%", rate).alias("hit_rate"), "total_queries",
    )


def query_keys(log: DataFrame) -> DataFrame:
    """Stable short and long hashes of each query text."""
    query = F.col("query")
    return log.select("req_id", query_key(query).alias("query_key"), secret_key(query).alias("secret_key"))


def activity_sessions(events: DataFrame, gap_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Runs of a user's events with at most ``gap_seconds`` between neighbours.

    Events in one slot of that length always share a session, so they fold to
    one row per user and slot before the shuffle. A user's rows are then bounded
    by the time covered, however many events the user has.
    """
    gap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(gap_seconds))
    slot = F.window("ts", f"{gap_seconds} seconds")["start"]
    slots = events.groupBy("user_id", slot.alias("slot")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events")
    )
    by_user = Window.partitionBy("user_id").orderBy("slot")
    starts = F.coalesce(F.col("first") > F.lag("last").over(by_user) + gap, F.lit(True))
    numbered = slots.withColumn("starts", starts.cast("int")).withColumn("session", F.sum("starts").over(by_user))
    return numbered.groupBy("user_id", "session").agg(
        F.min("first").alias("session_start"), (F.max("last") + gap).alias("session_end"), F.sum("events").alias("events")
    ).drop("session")


def rate_limit_flags(events: DataFrame, window: str, max_calls: int, slide: str | None = None) -> DataFrame:
    """Users with more than ``max_calls`` events in a window."""
    counts = events.groupBy("user_id", F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("calls"))
    return counts.filter(F.col("calls") > max_calls).select(
        "user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "calls"
    )
