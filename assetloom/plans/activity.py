"""Usage, query-log and session queries."""

from __future__ import annotations

from assetloom.operators import activity, maintenance
from assetloom.plans import duck
from assetloom.plans.registry import query

USAGE = "SELECT name, count(*) AS calls, max(ts) AS last_ts FROM fx_usage GROUP BY name"


@query("usage_rollup", USAGE)
def usage_rollup(t):
    return activity.usage_delta(t.fx_usage)


_STAMP = "regexp_replace(strftime(last_ts, '%Y-%m-%dT%H:%M:%S.%f'), '[.]000000$', '')"
APPLIED = f"""
SELECT f.name, CAST(f.call_count + coalesce(calls, 0) AS INTEGER) AS call_count,
  coalesce({_STAMP}, f.last_called_at) AS last_called_at, coalesce({_STAMP}, f.updated_at) AS updated_at
FROM fx_functions f LEFT JOIN ({USAGE}) u ON u.name = f.name"""


@query("apply_usage", APPLIED)
def apply_usage(t):
    applied = maintenance.apply_usage(t.fx_functions, activity.usage_delta(t.fx_usage))
    return applied.select("name", "call_count", "last_called_at", "updated_at")


_NORM = duck.strip("lower(query)")


@query("popular_queries", f"""
SELECT {_NORM} AS query, count(*) AS frequency, max(ts) AS last_accessed FROM fx_query_log GROUP BY 1
HAVING count(*) >= 3""")
def popular_queries(t):
    return activity.popular_queries(t.fx_query_log)


_HITS = f"""
SELECT req_id, query, norm, coalesce(max(p) OVER (PARTITION BY query ORDER BY ts, req_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 3, false) AS hit, p
FROM (SELECT *, {_NORM} AS norm, row_number() OVER (PARTITION BY {_NORM} ORDER BY ts, req_id) AS p FROM fx_query_log)"""


@query("cache_hits", f"SELECT req_id, query, hit FROM ({_HITS})")
def cache_hits(t):
    return activity.cache_hits(t.fx_query_log)


@query("cache_stats", f"""
SELECT count(DISTINCT query) FILTER (WHERE p >= 3) AS cache_size, count(*) FILTER (WHERE hit) AS hit_count,
  count(*) FILTER (WHERE NOT hit) AS miss_count,
  printf('%.2f%%', 100.0 * count(*) FILTER (WHERE hit) / count(*)) AS hit_rate, count(DISTINCT norm) AS total_queries
FROM ({_HITS})""")
def cache_stats(t):
    return activity.cache_stats(t.fx_query_log)


@query("query_keys", "SELECT req_id, md5(query) AS query_key, sha256(query) AS secret_key FROM fx_query_log")
def query_keys(t):
    return activity.query_keys(t.fx_query_log)


SESSIONS = """
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1800 SECOND AS session_end, count(*) AS events
FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
  SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS fresh
  FROM events)) GROUP BY user_id, session"""


@query("activity_sessions", SESSIONS)
def activity_sessions(t):
    return activity.activity_sessions(t.events)


RATES = """
SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
  count(*) AS calls FROM events GROUP BY ALL HAVING count(*) > 3"""


@query("rate_limit_flags", RATES)
def rate_limit_flags(t):
    return activity.rate_limit_flags(t.events, "1 day", 3)


@query("rate_limit_sliding", """
SELECT user_id, s + INTERVAL (h) HOUR AS window_start, s + INTERVAL (h) HOUR + INTERVAL 1 DAY AS window_end, count(*) AS calls
FROM (SELECT user_id, time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR AS s, unnest([0, 12]) AS h FROM events)
GROUP BY ALL HAVING count(*) > 3""")
def rate_limit_sliding(t):
    return activity.rate_limit_flags(t.events, "1 day", 3, "12 hours")
