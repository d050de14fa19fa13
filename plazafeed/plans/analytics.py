"""Queries on the click stream ``events`` (event_type = action, user_id = subject)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..functions.time import local_day
from ..operators import analytics as A
from .registry import query, table

AS_OF = "2024-01-31 00:00:00"


def events(spark, d):
    return table(spark, d, "events").withColumn("action", F.col("event_type"))


@query("usage_totals", "SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(user_id) AS with_user FROM events")
def usage_totals(spark, d):
    return A.usage_totals(events(spark, d))


@query("count_by_type", "SELECT coalesce(nullif(event_type, ''), 'unknown') AS type, count(*) AS n FROM events GROUP BY 1")
def count_by_type(spark, d):
    return A.count_by(events(spark, d), F.col("event_type"), "type")


@query("count_by_day", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def count_by_day(spark, d):
    return A.count_by_day(events(spark, d))


_COUNTERS = """count(*) FILTER (regexp_matches(lower(event_type), 'view|open')) AS views, count(*) FILTER (contains(lower(event_type),
 'search')) AS searches,
 count(*) FILTER (regexp_matches(lower(event_type), 'ticket|source|outbound|purchase')) AS outbound,
 count(*) FILTER (regexp_matches(lower(event_type), 'favorite|click')) AS favorites,
 count(*) FILTER (regexp_matches(lower(event_type), 'reminder|signup')) AS reminders"""


@query("kpis", f"SELECT {_COUNTERS} FROM events")
def kpis(spark, d):
    return A.kpis(events(spark, d))


@query("daily_activity", f"""WITH s AS (SELECT CAST(unnest(generate_series(DATE '2024-01-18', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day),
 c AS (SELECT CAST(ts + INTERVAL 3 HOUR AS DATE) AS day, count(*) AS events, {_COUNTERS} FROM events GROUP BY 1)
 SELECT day, coalesce(events, 0) AS events, coalesce(views, 0) AS views, coalesce(searches, 0) AS searches, coalesce(outbound, 0) AS outbound,
 coalesce(favorites, 0) AS favorites, coalesce(reminders, 0) AS reminders FROM s LEFT JOIN c USING (day)""")
def daily_activity(spark, d):
    return A.daily_activity(events(spark, d), AS_OF, 14, "Europe/Moscow")


@query("top_values", """SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1
 ORDER BY n DESC, value LIMIT 20""")
def top_values(spark, d):
    return A.top_values(events(spark, d), F.col("user_id"), 20)


@query("top_links", """SELECT json_extract_string(props, '$.k') AS url, event_type AS label, count(*) AS n FROM events
 WHERE json_extract_string(props, '$.k') <> '' GROUP BY 1, 2 ORDER BY n DESC, url, label LIMIT 20""")
def top_links(spark, d):
    ev = events(spark, d).select(F.col("event_type").alias("label"), F.create_map(F.lit("url"), F.get_json_object("props", "$.k")).alias("metadata"))
    return A.top_links(ev, 20)


@query("recent_events", "SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_events(spark, d):
    return A.recent(events(spark, d), 100).select("event_id", "ts", "user_id", "event_type")


@query("bounded_history", """WITH n AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY ALL)
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS rn FROM n QUALIFY rn <= 3""")
def bounded_history(spark, d):
    return A.bounded_history(events(spark, d).select("user_id", "event_type", "ts"), "user_id", "event_type", "ts", 3)


@query("rate_limit", """SELECT event_id, user_id, time_bucket(INTERVAL 60 SECOND, ts) AS window_start, row_number() OVER (PARTITION BY user_id,
 time_bucket(INTERVAL 60 SECOND, ts) ORDER BY ts, event_id) AS k,
 row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 60 SECOND, ts) ORDER BY ts, event_id) > 1 AS limited FROM events""")
def rate_limit(spark, d):
    return A.rate_limit(events(spark, d), "user_id", 1).select("event_id", "user_id", "window_start", "k", "limited")


@query("toggle_state", "SELECT user_id, event_type, count(*) % 2 = 1 AS active, max(ts) AS last_ts FROM events GROUP BY ALL")
def toggle_state(spark, d):
    return A.toggle_state(events(spark, d), "user_id", "event_type")


@query("user_hash", "SELECT event_id, substr(sha256('feed:' || CAST(user_id AS VARCHAR)), 1, 16) AS user_hash FROM events")
def user_hash(spark, d):
    return events(spark, d).select("event_id", keys.user_hash(F.col("user_id"), "feed").alias("user_hash"))


@query("ingest_events", """SELECT ts, event_type AS action, substr(sha256('feed:' || CAST(user_id AS VARCHAR)), 1, 16) AS user_hash,
 json_extract_string(props, '$.k') AS k FROM events""")
def ingest_events(spark, d):
    raw = events(spark, d).select("ts", F.col("event_type").alias("type"), "action", F.lit("").alias("label"), F.lit("").alias("source"), "user_id", F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("metadata"))
    return A.sanitize_events(raw, "feed").select("ts", "action", "user_hash", F.col("metadata")["k"].alias("k"))


@query("local_day", """SELECT event_id, CAST(ts + INTERVAL 3 HOUR AS DATE) AS day, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS date_key,
 strftime(ts + INTERVAL 3 HOUR, '%H:%M') AS time_key FROM events""")
def local_days(spark, d):
    from ..functions.time import date_key, time_key

    return events(spark, d).select("event_id", local_day(F.col("ts"), "Europe/Moscow").alias("day"), date_key(F.col("ts"), "Europe/Moscow").alias("date_key"), time_key(F.col("ts"), "Europe/Moscow").alias("time_key"))


@query("frontier_state", """SELECT user_id AS source_id, json_extract_string(props, '$.k') AS url, min(ts) AS first_seen_at, max(ts) AS last_seen_at,
 count(*) FILTER (event_type = 'error') AS blocked_count FROM events GROUP BY 1, 2 HAVING max(ts) >= TIMESTAMP '2023-08-04 00:00:00'""")
def frontier_state(spark, d):
    from ..streaming.jobs import frontier_state as fold

    e = F.when(F.col("event_type") == "error", "blocked").otherwise(F.lit("discovered"))
    log = events(spark, d).select(F.col("user_id").alias("source_id"), F.get_json_object("props", "$.k").alias("url"), e.alias("event"), F.col("ts").alias("at"))
    return fold(log, AS_OF).select("source_id", "url", "first_seen_at", "last_seen_at", "blocked_count")
