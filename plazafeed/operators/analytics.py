"""Aggregations over click events, items, drafts and audits."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.time import local_day, ts


def usage_totals(ev: DataFrame, user: str = "user_id", approximate: bool = False) -> DataFrame:
    users = F.approx_count_distinct(user) if approximate else F.count_distinct(user)
    return ev.agg(F.count("*").alias("events"), users.alias("users"), F.count(user).alias("with_user"))


def count_by(df: DataFrame, col: Column, name: str) -> DataFrame:
    """Rows per value, null and empty as "unknown"."""
    return df.groupBy(F.coalesce(text.first_truthy(col.cast("string")), F.lit("unknown")).alias(name)).agg(F.count("*").alias("n"))


def count_by_day(ev: DataFrame, tz: str = "UTC") -> DataFrame:
    return ev.groupBy(local_day(F.col("ts"), tz).alias("day")).agg(F.count("*").alias("n"))


def is_outbound(action: Column) -> Column:
    return F.lower(action).rlike("ticket|source|outbound|purchase")


COUNTERS = {
    "views": lambda a: F.lower(a).rlike("view|open"), "searches": lambda a: F.lower(a).contains("search"), "outbound": is_outbound,
    "favorites": lambda a: F.lower(a).rlike("favorite|click"), "reminders": lambda a: F.lower(a).rlike("reminder|signup"),
}


def kpis(ev: DataFrame, action: str = "action") -> DataFrame:
    """One row: how many events of each kind."""
    return ev.agg(*[F.count_if(p(F.col(action))).alias(n) for n, p in COUNTERS.items()])


def daily_activity(ev: DataFrame, as_of: datetime | str, days: int = 14, tz: str = "UTC", action: str = "action") -> DataFrame:
    """One row for each of the last ``days`` local days, also those without events."""
    last = local_day(ts(as_of), tz)
    spine = ev.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    day = local_day(F.col("ts"), tz)
    counts = ev.where(day.between(F.date_sub(last, days - 1), last)).groupBy(day.alias("day")).agg(F.count("*").alias("events"), *[F.count_if(p(F.col(action))).alias(n) for n, p in COUNTERS.items()])
    return spine.join(counts, "day", "left").na.fill(0)


def top_values(df: DataFrame, value: Column, n: int) -> DataFrame:
    """The ``n`` most frequent values, blanks skipped; of equal counts the smaller value first."""
    return df.select(value.cast("string").alias("value")).where("trim(value) <> ''").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def top_links(ev: DataFrame, n: int) -> DataFrame:
    m = lambda k: F.col("metadata")[k]
    url = text.first_truthy(m("url"), m("href"), m("target"))
    label = text.first_truthy(F.col("label"), m("title"), url)
    return ev.where(url.isNotNull()).groupBy(url.alias("url"), label.alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url", "label").limit(n)


def source_counts(items: DataFrame) -> DataFrame:
    """Items per contributing source; the name at the id's place, the id where there is none."""
    one = items.select(F.explode(F.arrays_zip("source_ids", "source_names")).alias("s")).select(F.col("s.source_ids").alias("source_id"), text.first_truthy(F.col("s.source_names"), F.col("s.source_ids")).alias("name"))
    return one.groupBy("source_id").agg(F.count("*").alias("n"), F.min("name").alias("name"))


def merge_source_stats(*stats: DataFrame) -> DataFrame:
    """``stats(source_id, ...)`` in rising precedence: the last row of a source wins whole; most collected first."""
    tagged = None
    for k, df in enumerate(stats):
        df = df.withColumn("_rank", F.lit(k))
        tagged = df if tagged is None else tagged.unionByName(df, allowMissingColumns=True)
    cols = [c for c in tagged.columns if c not in ("source_id", "_rank")]
    won = tagged.groupBy("source_id").agg(F.max_by(F.struct(*cols), F.col("_rank")).alias("s"))
    return won.select("source_id", "s.*").orderBy(F.desc(cols[0]), "source_id")


def scan_meta(items: DataFrame, stats: DataFrame, as_of: datetime | str) -> DataFrame:
    """One row: collected, total and eligible items, sources by status."""
    status = F.when(F.col("error").isNotNull(), "error").when(F.coalesce("collected", F.lit(0)) == 0, "skipped").otherwise("ok")
    a = stats.withColumn("status", status).agg(F.sum("collected").alias("collected"), *[F.count_if(F.col("status") == s).alias(f"sources_{s}") for s in ("ok", "skipped", "error")])
    b = items.agg(F.count("*").alias("total"), F.count_if(F.col("event_date") >= ts(as_of)).alias("eligible"), F.max("updated_at").alias("last_update"))
    return a.crossJoin(b)  # one row each


def duplicate_groups(df: DataFrame, key: Column, urls: int = 6) -> DataFrame:
    """Groups of two or more rows with equal non-empty ``key``: size, sources, some urls, the first title by id.

    Rows meet by a digest of the key, which is made once; the key itself goes along once a task and group.
    """
    keyed = df.withColumn("key", key).withColumn("_digest", F.sha2("key", 256))
    g = keyed.groupBy("_digest").agg(F.any_value("key").alias("key"), F.count("*").alias("n"), F.array_sort(F.collect_set("source_id")).alias("sources"), F.slice(F.array_sort(F.collect_set("url")), 1, urls).alias("urls"), F.min_by("title", "id").alias("title"))
    return g.where("n > 1 and key <> ''").drop("_digest")


def quality_flags(df: DataFrame) -> DataFrame:
    """A boolean for each weakness of title, summary, venue and url, and the list of those that hold."""
    title, summary = F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))
    from .filters import rejected

    flags = {
        "weak_title": (F.length(title) < 2) | (F.length(title) > 120), "weak_summary": F.length(summary) < 45,
        "missing_venue": F.coalesce("venue_title", F.lit("")) == "", "missing_url": F.coalesce("url", F.lit("")) == "",
        "mojibake": text.is_mojibake(F.concat_ws(" ", title, summary)), "blocked": rejected(F.concat_ws(" ", title, summary)),
    }
    out = df.withColumns(flags)
    return out.withColumn("issues", F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in flags])))


def readiness(df: DataFrame, as_of: datetime | str, date: str = "event_date", kind: str = "kind", visual: str = "visual_key") -> DataFrame:
    """One row: rows in the next 7, 30 and 120 days, kinds, distinct visuals, and whether a channel can be fed."""
    d = F.col(date)
    ahead = lambda n: (d >= ts(as_of)) & (d <= ts(as_of) + F.expr(f"INTERVAL '{n}' DAY"))
    out = df.agg(F.count_if(d >= ts(as_of)).alias("upcoming"), *[F.count_if(ahead(n)).alias(f"next_{n}") for n in (7, 30, 120)], F.count_distinct(F.when(d >= ts(as_of), F.col(kind))).alias("kinds"), F.count_distinct(F.when(d >= ts(as_of), F.col(visual))).alias("visuals"))
    return out.withColumn("ready", (F.col("upcoming") >= 10) & (F.col("next_30") >= 10) & (F.col("visuals") >= 10))


def content_audit(df: DataFrame, as_of: datetime | str) -> DataFrame:
    """One row: totals of duplicates, weaknesses and readiness, and ``ok``."""
    flagged = quality_flags(df)
    names = ["weak_title", "weak_summary", "missing_venue", "missing_url", "mojibake", "blocked"]
    a = flagged.agg(F.count("*").alias("items"), *[F.count_if(n).alias(n) for n in names])
    d = duplicate_groups(df, F.col("fingerprint")).agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"))
    r = readiness(df, as_of)
    return a.crossJoin(d).crossJoin(r).withColumn("ok", F.col("ready") & (F.col("duplicate_groups") == 0) & (F.col("blocked") == 0) & (F.col("mojibake") == 0))


def coverage(items: DataFrame, files: DataFrame, section: str = "section_id", item: str = "item_id") -> DataFrame:
    """Per section and overall (section null, total 1): items, those with photos, without, and with an empty folder."""
    have = files.groupBy(section, item).agg(F.count_if(F.col("bytes") > 0).alias("photos"))
    j = items.select(section, item).join(have, [section, item], "left")
    return j.rollup(section).agg(F.grouping(section).cast("int").alias("total"), F.count("*").alias("items"), F.count_if(F.col("photos") > 0).alias("ok"), F.count_if(F.col("photos") == 0).alias("empty"), F.count_if(F.col("photos").isNull()).alias("missing"))


def delivery_stats(drafts: DataFrame, day: str, tz: str = "UTC") -> DataFrame:
    """One row for drafts created on a local day."""
    d = drafts.where(local_day(F.col("created_at"), tz) == F.lit(day).cast("date"))
    return d.agg(F.count("*").alias("created"), F.count_if(F.col("status") == "pending").alias("pending"), F.count("manager_delivered_at").alias("delivered"), F.count("manager_delivery_failed_at").alias("failed"), F.max("manager_delivered_at").alias("last_delivered"), F.max_by("manager_delivery_error", "manager_delivery_failed_at").alias("last_error"))


def status_counts(drafts: DataFrame) -> DataFrame:
    return count_by(drafts, F.col("status"), "status")


def health_warnings(meta: DataFrame, as_of: datetime | str, event_hours: int = 18, catalog_hours: int = 72, drafts_a_day: int = 10) -> DataFrame:
    """``(level, code)`` for each rule that holds in a row of ``meta``; no rows: healthy. A rule whose figures are absent or null is silent.

    Scans too old (last_event_scan, last_catalog_scan); drafts of the day (created, delivered)
    none, fewer than ``drafts_a_day``, or made and none delivered; candidates (ready_count) below
    the next batch (target), and distinct pictures (unique_photos) below it or six.
    """
    has = lambda *cols: all(c in meta.columns for c in cols)
    age = lambda c: (F.unix_timestamp(ts(as_of)) - F.unix_timestamp(c)) / 3600
    rules_ = [
        (("last_event_scan",), lambda: age("last_event_scan") > event_hours, "events_stale"), (("last_catalog_scan",), lambda: age("last_catalog_scan") > catalog_hours, "catalog_stale"),
        (("delivered",), lambda: F.col("delivered") == 0, "drafts_today"), (("delivered",), lambda: (F.col("delivered") > 0) & (F.col("delivered") < drafts_a_day), "drafts_today_incomplete"),
        (("created", "delivered"), lambda: (F.col("created") > 0) & (F.col("delivered") == 0), "draft_delivery_failed"), (("ready_count", "target"), lambda: F.col("ready_count") < F.col("target"), "draft_candidates_low"),
        (("unique_photos", "target"), lambda: F.col("unique_photos") < F.least("target", F.lit(6)), "draft_visuals_low"),
    ]
    found = [F.when(rule(), F.struct(F.lit("warn").alias("level"), F.lit(code).alias("code"))) for cols, rule, code in rules_ if has(*cols)]
    return meta.select(F.explode(F.array_compact(F.array(*found))).alias("w")).select("w.level", "w.code")


def overall_status(warnings: DataFrame) -> DataFrame:
    """One row: degraded with an error, warning with a warning, else ok."""
    return warnings.agg(F.when(F.count_if(F.col("level") == "error") > 0, "degraded").when(F.count_if(F.col("level") == "warn") > 0, "warning").otherwise("ok").alias("status"))


def completeness(items: DataFrame, section: str, checks: dict[str, Column]) -> DataFrame:
    """Per section: items and the share for which each check holds."""
    return items.groupBy(section).agg(F.count("*").alias("items"), *[F.avg(F.coalesce(p, F.lit(False)).cast("double")).alias(n) for n, p in checks.items()])


def validate_registry(sources: DataFrame) -> DataFrame:
    """``(id, level, code)``: missing names, types or urls, and ids used twice."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    found = [F.when(blank(F.col("id")), F.struct(F.lit("error").alias("level"), F.lit("no_id").alias("code"))), F.when(blank(F.col("name")), F.struct(F.lit("error").alias("level"), F.lit("no_name").alias("code"))),
             F.when(blank(F.col("type")), F.struct(F.lit("error").alias("level"), F.lit("no_type").alias("code"))), F.when(F.coalesce("enabled", F.lit(True)) & blank(F.col("url")), F.struct(F.lit("warning").alias("level"), F.lit("enabled_without_url").alias("code")))]
    own = sources.select("id", F.explode(F.array_compact(F.array(*found))).alias("w")).select("id", "w.level", "w.code")
    twice = sources.where(~blank(F.col("id"))).groupBy("id").count().where("count > 1").select("id", F.lit("error").alias("level"), F.lit("duplicate_id").alias("code"))
    return own.unionByName(twice)


def stale_sections(registry: DataFrame, runs: DataFrame, as_of: datetime | str) -> DataFrame:
    """Sections whose last run is older than their refresh_days, or that never ran."""
    last = runs.groupBy("section_id").agg(F.max("generated_at").alias("last_run"))
    j = registry.join(last, "section_id", "left")
    return j.withColumn("stale", F.col("last_run").isNull() | (F.timestamp_add("DAY", F.col("refresh_days"), F.col("last_run")) < ts(as_of)))


def recent(ev: DataFrame, n: int = 100, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """The newest ``n`` rows."""
    return ev.orderBy(*[F.desc(c) for c in order]).limit(n)


def bounded_history(log: DataFrame, key: str, value: str, when: str, n: int = 25) -> DataFrame:
    """For each key its ``n`` newest distinct values: one row a value, the newest occurrence."""
    newest = log.groupBy(key, value).agg(F.max(when).alias(when))
    w = Window.partitionBy(key).orderBy(F.desc(when), value)
    return newest.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def rate_limit(ev: DataFrame, subject: str, limit: int, seconds: int = 60) -> DataFrame:
    """Each event with its window, its number there by subject, and whether it exceeds the limit."""
    start = F.window("ts", f"{seconds} seconds").start
    w = Window.partitionBy(subject, "window_start").orderBy("ts", "event_id")
    return ev.withColumn("window_start", start).withColumn("k", F.row_number().over(w)).withColumn("limited", F.col("k") > limit)


def toggle_state(log: DataFrame, user: str, item: str) -> DataFrame:
    """Per user and item: active after an odd number of toggles, and the last one's time."""
    return log.groupBy(user, item).agg((F.count("*") % 2 == 1).alias("active"), F.max("ts").alias("last_ts"))


def sanitize_events(raw: DataFrame, salt: str, keys: int = 12, length: int = 120) -> DataFrame:
    """Lengths cut, at most ``keys`` metadata entries (first by name), the user hashed."""
    from ..functions.keys import user_hash

    kept = F.slice(F.array_sort(F.map_keys("metadata")), 1, keys)
    meta = F.transform_values(F.map_filter("metadata", lambda k, v: F.array_contains(kept, k)), lambda k, v: F.substring(v, 1, length))
    cut = lambda c: F.substring(F.col(c), 1, length).alias(c)
    return raw.select("ts", cut("type"), cut("action"), cut("label"), cut("source"), user_hash(F.col("user_id"), salt).alias("user_hash"), meta.alias("metadata"))


def classify(df: DataFrame, keywords: dict[str, list[str]] = rules.CATEGORY_KEYWORDS, cols: Sequence[str] = ("title", "summary")) -> DataFrame:
    """Scores by category (keywords that the text contains), their sum, and the categories that scored, best first."""
    t = F.lower(F.concat_ws(" ", *cols))
    out = df.withColumn("_text", t)
    scores = [F.struct(sum((F.col("_text").contains(w).cast("int") for w in words), F.lit(0)).alias("score"), F.lit(-k).alias("ord"), F.lit(name).alias("name")) for k, (name, words) in enumerate(keywords.items())]
    out = out.withColumn("_scores", F.array(*scores))
    ranked = F.transform(F.filter(F.reverse(F.array_sort("_scores")), lambda s: s.score > 0), lambda s: s["name"])
    return out.withColumn("keyword_categories", ranked).withColumn("keyword_score", F.aggregate("_scores", F.lit(0), lambda a, s: a + s.score)).drop("_text", "_scores")
