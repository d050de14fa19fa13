"""Row filters. Each takes and returns a DataFrame, or gives the predicate as a Column."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, rules, text
from ..functions.time import end_of_local_year, local_day_end, local_day_start, ts


def _any(preds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds, F.lit(False))


def is_feed_item(with_posts: bool = False) -> Column:
    """In category events, or dated; ``with_posts`` also takes channel posts."""
    p = F.array_contains("categories", "events") | F.col("event_date").isNotNull()
    return F.coalesce(p | (F.col("type") == "telegram") if with_posts else p, F.lit(False))


def rejected(c: Column, keywords: Sequence[str] = rules.BLOCKED_KEYWORDS, letters: str = rules.BLOCKED_LETTERS) -> Column:
    """Holds a blocked letter, or a blocked keyword in normalised text."""
    words = [w.replace("ё", "е") for w in keywords]
    # a word of letters and digits stands in the normalised text where it stands in the lower-cased one
    plain = F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е") if all(re.fullmatch("[a-zа-я0-9]+", w) for w in words) else text.fingerprint_text(c)
    return F.coalesce(c.rlike(f"[{letters}]"), F.lit(False)) | text.let(plain, lambda x: _any([x.contains(w) for w in words]))


def reject_content(df: DataFrame, **rule) -> DataFrame:
    return df.where(~rejected(F.concat_ws(" ", "title", "summary"), **rule))


def in_allowed_window(df: DataFrame, as_of: datetime | str, start: datetime | str, end: datetime | str) -> DataFrame:
    """Dated within the window; an explicit time must not have passed; content not rejected."""
    timely = ~F.coalesce("event_has_explicit_time", F.lit(False)) | (F.col("event_date") >= ts(as_of))
    return reject_content(df.where(F.col("event_date").between(ts(start), ts(end)) & timely))


def resolve_range(params: DataFrame, as_of: datetime | str, tz: str) -> DataFrame:
    """``params(allowed_from, allowed_to, req_from, req_to, preset)`` with from_ts and to_ts.

    Presets today, 3days and week start today; otherwise the asked range, its ends in
    order, clamped to the allowed one; without one, from today or the allowed start.
    """
    today = local_day_start(ts(as_of), tz)
    days = F.when(F.col("preset") == "today", 1).when(F.col("preset") == "3days", 3).when(F.col("preset") == "week", 7)
    low = F.when(days.isNotNull(), today).otherwise(F.coalesce(F.least("req_from", "req_to"), F.greatest(F.col("allowed_from"), today)))
    high = F.when(days.isNotNull(), F.timestamp_add("DAY", days, today) - F.expr("INTERVAL '0.001' SECOND")).otherwise(F.coalesce(F.greatest("req_from", "req_to"), F.col("allowed_to")))
    out = params.withColumn("from_ts", F.greatest(low, F.col("allowed_from"))).withColumn("to_ts", F.least(high, F.col("allowed_to")))
    return out.withColumn("to_ts", F.greatest("from_ts", "to_ts"))


def drop_expired(df: DataFrame, as_of: datetime | str, tz: str) -> DataFrame:
    """An explicit time expires at that time, a date at the end of its local day; undated rows have expired."""
    expires = F.when(F.coalesce("event_has_explicit_time", F.lit(False)), F.col("event_date")).otherwise(local_day_end(F.col("event_date"), tz))
    return df.where(expires >= ts(as_of))


def within_days(df: DataFrame, date: Column, n: int, as_of: datetime | str, tz: str = "UTC") -> DataFrame:
    """From the start of today until ``n`` days from now; undated rows pass if ``n`` is 7 or more."""
    inside = date.between(local_day_start(ts(as_of), tz), ts(as_of) + F.expr(f"INTERVAL '{n}' DAY"))
    return df.where(F.when(date.isNull(), F.lit(n >= 7)).otherwise(inside))


def match_categories(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Any of ``wanted``: all; expected (several sources or priority 80); festival (kind or text); else the kind."""
    if not wanted or "all" in wanted:
        return df
    one = {
        "expected": (F.col("source_count") > 1) | (F.col("priority_score") >= 80),
        "festival": (F.col("kind") == "festival") | F.lower(F.concat_ws(" ", "title", "summary")).contains("фестивал"),
    }
    return df.where(_any([F.coalesce(one.get(c, F.col("kind") == c), F.lit(False)) for c in wanted]))


def drop_outside_area(df: DataFrame, patterns: Sequence[str] = rules.OUTSIDE_AREA, cols: Sequence[str] = ("title", "venue_title", "url")) -> DataFrame:
    """Rows in which none of the patterns stands, whatever the case."""
    return df.where(~F.concat_ws(" ", *cols).rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))) if patterns else df


def has_any_category(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.where(F.arrays_overlap("categories", F.array(*map(F.lit, wanted))))


def search(df: DataFrame, query: str, cols: Sequence[str], synonyms: Sequence[str] = ()) -> DataFrame:
    """Rows whose joined fields (arrays too) and synonyms contain the normalised query; an empty query keeps all."""
    q = F.trim(F.regexp_replace(F.translate(F.lower(F.lit(query)), "ё", "е"), r"[^\p{L}\p{N}]+", " "))
    hay = F.concat_ws(" ", *cols, *map(F.lit, synonyms))
    return df.where(F.regexp_replace(F.translate(F.lower(hay), "ё", "е"), r"[^\p{L}\p{N}]+", " ").contains(q))


def valid_payload(df: DataFrame, generic: Sequence[str] = ("афиша", "билеты", "расписание")) -> DataFrame:
    """A title that is not a listing's name, a url, and text of three letters or more that is no placeholder."""
    title = text.fingerprint_text(F.col("title"))
    body = text.fingerprint_text(text.first_truthy(F.col("summary"), F.col("title")))
    return df.where((F.length(title) >= 3) & ~title.isin(*generic) & F.col("url").rlike("^https?://") & (F.length(body) >= 3) & ~body.rlike("^(null|undefined|none|test)$"))


def drop_private_hosts(df: DataFrame, url: Column) -> DataFrame:
    return df.where(~F.coalesce(keys.is_private_host(keys.host(url)), F.lit(True)))


def keep_this_year(df: DataFrame, as_of: datetime | str, tz: str) -> DataFrame:
    return df.where(F.col("event_date").between(local_day_start(ts(as_of), tz), end_of_local_year(ts(as_of), tz)))


def scan_secrets(docs: DataFrame, names: Sequence[str] = rules.SECRET_KEYS, placeholders: Sequence[str] = rules.PLACEHOLDERS) -> DataFrame:
    """``(doc_id, line, key)``: lines that set a sensitive name to a value of 8 characters or more, or hold a bot token."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "l"))
    key = F.regexp_extract("l", r"(?i)([A-Z0-9_]*(?:" + "|".join(names) + r")[A-Z0-9_]*)\s*[:=]\s*['\"]?[^\s'\"]{8,}", 1)
    safe = F.lower("l").rlike("|".join(f"\\Q{p}\\E" for p in placeholders))
    bot = F.col("l").rlike(r"[0-9]{8,10}:[A-Za-z0-9_-]{35}")
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), F.when(bot, "BOT_TOKEN").when((key != "") & ~safe, F.upper(key)).alias("key")).where(F.col("key").isNotNull())
