"""Feed order, scores, selection and plans."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from itertools import chain
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys, rules, text
from ..functions.time import ts
from . import filters, joins
from .staging import checkpointed


def feed_order(locale: str | None = "ru") -> list[Column]:
    """Sources first, then date (undated last), priority and title; the id settles ties."""
    title = F.collate("title", locale) if locale else F.col("title")
    return [F.desc("source_count"), F.asc_nulls_last("event_date"), F.desc("priority_score"), title, F.col("id")]


def feed(items: DataFrame, as_of: datetime | str, start: datetime | str, end: datetime | str, categories: Sequence[str] = (), limit: int = 600) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` matching rows in feed order, and one row with the total."""
    hits = filters.match_categories(filters.in_allowed_window(items.where(filters.is_feed_item()), as_of, start, end), categories)
    return hits.orderBy(*feed_order()).limit(limit), hits.agg(F.count("*").alias("total"))


def digest(items: DataFrame, n: int = 12) -> DataFrame:
    line = F.format_string("%s — %s", F.col("title"), F.coalesce(F.date_format("event_date", "dd.MM HH:mm"), F.lit("без даты")))
    return items.withColumn("line", line).orderBy(F.desc("score"), "id").limit(n)


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def editorial_score(df: DataFrame, as_of: datetime | str) -> DataFrame:
    """Adds ``editorial_score``: priority, sources, days ahead, kind, text quality, presence of fields and image."""
    d = F.col("event_date")
    days = (F.unix_timestamp(d) - F.unix_timestamp(ts(as_of))) / 86400.0
    date_points = F.when(d.isNull(), -120)
    for bound, points in rules.DATE_POINTS:
        date_points = date_points.when((days < bound) if bound <= 1 else (days <= bound), points)
    date_points = date_points.otherwise(-24)
    kinds = F.create_map(*map(F.lit, chain.from_iterable(rules.KIND_POINTS.items())))
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    bonus = lambda p, n: F.when(p, n).otherwise(0)
    festive = (F.col("kind") == "festival") | F.lower(F.concat_ws(" ", "title", "summary")).contains("фестивал")
    image = F.when(keys.is_clean_image(F.col("image_url")), 46).when(has("image_url"), 12).otherwise(-14)
    score = (
        3 * F.least(F.coalesce("priority_score", F.lit(0.0)), F.lit(220.0)) + 55 * F.least(F.coalesce("source_count", F.lit(1)), F.lit(4)) + date_points
        + F.coalesce(F.try_element_at(kinds, F.coalesce("kind", F.lit(""))), F.lit(28))
        + F.least(F.lit(140), round_half_up(text.summary_quality(F.col("summary")) / 3)) + F.least(F.lit(60), round_half_up(text.title_quality(F.col("title")) / 4))
        + F.least(F.lit(28), round_half_up(text.text_quality(F.col("short_summary")) / 5)) + bonus(F.coalesce("event_has_explicit_time", F.lit(False)), 18)
        + bonus(has("venue_title"), 18) + bonus(has("url"), 12) + bonus(has("source_label"), 8) + bonus(F.coalesce(festive, F.lit(False)), 10) + bonus(text.has_highlight(F.col("summary")), 16) + image
    )
    return df.withColumn("editorial_score", score)


def visual_key() -> Column:
    clean = F.when(keys.is_clean_image(F.col("image_url")), keys.canonical_url(F.col("image_url")))
    place = F.when((F.coalesce("title", F.lit("")) != "") & (F.coalesce("venue_title", F.lit("")) != ""), F.concat_ws("|", F.lower("title"), F.lower("venue_title"), F.coalesce("kind", F.lit(""))))
    return text.first_truthy(clean, place, F.lower("image_url"), F.col("id").cast("string"))


def quotas(limit: int) -> dict[str, int]:
    b = max(1, ceil(limit / 3))
    return {k: b + 1 if k == "concert" else b if k in ("sport", "theatre", "show", "standup") else max(1, b - 1) for k in rules.PREFERRED_KINDS} | {"other": b}


def select_batch(cands: DataFrame, history: DataFrame, pending: DataFrame, limit: int, as_of: datetime | str, tiers: Sequence[int] = (4, 2, 1, 0), score: str = "editorial_score") -> DataFrame:
    """Up to ``limit`` candidates, with the tier, phase and position in which they were taken.

    Tier by tier, the longest cool-down first: the best of each preferred kind that the
    batch has none of yet (phase 1), then the best within kind quotas (2), then the best (3).
    Pending events go by shared identity, as do those posted within the tier's days and
    those that share an identity, a visual, or title and day with what the batch has.
    Ties: the smaller id. A null kind is ``other``; null scores come last.

    A round brings the frontier: of each kind the ``limit`` best rows that share nothing with
    the batch. Choices are made from it for as long as it holds each kind's best free row; a
    kind whose rows in the frontier are used up while more lie behind them ends the round,
    and the next strikes out, over all candidates, what now conflicts. A round follows only
    a choice, so there are at most ``limit`` more rounds than tiers, and mostly one a tier.
    The driver holds ``limit`` rows a kind.
    """
    base = joins.anti_identity(cands, pending).withColumn("visual_key", visual_key())
    marks = joins.identity_keys(base, "id").groupBy("id").agg(F.collect_set("identity").alias("marks"))
    day = F.when(F.coalesce("title_key", F.lit("")) != "", F.concat_ws("|", F.lit("day"), "date_key", "title_key")) if {"date_key", "title_key"} <= set(base.columns) else F.lit(None).cast("string")
    tagged = base.join(marks, "id", "left").withColumn("marks", F.array_compact(F.concat(F.coalesce("marks", F.array().cast("array<string>")), F.array(F.concat(F.lit("visual|"), "visual_key"), day))))
    tagged = tagged.withColumn("kind_group", F.coalesce("kind", F.lit("other")))
    quota, kinds = quotas(limit), rules.PREFERRED_KINDS
    taken: list[tuple] = []
    seen: set[str] = set()
    counts: Counter[str] = Counter()
    order = [F.desc_nulls_last(score), F.col("id")]

    class Frontier:
        """The first free rows of each kind, and whether more lie behind them."""

        def __init__(self, left: DataFrame):
            free = left.where(~F.arrays_overlap("marks", F.array(*map(F.lit, sorted(seen)))) & ~F.col("id").isin([t[0] for t in taken])) if seen else left
            ranked = free.withColumn("place", F.row_number().over(Window.partitionBy("kind_group").orderBy(*order))).where(F.col("place") <= limit + 1)
            self.rows: dict[str, list] = {}
            for r in sorted(ranked.collect(), key=lambda r: r["place"]):
                self.rows.setdefault(r["kind_group"], []).append(r)
            self.more = {k for k, rows in self.rows.items() if len(rows) > limit}
            self.rows = {k: rows[:limit] for k, rows in self.rows.items()}

        def best(self, groups=None):
            """The best free row of ``groups`` (None: of all), or None; LookupError where only a new round can tell."""
            heads = []
            for k in self.rows if groups is None else groups:
                rows = [r for r in self.rows.get(k, ()) if not seen & {*r["marks"]}]
                if rows:
                    heads.append(rows[0])
                elif k in self.more:
                    raise LookupError(k)
            return min(heads, key=lambda r: (r[score] is None, -(r[score] or 0), r["id"]), default=None)

    def take(row, tier: int, phase: int) -> None:
        taken.append((row["id"], tier, phase, len(taken) + 1))
        seen.update(row["marks"])
        counts[row["kind_group"]] += 1

    for tier, days in enumerate(tiers):
        if len(taken) >= limit:
            break
        left = checkpointed((joins.cooldown(tagged, history, as_of, days) if days else tagged).select("id", "kind_group", "marks", score))
        front, wanted = Frontier(left), [k for k in kinds if not counts[k]]

        def best(groups=None):
            nonlocal front
            try:
                return front.best(groups() if groups else None)
            except LookupError:
                front = Frontier(left)
                return front.best(groups() if groups else None)

        for k in wanted:
            if len(taken) < limit and (row := best(lambda k=k: [k])):
                take(row, tier, 1)
        room = lambda: [k for k in front.rows if counts[k] < quota.get(k, quota["other"])]
        for phase, groups in ((2, room), (3, None)):
            while len(taken) < limit and (row := best(groups)):
                take(row, tier, phase)
    kind = dict(tagged.dtypes)["id"]
    picked = cands.sparkSession.createDataFrame(taken, f"id {kind}, tier int, phase int, pos int")
    return tagged.drop("marks", "kind_group").join(F.broadcast(picked), "id")  # at most ``limit`` rows


def next_unposted(items: DataFrame, posted: DataFrame, pending: DataFrame, n: int, key: str = "item_id") -> DataFrame:
    return joins.unposted(items, posted, pending, key).orderBy(F.desc("score"), key).limit(n)


def interleave(df: DataFrame, section: str, order: Sequence[Column | str], priority: dict[str, int] | None = None) -> DataFrame:
    """Round robin: first rows of all sections, then second ones, ...; sections by priority, then name."""
    rn = F.row_number().over(Window.partitionBy(section).orderBy(*order))
    rank = F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(priority.items()))), F.col(section)), F.lit(len(priority))) if priority else F.lit(0)
    return df.withColumn("round", rn).withColumn("section_rank", rank).orderBy("round", "section_rank", section)


def assign_chunks(df: DataFrame, size: int, by: str, order: Sequence[Column | str], mode: str = "replace") -> DataFrame:
    """Chunk numbers of ``size`` rows within ``by``; the first keeps the mode, later ones merge."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return df.withColumn("chunk", F.floor(n / size).cast("int")).withColumn("mode", F.when(F.col("chunk") == 0, mode).otherwise("merge"))


def quota_topn(df: DataFrame, by: str, score: str, quota: int, limit: int, id_col: str) -> DataFrame:
    """The best row of each kind, then rows within the quota, then the rest, up to ``limit``."""
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), id_col))
    d = df.withColumn("kind_rank", r).withColumn("phase", F.when(F.col("kind_rank") == 1, 1).when(F.col("kind_rank") <= quota, 2).otherwise(3))
    return d.orderBy("phase", F.desc(score), id_col).limit(limit)


def score_photos(cands: DataFrame, keep: int = 3) -> DataFrame:
    """Candidates (after ``joins.photo_feedback``, with bytes, width, height) with score 0..100, reasons and risks; the best ``keep`` an item."""
    u = F.lower(F.coalesce("url", F.lit("")))
    big = (F.col("width") >= 900) & (F.col("height") >= 500)
    ratio = F.col("width") / F.nullif(F.col("height"), F.lit(0))
    marks = [
        (F.col("approved"), 45, "approved"), (F.col("rejected"), -90, "rejected"), (F.col("trusted_host"), 14, "trusted host"), (F.col("blocked_host"), -30, "blocked host"),
        (F.col("bytes") >= 80000, 8, "large file"), (F.col("bytes") < 25000, -18, "small file"), (big, 14, "large image"), (~big, -10, "small image"),
        (ratio.between(1.35, 2.2), 12, "landscape"), (ratio < 0.85, -15, "portrait"), (u.rlike("poster|ticket|logo"), -35, "poster or logo"),
        (u.rlike("favicon|sprite|placeholder|blank|icon"), -45, "technical"), (u.rlike("upload|media|photo|image"), 4, "photo path"),
    ]
    points = reduce(lambda a, b: a + b, [F.when(p, n).otherwise(0) for p, n, _ in marks], F.lit(50))
    told = lambda good: F.slice(F.array_compact(F.array(*[F.when(p, F.lit(why)) for p, n, why in marks if (n > 0) == good])), 1, 6)
    out = cands.withColumn("photo_score", F.greatest(F.lit(0), F.least(F.lit(100), points))).withColumn("reasons", told(True)).withColumn("risks", told(False))
    out = out.withColumn("needs_note", F.col("photo_score") < 45)
    w = Window.partitionBy("section_id", "item_id").orderBy(F.desc("photo_score"), "url")
    return out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)


def primary_snapshot(snaps: DataFrame, key: str, order: str) -> DataFrame:
    """Per key the first snapshot that is fine with a real image, else fine with any, else fine."""
    has = F.coalesce("image", F.lit("")) != ""
    tier = F.when(has & ~keys.is_decorative_image(F.col("image")), 0).when(has, 1).otherwise(2)
    cols = [c for c in snaps.columns if c != key]
    return snaps.where("ok").groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(tier.alias("t"), F.col(order).alias("o"))).alias("s")).select(key, "s.*")


def next_preview(cands: DataFrame, shown: DataFrame, key: str = "item_id", order: str = "ord") -> DataFrame:
    """Per item the first candidate image that was neither rejected nor is current."""
    k = cands.withColumn("url_key", keys.canonical_url(F.col("url")))
    left = k.join(shown.select(key, keys.canonical_url(F.col("url")).alias("url_key")), [key, "url_key"], "left_anti")
    return left.groupBy(key).agg(F.min_by("url", order).alias("url"))


def trip_plans(catalog: DataFrame, events: DataFrame, slots: DataFrame) -> DataFrame:
    """Per (days, day, slot) the first preference that exists.

    ``catalog(section, rank, item)`` and ``events(rank, item)`` are ranked pools (``ranked_pool``); ``slots(days,
    day, slot, pref_ord, section, rank)`` lists each slot's fallback chain.
    """
    pool = catalog.select("section", "rank", "item").unionByName(events.select(F.lit("events").alias("section"), "rank", "item"))
    return slots.join(pool, ["section", "rank"]).groupBy("days", "day", "slot").agg(F.min_by("item", "pref_ord").alias("item"), F.min("pref_ord").alias("pref_ord"))


def trip_slots(spark: SparkSession, days: int = 7, week: Sequence[Sequence[Sequence[str]]] = rules.TRIP_WEEK) -> DataFrame:
    """The fallback chains of a trip of ``days`` as ``slots`` for ``trip_plans``."""
    rows = [(days, d, n, k, *p.split(" ")) for d, slots in enumerate(week[:days], 1) for n, prefs in enumerate(slots, 1) for k, p in enumerate(prefs)]
    return spark.createDataFrame([(*r[:5], int(r[5])) for r in rows], "days int, day int, slot int, pref_ord int, section string, rank int")


def ranked_pool(items: DataFrame, slots: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``(section, rank, item)``: the first items of each section in ``order``, as many as any chain of ``slots`` asks of it.

    The ranks asked for are few, so each part of a large section keeps its first ones before the section is ranked.
    """
    most = slots.groupBy("section").agg(F.max("rank").alias("_most"))
    kept = items.join(F.broadcast(most), "section")  # one row a section that a chain names
    for by in (["section", "_part"], ["section"]):
        kept = kept.withColumn("_part", F.pmod(F.xxhash64("item"), F.lit(64)))
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= F.col("_most"))
    return kept.select("section", "rank", "item")


#: Slots that a plan has at most: a week of days with one for every hour.
PLAN_SLOTS = 7 * 24
PACE = {"calm": 2, "normal": 3, "active": 4}


def personalize(plan: DataFrame, prefs: DataFrame) -> DataFrame:
    """Items of each user's day by the weight of their tags, then place; as many as the pace takes.

    ``plan(day, pos, item, tags)``, ``prefs(user_id, pace, tag, weight)``. The plan is one
    week's, and is refused beyond ``PLAN_SLOTS`` rows: every user gets all of it to rank.
    Preferences stay where they are: a tag that most users have is no key of a shuffle.
    """
    if plan.limit(PLAN_SLOTS + 1).count() > PLAN_SLOTS:
        raise ValueError(f"a plan has at most {PLAN_SLOTS} slots")
    pace = F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(PACE.items()))), F.col("pace")), F.lit(3))
    users = prefs.groupBy("user_id").agg(F.max("pace").alias("pace"))
    tagged = plan.select("day", "pos", "item", F.explode_outer("tags").alias("tag"))
    hits = prefs.select("user_id", "tag", "weight").join(F.broadcast(tagged), "tag").groupBy("user_id", "day", "pos", "item").agg(F.sum("weight").alias("score"))
    every = users.crossJoin(F.broadcast(plan.select("day", "pos", "item")))  # its size was checked above
    j = every.join(hits, ["user_id", "day", "pos", "item"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    w = Window.partitionBy("user_id", "day").orderBy(F.desc("score"), "pos")
    return j.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= pace)


def sample_stops(routes: DataFrame, most: int = 7) -> DataFrame:
    """Routes of more than ``most`` stops keep both ends and the first three stops for views or food."""
    mid = F.slice("stops", 2, F.size("stops") - 2)
    picks = F.slice(F.filter(mid, lambda s: F.lower(s).rlike("(?iu)вид|панорам|смотров|кафе|ресторан|бар|food|view")), 1, 3)
    short = F.concat(F.slice("stops", 1, 1), picks, F.slice("stops", -1, 1))
    return routes.withColumn("stops", F.when(F.size("stops") > most, short).otherwise(F.col("stops")))


def recommendations(catalog: DataFrame, per_section: dict[str, int]) -> DataFrame:
    """The first k items of each section."""
    k = F.create_map(*map(F.lit, chain.from_iterable(per_section.items())))
    w = Window.partitionBy("section").orderBy("rank", "item")
    return catalog.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.coalesce(F.try_element_at(k, F.col("section")), F.lit(0)))
