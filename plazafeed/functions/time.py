"""Dates: parsing, local days, windows. Nothing here asks for the current time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def ts(as_of: datetime | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp")


def local_day(c: Column, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(c, tz))


def local_day_start(c: Column, tz: str) -> Column:
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(c, tz)), tz)


def local_day_end(c: Column, tz: str) -> Column:
    return local_day_start(c, tz) + F.expr("INTERVAL '1' DAY") - F.expr("INTERVAL '0.001' SECOND")


def end_of_local_year(c: Column, tz: str) -> Column:
    return F.to_utc_timestamp(F.date_trunc("year", F.add_months(F.date_trunc("year", F.from_utc_timestamp(c, tz)), 12)), tz) - F.expr("INTERVAL '0.001' SECOND")


def date_key(c: Column, tz: str) -> Column:
    return F.date_format(F.from_utc_timestamp(c, tz), "yyyy-MM-dd")


def time_key(c: Column, tz: str) -> Column:
    return F.date_format(F.from_utc_timestamp(c, tz), "HH:mm")


def _let(x: Column, f) -> Column:
    """``f`` of ``x``, which is computed once."""
    return F.get(F.transform(F.array(x), f), 0)


def parse_date(c: Column, as_of: datetime | str, tz: str, stale_days: int = 30) -> Column:
    """struct(ts UTC, explicit): ISO, ``dd.mm.yyyy [hh:mm]``, "12 мая [2026] [19:30]", today, tomorrow.

    A range gives its first day; without a time it is 12:00 and explicit is false; without a
    year the coming one is taken when the date lies more than ``stale_days`` back. Else null.
    """
    months = F.array(*map(F.lit, rules.MONTHS))
    iso, dmy = r"(\d{4})-(\d{2})-(\d{2})", r"(?:^|\D)(\d{1,2})\.(\d{1,2})\.(\d{4})"
    named = r"(\d{1,2})(?:\s*[-–—]\s*\d{1,2})?\s+(" + "|".join(rules.MONTHS) + r")(?:\s+(\d{4}))?"
    time = r"(?:^|[^\d:.])([01]?\d|2[0-3]):([0-5]\d)"
    iso_time = r"t([01]\d|2[0-3]):([0-5]\d)"

    def grab(s: Column, pattern: str, *names: str) -> list[Column]:
        return [F.nullif(F.regexp_extract(s, pattern, k), F.lit("")).alias(n) for k, n in enumerate(names, 1)]

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")))

    def day(p: Column) -> Column:
        number, y = F.array_position(months, p["name"]), F.year(p.today)
        this = made(y.cast("string"), number, p.nd)
        inferred = F.when(F.datediff(p.today, this) > stale_days, made((y + 1).cast("string"), number, p.nd)).otherwise(this)
        in_words = F.when(p.ny.isNotNull(), made(p.ny, number, p.nd)).when(p.nd.isNotNull(), inferred)
        near = F.when(p.s.contains("послезавтра"), F.date_add(p.today, 2)).when(p.s.contains("завтра"), F.date_add(p.today, 1)).when(p.s.contains("сегодня"), p.today)
        return F.coalesce(F.when(p.iy.isNotNull(), made(p.iy, p.im, p.id)), F.when(p.dy.isNotNull(), made(p.dy, p.dm, p.dd)), in_words, near)

    def moment(q: Column) -> Column:
        local = F.to_timestamp(F.concat(q.day.cast("string"), F.lit(" "), F.lpad(F.coalesce(q.hour, F.lit("12")), 2, "0"), F.lit(":"), F.coalesce(q.minute, F.lit("00")), F.lit(":00")))
        utc = F.when(q.zulu, local).otherwise(F.to_utc_timestamp(local, tz))
        return F.when(q.day.isNotNull(), F.struct(utc.alias("ts"), q.hour.isNotNull().alias("explicit")))

    def parts(s: Column) -> Column:
        return F.struct(s.alias("s"), local_day(ts(as_of), tz).alias("today"), *grab(s, iso, "iy", "im", "id"), *grab(s, dmy, "dd", "dm", "dy"), *grab(s, named, "nd", "name", "ny"), *grab(s, time, "h", "m"), *grab(s, iso_time, "th", "tm"), s.rlike(r"t\d{2}:\d{2}(:\d{2}(\.\d+)?)?z").alias("zulu"))

    def found(p: Column) -> Column:
        return F.struct(day(p).alias("day"), F.coalesce(p.th, p.h).alias("hour"), F.coalesce(p.tm, p.m).alias("minute"), p.zulu.alias("zulu"))

    return _let(_let(_let(F.lower(F.trim(F.coalesce(c, F.lit("")))), parts), found), moment)
