"""Templated copy and sanitised patches as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_truthy, trim_text

#: A lead line by kind; templates are data, so a table can replace this map.
LEADS = {"concert": "Живая музыка", "sport": "Матч и эмоции трибун", "theatre": "Вечер в театре", "exhibition": "Выставка", "standup": "Вечер юмора", "festival": "Фестиваль", "excursion": "Прогулка с рассказом"}


def schedule_line(date: Column, explicit: Column, tz: str) -> Column:
    local = F.from_utc_timestamp(date, tz)
    return F.when(date.isNull(), "дата уточняется").when(F.coalesce(explicit, F.lit(False)), F.date_format(local, "dd.MM.yyyy HH:mm")).otherwise(F.date_format(local, "dd.MM.yyyy"))


def post_text(title: Column, summary: Column, venue: Column, date: Column, explicit: Column, kind: Column, url: Column, tz: str, limit: int = 400) -> Column:
    """Title, lead by kind, trimmed summary, place and time, link; empty parts leave no line."""
    lead = F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(LEADS.items()))), F.coalesce(kind, F.lit("")))
    where = F.concat_ws(", ", schedule_line(date, explicit, tz), first_truthy(venue))
    return F.concat_ws("\n\n", first_truthy(title), lead, first_truthy(trim_text(summary, limit)), where, first_truthy(url))


def reminder_text(title: Column, offset: Column, date: Column, tz: str) -> Column:
    when = F.when(offset == "24h", "завтра").when(offset == "1h", "через час").otherwise("скоро")
    return F.format_string("Напоминание: %s — %s, %s", title, when, F.date_format(F.from_utc_timestamp(date, tz), "dd.MM HH:mm"))


def sanitize_patch(patch: Column, caps: dict[str, int], lists: dict[str, int] | None = None, list_limit: int = 12) -> Column:
    """A patch with the allowed fields alone: texts trimmed and cut, empty ones null, lists of at most ``list_limit`` cut texts."""
    cut = lambda c, n: F.substring(F.trim(c), 1, n)
    texts = [F.nullif(cut(patch.getField(f), n), F.lit("")).alias(f) for f, n in caps.items()]
    shorter = lambda n: lambda x: cut(x, n)
    arrays = [F.slice(F.filter(F.transform(patch.getField(f), shorter(n)), lambda x: x != ""), 1, list_limit).alias(f) for f, n in (lists or {}).items()]
    return F.struct(*texts, *arrays)
