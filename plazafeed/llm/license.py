"""Licence scan with a positional index of rare template words, in DataFrame functions alone.

Words are as rare as the number of templates that have them is small. The index holds, for
every template, the places of its rarest words, those of its mandatory phrases first. A text
is split into words once, and those of its words that the index knows are looked up: each
gives a start (its position less its place in the template). A start counts where enough
different postings of a template meet at the same relative position, give or take a few
inserted words. There every mandatory phrase must stand at its place, and the score is the
share of the template's words that stand at theirs. Where several templates match the same
words, the one that explains most of them stays.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .license_texts import LICENSES

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A text or notice; ``phrases`` must stand in a match (none: the whole text, exactly)."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    base: bool = False

    @cached_property
    def words(self) -> list[str]:
        return re.findall(WORDS, self.text.lower())

    @cached_property
    def keys(self) -> list[tuple[int, list[str]]]:
        """Where each mandatory phrase stands first in the template, and its words."""
        w, out = self.words, []
        for k in (re.findall(WORDS, p.lower()) for p in self.phrases or (self.text,)):
            out.append((next(i for i in range(len(w)) if w[i : i + len(k)] == k), k))
        return out


#: The phrases whose places a scan counts.
BASE = [Template("mit", "under the mit license", base=True), Template("apache-2", "apache license version 2", base=True), Template("cc-by-nc", "cc by nc", base=True)]
NOTICES = [Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)), Template("mit", "released under the MIT license", ("released under the mit license",)), Template("mit", "licensed under the MIT license", ("licensed under the mit license",))]
TEMPLATES = [*BASE, *NOTICES, *(Template(label, text, tuple(phrases)) for label, text, phrases in LICENSES)]
#: Postings of a template in the index, how many of them must meet, and the inserted or missing words that a match bears.
POSTINGS, MEET, SLACK = 6, 3, 4


#: Fixed value: words of any English text, which are never rare however few templates have them.
COMMON = frozenset("a an and any are as at be but by do for from in is it no not of on or the this to was what with you your".split())


def idf(word: str, templates: list[Template]) -> float:
    """Inverse frequency over the templates; 0 for a common word."""
    return 0.0 if word in COMMON else math.log(len(templates) / sum(word in t.words for t in templates))


def postings(t: Template, templates: list[Template]) -> list[tuple[str, int]]:
    """The index's words of ``t`` and their places: the rarest, ``MEET`` at least from the mandatory phrases, none that a fifth of the templates have but two. Ties: the longer word, then the earlier."""
    rank = lambda i: (-idf(t.words[i], templates), -len(t.words[i]), i)
    key = sorted({at + i for at, k in t.keys for i in range(len(k))}, key=rank)[: 2 if t.base else MEET]
    rest = [] if t.base else sorted(set(range(len(t.words))) - {*key}, key=rank)
    order = [*key, *rest][:POSTINGS]
    return [(t.words[i], i) for n, i in enumerate(order) if n < 2 or idf(t.words[i], templates) > math.log(5)]


def needed(t: Template, held: list[tuple[str, int]]) -> int:
    """How many postings must meet at a start: all of a base template, where the phrase is compared exactly."""
    return len(held) if t.base else min(MEET, len({w for w, _ in held}))


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, min_score: float = 0.6) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    places lists every match (template number, first word, share of the template's words
    that stand within ``SLACK`` words of their place, how many these are, how many stand right in place); base templates
    stand whole and exactly. Of matches of one template within ``SLACK`` words, and of
    templates whose matches overlap, one stays: of those with a share of ``min_score`` if
    there are any, the one with most words (ties: the higher share, then the earlier start,
    then the first template); base matches stay apart from that.
    labels has the base labels and those of matches whose share is at least ``min_score``;
    score is the best share of any match, 0 without one. A null or empty text has no words,
    null first_word and last_word and empty labels; a repeated row is scanned again. Only
    doc_id and text are read, texts whole.
    """
    held = [postings(t, templates) for t in templates]
    strings = lambda ws: F.array(*map(F.lit, ws))
    by_word: dict[str, list[tuple[int, int]]] = {}
    for k, ps in enumerate(held):
        for word, o in ps:
            by_word.setdefault(word, []).append((k, o))
    place = lambda k, o: F.struct(F.lit(k).alias("t"), F.lit(o).alias("o"))
    index = F.create_map(*[x for word, ps in sorted(by_word.items()) for x in (F.lit(word), F.array(*[place(k, o) for k, o in ps]))])
    phrase = lambda at, ws: F.struct(F.lit(at).alias("at"), strings(ws).alias("words"))
    need = [needed(t, ps) for t, ps in zip(templates, held)]
    table = F.array(*[
        F.struct(F.lit(t.label).alias("label"), strings(t.words).alias("words"), F.array(*(phrase(*k) for k in t.keys)).alias("keys"), F.lit(0 if t.base else SLACK).alias("slack"), F.lit(n).alias("need"))
        for t, n in zip(templates, need)
    ])
    rare, base_ids = sorted(by_word), [k for k, t in enumerate(templates) if t.base]

    w = F.col("words")
    split = docs.select("doc_id", F.regexp_extract_all(F.translate(text_or_empty(), UPPER, LOWER), F.lit(WORDS), 0).alias("words"))
    hits = F.filter(F.transform(w, lambda x, i: F.when(x.isin(rare), F.struct(x.alias("word"), i.alias("i")))), lambda h: h.isNotNull())
    found = split.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), hits.alias("hits"))
    every = F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(index, h.word), lambda p: F.struct(p.t.alias("t"), (h.i - p.o).alias("at"), p.o.alias("o")))))
    found = found.withColumn("met", F.array_sort(every))

    #: Entries are sorted and all different, so those of one template within SLACK of a start lie close behind its first.
    def enough(x: Column, i: Column) -> Column:
        before, own = F.get("met", i - 1), F.get(table, x.t)
        first = ~F.coalesce((before.t == x.t) & (before["at"] == x["at"]), F.lit(False))
        near = F.filter(F.slice("met", i + 1, POSTINGS * (SLACK + 1)), lambda y: (y.t == x.t) & (y["at"] <= x["at"] + own.slack))
        return first & (F.size(F.array_distinct(F.transform(near, lambda y: y.o))) >= own.need)

    def stands(c: Column) -> Column:
        own = F.get(table, c.t)

        def there(k: Column) -> Column:
            def at(s: Column) -> Column:
                first = c["at"] + k["at"] + s
                return F.when(first >= 0, F.slice(w, first + 1, F.size(k.words)) == k.words).otherwise(False)

            return F.exists(F.sequence(-own.slack, own.slack), at)

        return F.forall(own["keys"], there)

    def scored(c: Column) -> Column:
        own = F.get(table, c.t)

        def has(x: Column, j: Column) -> Column:
            low, high = F.greatest(c["at"] + j - own.slack, F.lit(0)), c["at"] + j + own.slack
            return F.when(high >= low, F.array_contains(F.slice(w, low + 1, high - low + 1), x)).otherwise(False)

        same = F.size(F.filter(F.transform(own.words, has), lambda x: x))
        exact = F.size(F.filter(F.transform(own.words, lambda x, j: F.equal_null(x, F.get(w, c["at"] + j))), lambda x: x))
        return F.struct(c.t.alias("t"), c["at"].alias("at"), (same / F.size(own.words)).alias("score"), same.alias("same"), exact.alias("exact"))

    #: p loses to q: a share too low for a label; equal: fewer words, fewer right in place, a lower share, a later start, a later template.
    rank = lambda p: F.struct(p.score < min_score, -p.same, -p.exact, -p.score, p["at"], p.t)
    base = lambda p: p.t.isin(base_ids)

    def alone(p: Column, i: Column) -> Column:
        around = F.slice("scored", F.greatest(i - SLACK, F.lit(0)) + 1, 2 * SLACK + 1)
        return base(p) | ~F.exists(around, lambda q: (q.t == p.t) & (F.abs(q["at"] - p["at"]) <= SLACK) & (rank(q) < rank(p)))

    def stays(p: Column) -> Column:
        ends = lambda x: x["at"] + F.size(F.get(table, x.t).words)
        return base(p) | ~F.exists("apart", lambda q: ~base(q) & (q["at"] < ends(p)) & (p["at"] < ends(q)) & (rank(q) < rank(p)))

    step = found.withColumn("starts", F.filter("met", enough))
    step = step.withColumn("scored", F.transform(F.filter("starts", stands), scored))
    step = step.withColumn("apart", F.filter("scored", alone))
    places = step.select("doc_id", "n_words", F.filter("apart", stays).alias("places"))
    at = F.transform(F.filter("places", base), lambda p: p["at"])
    names = lambda keep: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("places", keep), lambda p: F.get(table, p.t).label))), ",")
    return places.select(
        "doc_id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        names(base).alias("base_labels"), names(lambda p: p.score >= min_score).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p.score)), F.lit(0.0)).alias("score"), "places",
    )
