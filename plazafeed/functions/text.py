"""Text expressions: normalising, tokens, trimming, quality, mojibake, lists."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import rules

#: Where a word of ASCII letters begins or ends; other letters do not count as word characters.
ASCII_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
ENTITIES = [("&nbsp;", " "), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&laquo;", "«"), ("&raquo;", "»"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def first_truthy(*cols: Column) -> Column:
    """The first that is neither null nor an empty string."""
    return F.coalesce(*[F.when(c.cast("string") != "", c) for c in cols])


def decode_entities(c: Column, entities: Sequence[tuple[str, str]] = ENTITIES) -> Column:
    for name, char in entities:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip_html(c: Column, entities: Sequence[tuple[str, str]] = ENTITIES) -> Column:
    """Scripts, styles, comments and tags go; ``entities`` are decoded; blanks collapse."""
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]+>"):
        c = F.regexp_replace(c, pattern, " ")
    return F.trim(F.regexp_replace(decode_entities(c, entities), r"[\s\x{A0}]+", " "))


def normalize(c: Column) -> Column:
    """Entities decoded, no-break spaces plain, blanks collapsed and none beside a line end, at most one empty line, trimmed."""
    c = F.replace(decode_entities(F.coalesce(c, F.lit(""))), F.lit("\u00a0"), F.lit(" "))
    c = F.regexp_replace(F.replace(c, F.lit("\r"), F.lit("\n")), r"\n{3,}", "\n\n")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" *\n *", "\n")
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def fingerprint_text(c: Column) -> Column:
    """Lower case, ё as е, everything but a-z, а-я and digits a single blank."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е"), r"[^a-zа-я0-9]+", " "))


def compact_text(c: Column) -> Column:
    """Letters a-z, а-я, ё and digits of the lower-cased text, with nothing between."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-zа-яё0-9]+", "")


def label_text(c: Column) -> Column:
    """Lower case without quotation marks; everything but a-z, а-я, ё and digits a single blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[«»\"']", ""), "[^a-zа-яё0-9]+", " "))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC, which SQL has no function for."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def search_text(c: Column) -> Column:
    """NFKC, lower case, ё as е, letters and digits of any script, single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(nfkc(c)), "ё", "е"), r"[^\p{L}\p{N}]+", " "))


def tokens(c: Column, stop: Sequence[str] = rules.STOP_WORDS) -> Column:
    """Distinct words of ``fingerprint_text`` with three characters or more, without stop words."""
    return plain_tokens(fingerprint_text(c), stop)


def plain_tokens(plain: Column, stop: Sequence[str] = rules.STOP_WORDS) -> Column:
    """``tokens`` of a text that is a fingerprint text already."""
    words = F.filter(F.split(plain, " "), lambda w: F.length(w) >= 3)
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else F.array_distinct(words)


def quoted_tokens(c: Column) -> Column:
    """Tokens of what stands in quotation marks."""
    return tokens(F.array_join(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[«\"“]([^»\"”]+)[»\"”]"), 1), " "))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared tokens against the shorter list; 0 if one is empty."""
    return F.when(F.least(F.size(a), F.size(b)) > 0, overlap(a, b) / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


#: What a full stop ends without ending a sentence, and words that a cut text must not end in.
ABBREVIATIONS = "г|им|ул|д|стр|пр|респ|пос|с"
DANGLING = "и|а|но|или|что|чтобы|как|где|когда|если|который|которая|которое|которые|каком-то|какой-то|какая-то|какие-то"
#: What a text that was cut loses at its end, in this order: an open bracket, what follows a last dash or slash, a
#: word that needs another, a last short word, an abbreviation. Boundaries are those of ASCII words.
LOOSE_ENDS = [
    (r"\s*\([^)]*\z", ""), (r"\s+[–—-]\s*[^–—-]*\z", ""), (r"\s+/\s*[^/]*\z", ""), (rf"(?iu)\s+(?:{DANGLING})\s*\z", ""),
    (r"\s+[А-Яа-яЁё]{1,10}\s*\z", ""), (rf"(?iu)(?<=[A-Za-z0-9_])(?:{ABBREVIATIONS})\.\z", ""),
]


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, which is computed once however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), 0)


def ensure_sentence(c: Column) -> Column:
    """The text with one mark at its end that closes a sentence."""
    c = F.regexp_replace(F.regexp_replace(normalize(c), r"(?:\.{3,}|…)\s*\z", "."), r"[,:;–—-]\s*\z", ".")
    return let(F.trim(c), lambda x: F.when(x == "", "").when(x.rlike(r"[.!?]\z"), x).otherwise(F.concat(x, F.lit("."))))


def trim_text(c: Column, limit: int) -> Column:
    """At most ``limit`` characters: to the last sentence end at 45 per cent or later, else to a word, without loose ends and closed by a full stop."""
    least = int(0.45 * limit)

    def cut(head: Column) -> Column:
        """To a word, without loose ends."""
        out = let(F.regexp_extract(head, r"(?s)^(.*) ", 1), lambda word: F.when(F.length(word) >= least, word).otherwise(head))
        for pattern, to in LOOSE_ENDS:
            out = F.regexp_replace(out, pattern, to)
        return ensure_sentence(F.trim(out))

    def shortened(head: Column) -> Column:
        sentence = F.regexp_extract(head, rf"(?s)^(.*(?:[!?]|(?<!(?iu:[A-Za-z0-9_](?:{ABBREVIATIONS})))\.))", 1)
        return let(sentence, lambda x: F.when(F.length(x) > least, x).otherwise(cut(head)))

    def whole(x: Column) -> Column:
        head = F.regexp_replace(F.substring(x, 1, max(0, limit - 1)), r"^\s+|\s+\z", "")
        return F.when(F.length(x) <= limit, x).otherwise(let(head, shortened))

    return let(normalize(c), whole)


def ellipsis(c: Column, limit: int, mark: str = "…") -> Column:
    c = F.coalesce(c, F.lit(""))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, limit - len(mark))), F.lit(mark)))


def sentences(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[^.!?]+[.!?]?"), 0)
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda s: s != "")


def lead_summary(c: Column, count: int = 2, limit: int = 180) -> Column:
    """The first sentences of the normalised text on one line, trimmed; the whole where it has none."""
    c = normalize(c)
    lead = F.array_join(F.slice(sentences(F.regexp_replace(c, r"\n+", " ")), 1, count), " ")
    return trim_text(F.when(lead == "", c).otherwise(lead), limit)


def whole_sentences(c: Column, limit: int = 180) -> Column:
    """As many first sentences as fit whole, one blank between."""
    add = lambda acc, s: F.when(acc.full, acc).when(F.length(acc.t) + F.length(s) + F.when(acc.t == "", 0).otherwise(1) <= limit, F.struct(F.when(acc.t == "", s).otherwise(F.concat(acc.t, F.lit(" "), s)).alias("t"), F.lit(False).alias("full"))).otherwise(F.struct(acc.t.alias("t"), F.lit(True).alias("full")))
    return F.aggregate(sentences(c), F.struct(F.lit("").alias("t"), F.lit(False).alias("full")), add, lambda acc: acc.t)


def keyword_sentence(c: Column, words: Sequence[str]) -> Column:
    """The first sentence that holds one of ``words``, else the first."""
    has = F.filter(sentences(c), lambda s: F.lower(s).rlike("|".join(words)))
    return F.coalesce(F.get(has, 0), F.get(sentences(c), 0))


def highlight(c: Column, title: Column, venue: Column, min_chars: int = 24) -> Column:
    """The text without its title and venue, null below ``min_chars``."""
    for part in (title, venue):
        c = F.when(F.coalesce(part, F.lit("")) == "", c).otherwise(F.replace(c, part, F.lit(" ")))
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(c) >= min_chars, c)


#: Labels with which a sentence gives a date or place and tells nothing else.
LABELS = "дата|место|площадка|адрес|когда|где"


def has_highlight(c: Column, least: int = 24) -> Column:
    """Whether the text has something to tell: ``least`` characters or more with letters or digits, and no mere date or place."""
    n = normalize(c)
    return (F.length(n) >= least) & (fingerprint_text(n) != "") & ~n.rlike(rf"(?iu)^({LABELS})\s*:")


def text_quality(c: Column) -> Column:
    c = normalize(c)
    return F.length(c) + F.when(c.rlike('[«»"]'), 6).otherwise(0)


#: Words before a name that say no more than the name.
COLLECTIVE = "группы|певца|артиста|команды|оркестра"


def title_quality(c: Column) -> Column:
    c = normalize(c)
    return F.length(c) + F.when(c.rlike("[0-9]"), 20).otherwise(0) + F.when(c.rlike('[«»"]'), 8).otherwise(0) - F.when(c.rlike(rf"(?iu)^(?:{COLLECTIVE})\s+"), 18).otherwise(0)


def summary_quality(c: Column) -> Column:
    c = normalize(c)
    return F.least(F.length(c), F.lit(260)) + F.when(c.rlike("[.!?]"), 15).otherwise(0) + F.when(c.rlike("[0-9]"), 10).otherwise(0)


def clean_title(c: Column) -> Column:
    """Without a leading date or time, a leading word for tickets and a trailing site name."""
    for pattern in (r"^\s*\d{1,2}[:.]\d{2}\s*[-–—,]?\s*", r"^\s*\d{1,2}\.\d{1,2}(?:\.\d{4})?\s*[-–—,]?\s*", r"(?iu)^(?:билеты на|купить билеты на|афиша)\s*[:\-–—]?\s*"):
        c = F.regexp_replace(c, pattern, "")
    return without_site(c)


def without_site(c: Column) -> Column:
    """Without a trailing site name alone."""
    return F.trim(F.regexp_replace(c, r"\s+[|]\s+[^|]*$", ""))


def mojibake_hits(c: Column) -> Column:
    """How many pairs of characters look like UTF-8 read as a one-byte code page."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit("[РС][\u0080-¿Ѐ-Џѐ-џ°±²³µ¶·]|[ÃÐÑ][\u0080-¿]"))


def is_mojibake(c: Column) -> Column:
    n = mojibake_hits(c)
    return (n >= 3) | (n > 0.04 * F.length(F.coalesce(c, F.lit(""))))


#: The upper half of code page 1251 (0x98 is free), and the bytes as the characters with their numbers.
_CP1251 = bytes(b for b in range(128, 256) if b != 0x98).decode("cp1251")
_BYTES = "".join(chr(b) for b in range(128, 256) if b != 0x98)


def recode(c: Column) -> Column:
    """The bytes that code page 1251 has for the text, read as UTF-8; null where it lacks a character or they are none."""
    known = "".join(f"\\x{{{ord(x):x}}}" for x in _CP1251)
    data = F.encode(F.when(~c.rlike(rf"[^\x00-\x7f{known}]"), F.translate(c, _CP1251, _BYTES)), "ISO-8859-1")
    return F.try_validate_utf8(data.cast("string"))


def repair_mojibake(c: Column) -> Column:
    """The text read the other way, where it looks garbled and that leaves less noise."""
    return let(recode(F.when(is_mojibake(c), c)), lambda x: F.when(x.isNotNull() & (mojibake_hits(x) < mojibake_hits(c)), x).otherwise(c))


def parse_list(c: Column, limit: int = 12) -> Column:
    """Items divided by line ends or semicolons, trimmed, without empty ones."""
    return F.slice(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n;]"), lambda x: F.trim(x)), lambda x: x != ""), 1, limit)


def parse_links(c: Column) -> Column:
    """``label|url`` items as structs; an item without a bar is a url."""
    return F.transform(parse_list(c), lambda x: F.struct(F.when(x.contains("|"), F.trim(F.substring_index(x, "|", 1))).otherwise(F.lit("")).alias("label"), F.trim(F.substring_index(x, "|", -1)).alias("url")))
