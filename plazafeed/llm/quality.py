"""Quality rules: repetition inside a text, and lines that many documents of a host share.

DataFrame functions alone. A first pass turns each text into its counts and the hashes of
its normalised lines and stages that; host statistics, the lines above the limits and the
verdicts then come from this small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_or_empty

SPACE = " \t\n\x0b\x0c\r"
WORDS = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rows of a small table that may be broadcast (16 bytes each and its host's name); a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def _only_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def text_key() -> Column:
    """With doc_id and source, names a row for joins; equal rows have equal verdicts."""
    return F.xxhash64(F.col("source"), text_or_empty())


def measure(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, source, text_key, the counts that the text alone gives, and lines(hash, words).

    n_repeat_words: positions inside 5-word windows that occur twice or more in the text.
    Windows are compared by 64-bit hashes, sorted; those found twice are placed, and the
    places joined. lines: in order, those with a word, normalised (lower case, blanks
    collapsed).
    """
    a = docs.select("doc_id", "source", text_key().alias("text_key"), text_or_empty().alias("text"))
    line_list = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORDS))
    b = a.select(
        "doc_id", "source", "text_key", F.transform(F.regexp_extract_all("text", F.lit(WORDS), 0), lambda w: F.xxhash64(w)).alias("w"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), line_list.alias("raw"),
    )
    w, n = F.col("w"), F.size("w")
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    norm = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[\x20\x09-\x0D]+", " "))
    c = b.select(
        "doc_id", "source", "text_key", n.cast("long").alias("n_words"), "word_chars", "n_symbols", windows.alias("h"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        F.transform("raw", lambda x: F.struct(F.xxhash64(norm(x)).alias("hash"), F.regexp_count(x, F.lit(WORDS)).cast("int").alias("words"))).alias("lines"),
    )
    d = c.withColumn("s", F.sort_array("h"))
    d = d.withColumn("twice", F.exists(F.transform("s", lambda x, i: (i > 0) & (x == F.get("s", i - 1))), lambda x: x))
    e = d.withColumn("p", F.when(F.col("twice"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, i: F.coalesce(x.h == F.get("p", i - 1).h, F.lit(False)) | F.coalesce(x.h == F.get("p", i + 1).h, F.lit(False))
    f = e.withColumn("at", F.sort_array(F.transform(F.filter("p", same), lambda x: x.i)))
    covered = F.aggregate(F.transform("at", lambda x, i: F.when(i == 0, 5).otherwise(F.least(F.lit(5), x - F.get("at", i - 1)))), F.lit(0).cast("long"), lambda s, x: s + x)
    return f.select("doc_id", "source", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "lines")


def frequent_lines(measured: DataFrame, min_docs: int = 10, max_share: float = 0.1) -> DataFrame:
    """``(source, hash)`` of the lines in more than ``min_docs`` and more than ``max_share`` of a host's distinct texts.

    Exact copies of a text count once. A line is taken once a text before anything is
    shuffled, so a hot line costs one row a text, spread by the text.
    """
    texts = measured.select("source", "text_key").distinct().groupBy("source").agg(F.count("*").alias("texts"))
    lines = measured.select("source", "text_key", F.explode(F.array_distinct(F.transform("lines", lambda x: x.hash))).alias("hash")).distinct()
    counts = lines.groupBy("source", "hash").agg(F.count("*").alias("n")).where(F.col("n") > min_docs).withColumnRenamed("source", "host")
    return counts.join(texts, F.col("host").eqNullSafe(F.col("source"))).where(F.col("n") > max_share * F.col("texts")).select("source", "hash")


def assess(docs: DataFrame, min_docs: int = 10, max_share: float = 0.1, min_words: int = 10, max_repeat: int = 20, max_removed: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: its counts, base_failed, removed_words, removed_lines (numbers among lines with a word) and kept.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat`` per cent of
    them in repeated windows. Otherwise a document goes if the lines above the limits take
    more than ``max_removed`` of its words or leave fewer than ``min_words``. Null texts
    have no words and fail; a null source is a host of its own; repeated rows get the same
    verdict; an empty table gives an empty one. Reads doc_id, source and text.
    """
    m = stage(measure(docs), "quality")
    hot = stage(frequent_lines(m, min_docs, max_share), "quality-lines").select(F.col("source").alias("host"), F.col("hash").alias("hot"))
    lines = m.select("doc_id", "source", "text_key", F.posexplode("lines").alias("pos", "line"))
    hit = lines.join(_only_if_small(hot), F.col("source").eqNullSafe(F.col("host")) & (F.col("line.hash") == F.col("hot")))
    lost = hit.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.sort_array(F.collect_set(F.struct("pos", F.col("line.words").alias("words")))).alias("gone"))
    joined = m.drop("lines").join(lost, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    removed = F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda s, x: s + x.words), F.lit(0).cast("long"))
    out = joined.withColumn("removed_words", removed).withColumn("removed_lines", F.coalesce(F.transform("gone", lambda x: x.pos), F.array().cast("array<int>")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    depleted = (F.col("removed_words") > 0) & ((F.col("removed_words") > max_removed * F.col("n_words")) | (F.col("n_words") - F.col("removed_words") < min_words))
    return out.select("doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "removed_lines", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, unchanged."""
    bad = stage(assess(docs, **limits).where(~F.col("kept")).select(F.col("doc_id").alias("__bad_id"), F.col("text_key").alias("__bad_key")).distinct(), "quality-rejected")
    return docs.join(_only_if_small(bad), F.col("doc_id").eqNullSafe(F.col("__bad_id")) & (text_key() == F.col("__bad_key")), "left_anti")


def remove_lines(docs: DataFrame, **limits) -> DataFrame:
    """The kept rows of ``docs`` with the lines above the limits taken out of ``text``; n_chars, where there is one, is made anew for these."""
    v = assess(docs, **limits).where(~F.col("kept") | (F.size("removed_lines") > 0))
    v = stage(v.groupBy(F.col("doc_id").alias("__v_id"), F.col("text_key").alias("__v_key")).agg(F.first("kept").alias("__v_kept"), F.first("removed_lines").alias("__v_gone")), "quality-changed")
    joined = docs.join(_only_if_small(v), F.col("doc_id").eqNullSafe(F.col("__v_id")) & (text_key() == F.col("__v_key")), "left").where(F.coalesce("__v_kept", F.lit(True)))
    parts = F.split(text_or_empty(), "\n", -1)
    with_words = F.filter(F.transform(parts, lambda x, i: F.when(x.rlike(WORDS), i)), lambda i: i.isNotNull())
    places = joined.withColumn("__v_at", F.when(F.size("__v_gone") > 0, F.transform("__v_gone", lambda n: F.get(with_words, n))))
    clean = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("__v_at", i)), "\n")
    out = places.withColumn("text", F.when(F.col("__v_at").isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__v_at").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return out.select(*docs.columns)
