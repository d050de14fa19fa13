"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plazafeed.llm import bpe, chat, edit_fingerprint, html_text, license, line_dedup, packing, quality, simhash, warc
from plazafeed.llm.common import new_dir

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "na " * 60_000
PROSE = "One quiet morning the river carried seven boats toward the old stone bridge."
ROWS = [
    (1, PROSE, "en", "s", 76), (1, PROSE, "en", "s", 76), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "   \n\n ", "en", "s", 6),
    (None, PROSE + " Again.", "en", None, 80), (None, None, None, None, None), (5, LONG, "en", "s", len(LONG)), (6, "é" * 9000, "fr", "s", 9000), (7, "😀\x00<|endoftext|> Ⅷ", "xx", "s", 17),
]
CLASH = ["words", "hits", "fp", "bucket", "tie", "rank", "salt", "length", "pos", "gone", "k1", "line", "text_key", "kept", "n_words", "component_id", "root", "node", "key", "t", "turns", "spans"]


def wide(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def docs(spark):
    return wide(spark.createDataFrame(ROWS, SCHEMA))


@pytest.fixture(scope="module")
def none(spark):
    return wide(spark.createDataFrame([], SCHEMA))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def ids_of(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


ALL = Counter(r[0] for r in ROWS)


def test_bpe(docs, none):
    got = bpe.round_trip_digests(docs, BYTE)
    assert ids_of(got) == ALL
    assert {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in got.where("doc_id in (2, 3)").collect()} == {(2, 0, sha("")), (3, 0, sha(""))}
    assert got.where("doc_id = 7").first().decoded_sha256 == sha(ROWS[-1][1])
    back = bpe.decode(bpe.encode(docs, BYTE), BYTE)
    assert set(docs.columns) < set(back.columns) and back.where("coalesce(text, '') <> decoded").isEmpty()
    assert bpe.round_trip_digests(none, BYTE).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs, WORDS).toPandas()
    assert set(got.doc_id.dropna().astype(int)) == {1, 2, 3, 4, 5, 6, 7} and got.doc_id.isna().sum() == 2
    assert got[got.doc_id == 2].length.tolist() == [1] and (got.groupby("sequence_id").length.sum() <= 4096).all()
    assert got[got.doc_id == 5].length.sum() == 60_001 and packing.pack(none, WORDS).count() == 0


def test_license(docs, none):
    got = license.scan(docs)
    assert ids_of(got) == ALL
    r = got.where("doc_id = 2").first()
    assert (r.n_words, r.n_base, r.first_word, r.base_labels, r.labels, r.score) == (0, 0, None, "", "", 0.0)
    assert license.scan(none).count() == 0


def test_quality(docs, none):
    got = quality.assess(docs)
    assert ids_of(got) == ALL and got.where("doc_id = 1 and kept").count() == 2
    assert got.where("doc_id = 5").first().n_repeat_words == 60_000 and not got.where("doc_id = 2").first().kept
    assert quality.keep_good(docs).columns == docs.columns and ids_of(quality.keep_good(docs)) == Counter({1: 2, None: 1})
    assert quality.remove_lines(docs).count() == 3 and quality.assess(none).count() == 0 and quality.keep_good(none).count() == 0


def test_warc(spark):
    big = "<p>" + "x" * 2000
    pages = wide(spark.createDataFrame([(1, "u", big), (2, None, big), (3, "u\r\n", None), (None, "u", big), (4, "u", "é" * 3), (4, "u", "é" * 3), (2, "v", big)], "page_id long, url string, html string"))
    root = new_dir(spark, "warc")
    warc.write_archive(pages, root, roll_bytes=200)
    got = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archive(spark, root).collect())
    assert [g[:3] for g in got] == [(-1, "response", None), (1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (3, "response", None), (4, "response", None), (4, "response", None)]
    empty = new_dir(spark, "warc")
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "user", None), (1, None, None, "~1[<]"), (1, 0, "user", None), (None, 1, "tool[x]", "ok"), (2, 1, "assistant", "[/INST]</s>~")], "conv_id long, turn long, role string, text string")
    turns = turns.select("*", F.lit("x").alias("turns"), F.lit("y").alias("formatted"))
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("", "~1[<]"), ("user", ""), ("user", "")]
    assert [(t.role, t.text) for t in got[None].turns] == [("tool[x]", "ok")] and got[2].loss_text == "[/INST]</s>~"
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_simhash(docs, none):
    got = simhash.near_groups(docs)
    assert ids_of(got) == ALL
    zero = got.where("fingerprint = '0000000000000000'").select("component_id").distinct().collect()
    assert [r.component_id for r in zero] == [2]
    assert simhash.near_groups(none).count() == 0 and simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(none).count() == 0
    assert {2, 5, 6, 7, 1} <= set(ids_of(simhash.keep_one(docs)))


def test_html(spark):
    pages = wide(spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", "<p>" * 20000 + "deep"), (3, "u", "<table><td>x"), (4, "u", "a < b & c <")], "page_id long, url string, html string"))
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {1: "", None: "", 2: "deep", 3: "x", 4: "a < b & c <"} and html_text.extract(pages.limit(0)).count() == 0


def test_lines(docs, none):
    got = line_dedup.remove_repeats(docs)
    assert got.columns == docs.columns and ids_of(got) == ALL
    assert got.where("doc_id = 2").first().text == "" and got.where("doc_id = 4").first().text == "   \n\n "
    assert ids_of(line_dedup.summary(docs)) == ALL and line_dedup.summary(none).count() == 0
    # the row without id comes first; the next line has 13 of its 14 tokens
    assert {r.text for r in got.where("doc_id = 1").collect()} == {""}


def test_edit_fingerprints(docs, none):
    got = edit_fingerprint.edited_pairs(docs)
    assert ids_of(got) == ALL and got.where("near_edited not between 0 and 1 or near_next not between 0 and 1").isEmpty()
    assert got.where("doc_id = 1").select("fingerprint").distinct().count() == 1
    assert edit_fingerprint.edited_pairs(none).count() == 0
    assert ids_of(edit_fingerprint.near_groups(docs)) == ALL and edit_fingerprint.near_groups(none).count() == 0


def test_stages(spark, docs, none):
    for df in (docs.select(*SCHEMA.replace(",", "").split()[::2]), none.select(*SCHEMA.replace(",", "").split()[::2])):
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, df, "")
            assert k == 3 or out.columns == df.columns
            out.count()
