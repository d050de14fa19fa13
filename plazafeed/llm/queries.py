"""The registered queries of the text operators and, where SQL can express one, its DuckDB twin."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, cross_tokenizer, edit_fingerprint, hard_negatives, html_text, license, line_dedup, packing, quality, sharding, simhash, warc
from .common import new_dir, stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents")).drop("places")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).drop("text_key", "removed_lines")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_dir(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), root)
    return warc.read_archive(spark, root, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.read_chats(chat.format_chats(turns)))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).drop("url")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"))


def op10_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = stage(edit_fingerprint.edited_pairs(table(spark, sf_dir, "documents")), "edit-pairs")
    return edit_fingerprint.with_classes(pairs)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.whole_vectors(table(spark, sf_dir, "embeddings"))
    return hard_negatives.mine(vectors, F.col("id") % 50 == 0)


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_packing, op3_license, op4_quality, op5_warc, op6_chat, op7_simhash, op8_html, op9_line_dedup, op10_edit_fingerprint,
        op11_sharding, op12_hard_negatives, op13_cross_tokenizer,
    )
}


def _license_sql() -> str:
    """The scan as joins of words, all pairs of what they find compared."""
    T, slack = license.TEMPLATES, license.SLACK
    listed = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)
    held = [license.postings(t, T) for t in T]
    need = [license.needed(t, ps) for t, ps in zip(T, held)]
    words = listed((t, j, w) for t, x in enumerate(T) for j, w in enumerate(x.words))
    posted = listed((t, j, w) for t, ps in enumerate(held) for w, j in ps)
    phrases = listed((t, k, len(ws), at + j, w) for t, x in enumerate(T) for k, (at, ws) in enumerate(x.keys) for j, w in enumerate(ws))
    heads = listed((t, x.label, len(x.words), len(x.keys), x.base, 0 if x.base else slack, n) for t, (x, n) in enumerate(zip(T, need)))
    better = "(q.score >= 0.6, q.same, q.exact, q.score, -q.pos, -q.t) > (p.score >= 0.6, p.same, p.exact, p.score, -p.pos, -p.t)"
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license.UPPER}', '{license.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
tw(t, j, word) AS (VALUES {words}),
pt(t, j, word) AS (VALUES {posted}),
kp(t, k, n, j, word) AS (VALUES {phrases}),
th(t, label, size, n_keys, base, slack, need) AS (VALUES {heads}),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM w),
h AS (SELECT DISTINCT doc_id, t, i - j AS pos, j FROM p JOIN pt USING (word)),
c AS (SELECT a.doc_id, a.t, a.pos, slack, n_keys FROM (SELECT DISTINCT doc_id, t, pos FROM h) a JOIN th USING (t)
 JOIN h b ON b.doc_id = a.doc_id AND b.t = a.t AND b.pos BETWEEN a.pos AND a.pos + slack GROUP BY ALL HAVING count(DISTINCT b.j) >= any_value(need)),
s AS (SELECT unnest(generate_series(-{slack}, {slack})) AS s),
k AS (SELECT doc_id, t, c.pos, n_keys, kp.k FROM c JOIN kp USING (t) JOIN s ON abs(s) <= slack JOIN p USING (doc_id, word) WHERE i = c.pos + kp.j + s GROUP BY doc_id, t, c.pos, n_keys, kp.k, s HAVING count(*) = any_value(n)),
v AS (SELECT doc_id, t, pos FROM k GROUP BY doc_id, t, pos, n_keys HAVING count(DISTINCT k) = n_keys),
o AS (SELECT doc_id, t, v.pos, label, base, size, count(DISTINCT tw.j) AS same, count(DISTINCT tw.j) FILTER (i = v.pos + tw.j) AS exact, CAST(count(DISTINCT tw.j) AS DOUBLE) / size AS score
 FROM v JOIN th USING (t) JOIN tw USING (t) JOIN p USING (doc_id, word) WHERE i BETWEEN v.pos + tw.j - slack AND v.pos + tw.j + slack GROUP BY doc_id, t, v.pos, label, base, size),
o1 AS (SELECT * FROM o p WHERE base OR NOT EXISTS (FROM o q WHERE q.doc_id = p.doc_id AND q.t = p.t AND abs(q.pos - p.pos) <= {slack} AND {better})),
o2 AS (SELECT * FROM o1 p WHERE base OR NOT EXISTS (FROM o1 q WHERE q.doc_id = p.doc_id AND NOT q.base AND q.pos < p.pos + p.size AND p.pos < q.pos + q.size AND {better})),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word,
 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (score >= 0.6) AS labels, max(score) AS score FROM o2 GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
 coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM w LEFT JOIN g USING (doc_id)"""


_QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wi AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM wi QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, source, text, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
ln AS (SELECT doc_id, source, text, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
hosts AS (SELECT source, count(DISTINCT text) AS texts FROM d GROUP BY source),
hot AS (SELECT source, norm FROM ln JOIN hosts USING (source) GROUP BY source, norm, texts HAVING count(DISTINCT text) > 10 AND count(DISTINCT text) > 0.1 * texts),
lost AS (SELECT doc_id, sum(words) AS n FROM ln JOIN hot USING (source, norm) GROUP BY doc_id),
r AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
 CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
 NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (removed_words > 0 AND (removed_words > 0.7 * n_words OR n_words - removed_words < 10)) AS kept FROM r"""

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM m"""

_CHAT_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^~\\[<\\]]', '', 'g')) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9
 ELSE 14 + length(role) + length(regexp_replace(role, '[^~\\[<\\]]', '', 'g')) END AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars,
 regexp_full_match(string_agg(role, '>' ORDER BY turn NULLS FIRST, role, text), '(system>)?user(>assistant>user)*(>assistant)?|system') AS valid
FROM e GROUP BY conv_id"""

#: The checksum is made byte by byte from the text's hexadecimal digits, with the table of the reflected polynomial.
_SHARDING_SQL = """
WITH RECURSIVE t(n, k, c) AS (SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) r(i)
 UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS crc FROM t WHERE k = 8),
b AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size,
 list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(lower(hex(encode(coalesce(text, '')))), '..'), lambda x: CAST('0x' || x AS BIGINT))) AS bytes FROM documents),
d AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, tab),
k AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'null') AS named FROM d),
h AS (SELECT named, i, CAST('0x' || substr(md5(named || ':' || i), 1, 15) AS BIGINT) AS draw FROM (SELECT DISTINCT named FROM k), range(17) r(i)),
s AS (SELECT named, CAST(arg_max(i, draw) FILTER (i < 16) AS INTEGER) AS shard, CAST(arg_max(i, draw) AS INTEGER) AS grown_shard FROM h GROUP BY named)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
 row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(named || ':' || size || ':' || text_crc32), 1, 5) AS BIGINT) % 1024, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM k JOIN s USING (named)"""

_NEGATIVES_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
 FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""

ORACLE_SQL = {"op3_license": _license_sql(), "op4_quality": _QUALITY_SQL, "op5_warc": _WARC_SQL, "op6_chat": _CHAT_SQL, "op11_sharding": _SHARDING_SQL, "op12_hard_negatives": _NEGATIVES_SQL}
