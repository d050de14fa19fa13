"""Sharding, hard negatives and cross-tokenizer alignment against brute force, and their edge cases."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plazafeed.llm import cross_tokenizer as ct
from plazafeed.llm import hard_negatives as hn
from plazafeed.llm import sharding
from plazafeed.llm.bpe import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, shard string, run int, p int"


# ---- cross-tokenizer alignment


def reading(rows):
    """Plain reading: the libraries' own tokenizers, sets of offsets and dictionaries."""
    tk = Tokenizer.from_file(A)
    tk.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {c: i for i, c in enumerate(byte_symbols())}
    entry = {i: s for s, i in tk.get_vocab().items()}
    found, counts = [], Counter()
    for doc, text in rows:
        groups = []
        if text:
            a, b = tk.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            pieces = [[bytes(byte[c] for c in entry[i]) for i in a], [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]]
            if {b"".join(x) for x in pieces} == {(" " + text).encode()}:
                ends = [np.cumsum([*map(len, x)]).tolist() for x in pieces]
                at = [0, 0]
                for end in sorted(set(ends[0]) & set(ends[1])):
                    to = [ends[k].index(end) + 1 for k in (0, 1)]
                    groups.append((a[at[0] : to[0]], b[at[1] : to[1]]))
                    at = to
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        counts.update(links.keys())
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        found.append((doc, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), hashlib.sha256(said.encode()).hexdigest() if said else "", links))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    rows = [(*f[:4], sum(f[5].values()), f[4], sum(m for k, m in f[5].items() if counts[k] == top[k[0]]), sum(m * counts[k] for k, m in f[5].items())) for f in found]
    return sorted(rows, key=str), counts


HARD = [
    "", None, "a", " lead", "tail ", "two  blanks\n\n\tand tabs", "<|endoftext|> <s> </s> <unk>", "▁low line", "naïve café Straße", "日本語のテキスト", "😀 family 👨‍👩‍👧", "é combining", "x\x00y", "=" * 700,
    "ab" * 3000, " " * 500, "　wide blank", "don't we'll I'm", "0123456789" * 40, "the cat sat on the mat",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(19, HARD[19]), (None, HARD[19])]
    more = [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").collect()]
    return rows + more


@pytest.mark.parametrize("links, big, fan, block", [(4_000_000, 4096, 64, 4096), (500, 8, 2, 16)])
def test_alignment_is_the_plain_reading(spark, docs, monkeypatch, links, big, fan, block):
    for name, value in (("RUN_LINKS", links), ("BIG_GROUP", big), ("FAN_IN", fan), ("BLOCK", block), ("TEXT_BYTES", 2000 if links < 1000 else 2 << 20)):
        monkeypatch.setattr(ct, name, value)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], SCHEMA)
    # what a task does is run here too, with the small settings
    aligner = ct.load_aligner(A, B)
    run, n = ct.Run(aligner, 3), 0
    for at in range(0, len(docs), 7):
        x = ct.Aligned(aligner, [t or "" for _, t in docs[at : at + 7]])
        for doc, a, b, times in x.links(links):
            run.add(doc + n, a, b, times)
        n += x.docs
    want, counts = reading(docs)
    place = np.argsort(run.place)
    got = Counter()
    for _, pairs, _ in run.close():
        found, many, highest = ct.count_pairs([pairs], aligner.b.bits)
        assert (many <= highest).all()
        got.update({(int(place[x >> aligner.b.bits]), int(x & ((1 << aligner.b.bits) - 1))): int(m) for x, m in zip(found, many)})
    assert got == counts
    assert sorted(map(tuple, ct.alignment(df, A, B).collect()), key=str) == want
    assert {(r.a_id, r.b_id): r.n_docs for r in ct.pair_counts(df, A, B).collect()} == counts


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ct.alignment(none, A, B).count() == 0 and ct.pair_counts(none, A, B).count() == 0 and ct.token_groups(none, A, B).count() == 0


def test_token_groups_give_the_text_back(spark, docs):
    aligner = ct.load_aligner(A, B)
    text = {}
    for i, t in docs:
        text.setdefault(i, t)
    whole = 0
    for r in ct.token_groups(spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], SCHEMA), A, B).collect():
        for g in r.groups:
            assert aligner.a.join(g.a) == aligner.b.join(g.b)
        if r.groups:
            assert b"".join(aligner.a.join(g.a) for g in r.groups).decode() == " " + text[r.doc_id]
            whole += 1
    assert whole > 40


def test_long_unaligned_stretch_costs_its_distinct_ids():
    """4 million occurrence pairs of one group become as many rows as it has distinct id pairs."""
    x = ct.Aligned.__new__(ct.Aligned)
    x.of, n = ct.load_aligner(A, B), 2000
    x.a, x.b = np.arange(n) % 5, np.arange(n) % 3
    x.group_a = x.group_b = np.zeros(n, int)
    x.size_a = x.size_b = np.array([n])
    x.doc = np.array([0])
    rows = [(a, b, t) for _, sa, sb, ts in x.links(7) for a, b, t in zip(sa.tolist(), sb.tolist(), ts.tolist())]
    assert len(rows) == 15 and sum(t for *_, t in rows) == n * n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=40), max_size=9))
def test_heap_merge(runs):
    want = Counter()
    arrays = []
    for r in runs:
        own = sorted(dict(r).items())
        want.update(dict(own))
        arrays.append((np.array([k for k, _ in own], np.int64), np.array([v for _, v in own], np.int64)))
    old, ct.BLOCK = ct.BLOCK, 3
    pairs, n = ct.merged(arrays)
    ct.BLOCK = old
    assert dict(zip(pairs.tolist(), n.tolist())) == want and (np.diff(pairs) > 0).all()


# ---- hard negatives


def mined(rows, every=50):
    use = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        use[i] = min(use.get(i, (label, [int(np.floor(256 * float(np.float32(x)))) for x in v])), (label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    out = []
    for a, (label, v) in use.items():
        if a % every:
            continue
        pos = sorted((-dot(v, w), i) for i, (other, w) in use.items() if other == label and i != a)[:5]
        for s, p in pos:
            s = -s
            neg = sorted((-dot(v, w), i) for i, (other, w) in use.items() if other != label and 50 * s <= 100 * dot(v, w) <= 95 * s)[:3]
            out += [(a, p, k + 1, i, s, -n) for k, (n, i) in enumerate(neg)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, score long, row int"


@pytest.mark.parametrize("blocks", [(512, 2048), (3, 17)])
def test_mined_negatives(spark, blocks):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 0.2, (4, 11))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 4] + rng.normal(0, 0.15, 11)], int(rng.integers(0, 3))) for i in range(400)]
    rows += [(400 + i, rows[i % 7][1], i % 3) for i in range(60)]  # ties
    rows += [rows[3], rows[50], (7, None, 1), (501, [0.5, None], 1), (502, [float("nan")] * 11, 1), (503, [float("inf")] * 11, 2), (504, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(550, [], 1), (600, [0.3] * 4, 1), (601, [-3.0] * 13, 2), (650, [0.0] * 11, 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS)
    got = hn.mine(hn.whole_vectors(df), F.col("id") % 50 == 0, anchor_block=blocks[0], candidate_block=blocks[1]).collect()
    assert sorted(map(tuple, got)) == mined(rows) and len(got) > 50


def test_mining_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hn.mine(hn.whole_vectors(none), F.col("id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(50, [0.5], 1, 1, 1)], VECTORS)
    assert hn.mine(hn.whole_vectors(alone), F.col("id") % 50 == 0).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(1, 50), st.integers(1, 700), st.integers(0, 2**32))
def test_tables_score_exactly(dims, width, many, seed):
    rng = np.random.default_rng(seed)
    high = 1 << min(width, 26)
    a, c = rng.integers(-high, high, (5, dims)), rng.integers(-high, high, (many, dims))
    got = hn.scores(hn.subset_sums(a), hn.bit_planes(c, 1 + high.bit_length()))
    assert (got == c @ a.T).all()


# ---- sharding


def test_slots_and_growth(spark, monkeypatch):
    rows = [(i, f"text {i}" * (i % 9), "s", 0, 0) for i in range(500)] + [(None, None, "s", 0, 0), (None, "x", "s", 0, 0), (3, "text 3" * 3, "s", 0, 0), (900, "é😀", "s", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sharding.placed(df, buckets=7).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
        # the law, read plainly
        draw = [int(hashlib.md5(f"{'null' if r.doc_id is None else r.doc_id}:{i}".encode()).hexdigest()[:15], 16) for i in range(17)]
        assert r.shard == int(np.argmax(draw[:16])) and r.grown_shard == int(np.argmax(draw))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    monkeypatch.setattr(sharding, "BROADCAST", 1)
    again = sharding.placed(df.repartition(7), buckets=7).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert sharding.placed(df.limit(0)).count() == 0


def test_copies_are_spread_out(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 10)
    df = spark.range(1000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    assert sorted(r.slot for r in sharding.placed(df).collect()) == list(range(1000))


def test_weights(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    share = {r.shard: r["count"] / 20_000 for r in sharding.assign(df, [1, 2, 5]).groupBy("shard").count().collect()}
    assert abs(share[0] - 0.125) < 0.01 and abs(share[2] - 0.625) < 0.015
    # a heavier shard only takes; a new one only takes
    assert {r.to_shard for r in sharding.moves(df, [1, 2, 5], [1, 3, 5]).select("to_shard").distinct().collect()} == {1}
    grown = sharding.moves(df, [1, 1, 1], [1, 1, 1, 1])
    assert {r.to_shard for r in grown.select("to_shard").distinct().collect()} == {3} and abs(grown.count() / 20_000 - 0.25) < 0.01
    with pytest.raises(ValueError):
        sharding.draws(["doc_id"], [1, 0])


def test_written_shards(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(df, str(tmp_path / "shards"), [1, 1, 2], tasks=3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    want = {r.doc_id: r.shard for r in sharding.assign(df, [1, 1, 2]).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want
