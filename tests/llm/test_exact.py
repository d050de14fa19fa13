"""Operators against brute force, libraries, exact round trips and their SQL twins."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from plazafeed.llm import bpe, edit_fingerprint, html_text, line_dedup, packing, queries, quality, simhash

sys.path.insert(0, str(Path(__file__).parents[1]))
from compare import connect, same  # noqa: E402

SF = "/root/testdata/sf0.001"
BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.toPandas().sort_values("doc_id")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name])


# 1: streaming BPE


ODD = st.text(st.sampled_from("ab 'srevd\n\t  \x85éñ漢字😀12\x1cć!?.=　"), max_size=80)


@settings(max_examples=300, deadline=None)
@given(ODD, st.integers(1, 40))
def test_bpe_pieces(text, chunk):
    model, lib = bpe.load_model(BYTE), Tokenizer.from_file(BYTE)
    ids = bpe.encode_text(model, text, chunk)
    assert ids == lib.encode(text, add_special_tokens=False).ids and bpe.decode_ids(model, ids) == text


@pytest.mark.parametrize("unit", ["a", "=", "the", " ", "\n", "!é", "1", "ab'", "x y", "漢"])
def test_bpe_long_runs(unit):
    model, lib = bpe.load_model(BYTE), Tokenizer.from_file(BYTE)
    text = "q" + unit * 9000 + " z<|endoftext|>" + unit
    want = lib.encode(text, add_special_tokens=False).ids
    assert bpe.encode_text(model, text) == want == bpe.encode_text(model, text, 1013)


def test_bpe_lookahead_holds_memory_down():
    model = bpe.load_model(BYTE)
    enc, held = bpe.StreamEncoder(model), 0
    for _ in range(400):
        list(enc.feed("a" * 1000))
        held = max(held, len(enc.tail) + (len(enc.run[1].held) if enc.run else 0))
    assert model.lookahead < 1000 and held < 3 * model.lookahead + 6000


def test_bpe_query(spark, rows):
    lib = Tokenizer.from_file(BYTE)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_bpe(spark, SF).collect()}
    for i, t in zip(rows.doc_id, rows.text):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())


# 2: packing


def check_packed(got, texts):
    lib = Tokenizer.from_file(WORDS)
    ids = {i: lib.encode(t, add_special_tokens=False).ids + [1] for i, t in texts}
    for r in got.itertuples():
        cut = ids[r.doc_id][r.start : r.start + r.length]
        assert len(cut) == r.length and r.start == 4096 * r.piece and zlib.crc32(np.array(cut, "<u4").tobytes()) == r.ids_crc32
    assert got.length.sum() == sum(map(len, ids.values())) and not got.duplicated(["doc_id", "piece"]).any()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 4096
    least = -(-got.length.sum() // 4096)
    assert got.sequence_id.nunique() <= 1.02 * least + 1


def test_packing_query(spark, rows):
    check_packed(queries.op2_packing(spark, SF).toPandas(), list(zip(rows.doc_id, rows.text)))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1), st.sampled_from(["norm", "dot"]), st.integers(1, 9))
def test_plan_keeps_every_capacity(counts, score, max_docs):
    cost = 3000 if max(counts) ** 2 <= 3000 else 64 * 64
    bins: dict[int, list[tuple[int, int]]] = {}
    seen: dict[int, int] = {}
    p = packing.plan(counts, 64, max_docs, cost, score=score)
    ends = {}
    for length, first, seq, each, at in p.tolist():
        nxt = [q for q in p.tolist() if q[0] == length and q[1] > first]
        n = (min(q[1] for q in nxt) if nxt else counts[length]) - first
        ends[length] = first + n
        for k in range(n):
            bins.setdefault(seq + k // each, []).append((at + k % each * length, length))
        seen[length] = seen.get(length, 0) + n
    assert seen == counts
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *itertools.accumulate(n for _, n in b)][:-1]
        assert sum(n for _, n in b) <= 64 and len(b) <= max_docs and sum(n * n for _, n in b) <= cost


def test_word_encoder_is_the_tokenizer():
    enc, lib, r = packing.load_encoder(WORDS), Tokenizer.from_file(WORDS), random.Random(5)
    for _ in range(1500):
        t = "".join(r.choice("ab 'SÉdéñΣσİ漢 \x1c\t!１²Ⅷ́\xa0") for _ in range(r.randint(0, 40))) + r.choice(["", "<|endoftext|>", "Σ ΑΣ"])
        assert np.frombuffer(next(enc.encode_all([t])), "u4").tolist() == lib.encode(t, add_special_tokens=False).ids


# 4: a line that a whole host shares goes, a copied text does not


def test_quality_lines(spark):
    shared = "This very line of boilerplate stands on every single page of the host today."
    body = [f"{shared}\nOnly page {k} says that {' '.join(f'w{k}x{j}' for j in range(30))}." for k in range(15)]
    body += [shared + f"\nshort {k}" for k in range(3)]
    copies = ["Copies of this one long notice are found under many different numbers in the corpus."] * 40
    df = spark.createDataFrame([(k, t, "h") for k, t in enumerate(body)] + [(100 + k, t, "c") for k, t in enumerate(copies)], "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.assess(df).collect()}
    assert all(kept[k] for k in range(15)) and not any(kept[k] for k in range(15, 18)) and all(kept[100 + k] for k in range(40))
    assert all(shared not in r.text for r in quality.remove_lines(df).where("source = 'h'").collect())


# 7: covering LSH


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {f: find(f) for f in fps}


def plain_shingles(t, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
    return [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])


def plain_fingerprint(t, size=3):
    sh = plain_shingles(t, size)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_masks_cover():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for i, j in itertools.combinations(range(64), 2):
        assert any(not (m >> i & 1) and not (m >> j & 1) for m in masks)


@pytest.mark.parametrize("pairwise", [16, 1])
def test_simhash_query(spark, rows, pairwise, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    fps = {i: plain_fingerprint(t) for i, t in zip(rows.doc_id, rows.text)}
    root, low = brute_components(sorted({*fps.values()})), {}
    for i, f in fps.items():
        low[root[f]] = min(i, low.get(root[f], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", low[root[f]]) for i, f in fps.items()}


def test_near_pairs_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", 2)
    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(6)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(63), r.randint(0, 4))) for b in base for _ in range(30)})
    links = [(x.a, x.b) for x in simhash.near_pairs(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    from plazafeed.llm.common import components

    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {f: got.get(f, f) for f in fps} == brute_components(fps)


# 8: layout


def test_html_layout():
    html = """<html><head><title>x</title></head><body><h1>Hi &amp; all</h1>a<b>b</b> c
 d<p>one<p>two<div hidden>no</div><div style="display: none">no<p>no</div><ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>
<table><tr><th>Name<th>Qty<tr><td>apple pie<td>2<tr><td colspan=2>wide</table>end<br>line<pre> k
   j</pre><p>z<script>bad</script></p></b></i> tail <a href="x">lnk</a>!<img alt="pic"><textarea>&lt;t</textarea>"""
    want = "Hi & all\n\nab c d\n\none\n\ntwo\n\n- a\n- b\n  3. x\n  4. y\n\nName       Qty\napple pie  2\nwide\n\nend\nline\n\n k\n   j\n\nz\n\ntail lnk!pic<t"
    assert html_text.Page().render(html) == want


def test_html_query(spark):
    got = queries.op8_html(spark, SF).collect()
    src = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(src)
    for r in got:
        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<script.*?</script>", "", src[r.page_id])
        from html import unescape

        plain = unescape(re.sub(r"<[^>]+>", " ", body)).split()
        assert re.sub(r"\s|^- ", "", r.text.replace("\n- ", "\n").removeprefix("- ")) == "".join(plain)


# 9: set-similarity join


def brute_lines(texts):
    lines = [(i, k, frozenset(re.findall(r"[^\x20\x09-\x0D]+", x.lower()))) for i, t in texts for k, x in enumerate(t.split("\n"))]
    gone, first, reps = {}, set(), []
    for i, k, s in lines:
        if not s:
            continue
        if s in first or any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in reps if 0.8 * len(s) <= len(o) <= len(s) / 0.8):
            gone.setdefault(i, []).append(k)
        if s not in first:
            first.add(s)
            reps.append(s)
    return gone


@pytest.mark.parametrize("slice_", [4096, 3])
def test_lines(spark, docs, rows, slice_, monkeypatch):
    monkeypatch.setattr(line_dedup, "SLICE", slice_)
    got = {r.doc_id: list(r.gone) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == brute_lines(list(zip(rows.doc_id, rows.text)))


def test_lines_near_and_crowded(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SLICE", 5)
    r = random.Random(7)
    words = [f"w{k}" for k in range(14)]
    texts = []
    for i in range(150):
        base = words[: r.randint(4, 14)] if i % 2 else r.sample(words, r.randint(1, 12))
        texts.append((i, "\n".join(" ".join(w if r.random() > 0.1 else r.choice(words) for w in base) for _ in range(3))))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {x.doc_id: list(x.gone) for x in line_dedup.repeated_lines(df).collect()} == brute_lines(texts)


# 10: edit embedding


def test_edit_query(spark, rows):
    got = {r.doc_id: r for r in queries.op10_edit_fingerprint(spark, SF).collect()}
    desc = list(rows.sort_values("doc_id", ascending=False)[["doc_id", "text"]].itertuples(index=False))
    for k, (i, t) in enumerate(desc):
        nxt, r = desc[(k + 1) % len(desc)], got[i]
        e = t[: len(t) - len(t) // 2] + nxt[1][: len(t) // 2]
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and r.n_chars == len(t)
        bits = edit_fingerprint.walk_bits([t, e, nxt[1]])
        assert r.fingerprint == edit_fingerprint._hex(bits)[0] and r.edited_fingerprint == edit_fingerprint._hex(bits)[1]
        if nxt[1] and t:
            assert r.near_next == pytest.approx(edit_fingerprint.likeness(bits[:1], bits[2:])[0])
    near, apart = [[getattr(r, c) for r in got.values() if r.n_chars > 200] for c in ("near_edited", "near_next")]
    assert np.mean(near) > 0.4 and np.mean(apart) < 0.25


def test_walk_is_the_walk():
    moves, _, of_code = edit_fingerprint._tables()
    for t in ["a", "abc" * 50, "слово и дело " * 30, "x" * 3000]:
        c, p, out = [*edit_fingerprint.codes(t).tolist(), 0], 0, []
        while len(out) < 2 * len(t) or p < len(t):  # on past 2n steps until the whole text is read
            out.append(c[p])
            p += int(moves[(len(out) - 1) % edit_fingerprint.PERIOD][c[p]])
        pick = edit_fingerprint.sample_steps(len(out))
        assert edit_fingerprint.walk_bits([t])[0].tolist() == [int(of_code[k][out[s]]) for k, s in enumerate(pick)]


def test_edit_groups(spark):
    r = random.Random(11)
    base = ["".join(r.choice("abcdefgh ijklmnop") for _ in range(1500)) for _ in range(20)]
    near = [b[:400] + "zz" + b[401:1000] + b[1003:] for b in base]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(base + near)], "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in edit_fingerprint.near_groups(df, 0.6).collect()}
    assert sum(got[k] == got[20 + k] for k in range(20)) >= 18 and len({got[k] for k in range(20)}) == 20


# The pipeline


def test_pipeline(spark, rows):
    """The stages by brute force: documents rejected, lines that a host's texts share, repeated lines, near copies, packing."""
    con = connect(SF)
    kept = {x[0] for x in con.execute(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op4_quality']}) WHERE kept").fetchall()}
    source = dict(zip(rows.doc_id, con.execute(f"SELECT source FROM '{SF}/documents.parquet' ORDER BY doc_id").df().source)) if rows.doc_id.is_monotonic_increasing else None
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    of_host, of_line = {}, {}
    for i, t in zip(rows.doc_id, rows.text):
        of_host.setdefault(source[i], set()).add(t)
        for x in t.split("\n"):
            if norm(x):
                of_line.setdefault((source[i], norm(x)), set()).add(t)
    hot = {k for k, v in of_line.items() if len(v) > 10 and len(v) > 0.1 * len(of_host[k[0]])}
    texts = [(i, "\n".join(x for x in t.split("\n") if (source[i], norm(x)) not in hot)) for i, t in zip(rows.doc_id, rows.text) if i in kept]
    gone = brute_lines(texts)
    texts = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, []))) for i, t in texts]
    sets, fps, root = [{*plain_shingles(t, 5)} for _, t in texts], [plain_fingerprint(t, 5) for _, t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        same = (fps[a] ^ fps[b]).bit_count() <= 14 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
        if same and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if x == high else x for x in root]
    left = [texts[k] for k in range(len(texts)) if root[k] == k]
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.doc_id) == {i for i, _ in left}
    check_packed(got, left)
