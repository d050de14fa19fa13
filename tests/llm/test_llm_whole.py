"""The whole job where an earlier version did part of it: near copies, walks, lines, tags and rows."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from plazafeed.llm import edit_fingerprint, html_text, queries, simhash


def shingles(t, k=5):
    w = t.lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


# The pipeline's near-duplicate stage


def test_part_masks_cover():
    masks = [int(m) for m in simhash.part_masks(14, 3)]
    assert len(masks) == 93
    r = random.Random(2)
    for _ in range(3000):
        d = sum(1 << k for k in r.sample(range(64), 14))
        assert any(not d & m for m in masks)


def test_wide_pairs_are_all_pairs(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(8)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 11))) for b in base for _ in range(40)})
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.wide_pairs(spark.createDataFrame([(k, f, 1, k) for k, f in enumerate(fps)], "node long, fp long, n long, root long"), 14, 3)
    u = [f & (1 << 64) - 1 for f in fps]
    assert {(x.a, x.b) for x in got.collect()} == {(i, j) for i, j in itertools.combinations(range(len(u)), 2) if (u[i] ^ u[j]).bit_count() <= 14}


def test_stage_finds_near_copies(spark):
    """Copies with a few words changed: groups equal those of Jaccard 0.8 by brute force, however many bits differ."""
    r = random.Random(6)
    texts = []
    for k in range(60):
        w = [f"w{r.randrange(3000)}" for _ in range(150)]
        texts.append(" ".join(w))
        for _ in range(k % 4):
            v = list(w)
            for _ in range(r.randint(1, 4)):
                v[r.randrange(150)] = f"x{r.randrange(3000)}"
            texts.append(" ".join(v))
    sets, fps = [shingles(t) for t in texts], [simhash.fingerprint(t, 5) & (1 << 64) - 1 for t in texts]
    alike = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if jaccard(sets[i], sets[j]) >= 0.8]
    assert {(fps[i] ^ fps[j]).bit_count() <= 5 for i, j in alike} == {True, False}
    root = list(range(len(texts)))
    for i, j in alike:
        a, b = sorted((root[i], root[j]))
        root = [a if x == b else x for x in root]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id for x in corpus_pipeline.simhash_stage(spark, df, "").collect()}
    assert got == set(root) and len(got) < len({simhash.fingerprint(t) for t in texts})


def _hashes(r, n):
    return r.sample(range(1, 100_000), n)


def test_set_pairs_are_all_pairs(spark):
    """Families around shared parts, sizes from 1 up: every pair of similarity 0.8 is a candidate, however frequent its members."""
    r = random.Random(9)
    sets = []
    for size in (1, 2, 4, 5, 9, 10, 11, 40, 200):
        base = _hashes(r, size)
        for _ in range(14):
            keep = r.sample(base, max(1, size - r.randint(0, max(1, size // 5))))
            sets.append(set(keep) | set(_hashes(r, r.randint(0, max(1, size // 8)))))
    rows = [(k, k // 2, sorted(s)) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, root long, s array<long>")
    got = {(x.a, x.b) for x in simhash.set_pairs(df, 0.8).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if i // 2 != j // 2 and jaccard(sets[i], sets[j]) >= 0.8}
    assert want <= got and len(want) > 100
    heads = [(k, k // 2, len(s), sorted(s)[: simhash._head(len(s), 0.8)]) for k, s in enumerate(sets)]
    alike = {x.node for x in simhash._alike(spark.createDataFrame(heads, "node long, root long, n long, head array<long>"), 0.8).collect()}
    assert {k for p in want for k in p} <= alike


def test_crowd_around_a_passage_makes_no_pairs(spark):
    """3000 texts share 85 % of their shingles, which is similarity 0.74: no pair has room, so none is made."""
    base = list(range(170))
    rows = [(k, k, base + [1000 + 30 * k + i for i in range(30)]) for k in range(3000)]
    assert simhash.set_pairs(spark.createDataFrame(rows, "node long, root long, s array<long>"), 0.8).count() == 0


def test_stage_on_empty_and_wordless(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert corpus_pipeline.simhash_stage(spark, spark.createDataFrame([], schema), "").count() == 0
    rows = [(3, None, "en", "s", 0), (2, " \n", "en", "s", 2), (5, "one", "en", "s", 3), (None, "", "en", "s", 0), (6, "one", "en", "s", 3)]
    got = {x.doc_id for x in corpus_pipeline.simhash_stage(spark, spark.createDataFrame(rows, schema), "").collect()}
    assert got == {2, 5}


# 10: banding and verification


def test_banding_recall(spark):
    """20,000 random fingerprints and 300 pairs of likeness 0.8 to 0.92 among them."""
    rng = np.random.Generator(np.random.PCG64(5))
    bits = rng.integers(0, 2, (20_000, 256), np.uint8)
    for k in range(300):
        bits[10_000 + k] = bits[k]
        bits[10_000 + k, rng.permutation(256)[: rng.integers(10, 26)]] ^= 1
    df = spark.createDataFrame([(k, h) for k, h in enumerate(edit_fingerprint._hex(bits))], "node long, fingerprint string")
    got = {tuple(sorted((x.a, x.b))) for x in edit_fingerprint.near_links(df, 0.8).collect()}
    assert got <= {(k, 10_000 + k) for k in range(300)} and len(got) >= 297


@pytest.mark.parametrize("n", [3, 12, 200])
def test_bucket_links_lose_no_connection(n):
    rng = np.random.Generator(np.random.PCG64(n))
    base = rng.integers(0, 2, (4, 256), np.uint8)
    bits = base[rng.integers(0, 4, n)] ^ (rng.random((n, 256)) < 0.06)
    fp = np.packbits(bits.astype(np.uint8), axis=1).view(np.uint64)

    def groups(links):
        root = list(range(n))
        for i, j in links:
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
        return root

    near = [(i, j) for i, j in itertools.combinations(range(n), 2) if (bits[i] != bits[j]).sum() <= 25]
    links = edit_fingerprint.bucket_links(fp, 25).tolist()
    assert {tuple(sorted(x)) for x in links} <= set(near) and groups(links) == groups(near)


def test_op10_has_classes(spark):
    rows = queries.op10_edit_fingerprint(spark, "/root/testdata/sf0.001").collect()
    low = {}
    for r in rows:
        low[r.fingerprint] = min(r.doc_id, low.get(r.fingerprint, r.doc_id))
    assert all(r.class_id <= low[r.fingerprint] for r in rows) and len({r.class_id for r in rows}) > 100


# 10: the walk


@pytest.mark.parametrize("few", [24, 1])
def test_walk_reads_the_whole_text(few, monkeypatch):
    monkeypatch.setattr(edit_fingerprint, "FEW", few)
    moves, _, of_code = edit_fingerprint._tables()
    texts = ["a", "abc" * 50, "слово и дело " * 30, "x" * 3000, *("q" * k for k in range(1, 40))]
    want, longer = [], 0
    for t in texts:
        c, p, out = [*edit_fingerprint.codes(t).tolist(), 0], 0, []
        while len(out) < 2 * len(t) or p < len(t):
            out.append(c[p])
            p += int(moves[(len(out) - 1) % edit_fingerprint.PERIOD][c[p]])
        longer += len(out) > 2 * len(t)
        want.append([int(of_code[k][out[s]]) for k, s in enumerate(edit_fingerprint.sample_steps(len(out)))])
    assert longer >= 3 and edit_fingerprint.walk_bits(texts).tolist() == want


def test_last_characters_touch_the_fingerprint():
    r = random.Random(8)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(400)) for _ in range(200)]
    same = edit_fingerprint.walk_bits(texts) == edit_fingerprint.walk_bits([t[:-12] + "ZYXWVUTSRQPO" for t in texts])
    assert same.all(1).sum() <= 10  # a sample can miss the few last steps


# 4: the pipeline's quality stage


def test_quality_stage_takes_lines_out(spark):
    shared = "This very line of boilerplate stands on every single page of the host today."
    texts = [f"\n{shared}\n \nOnly page {k} says that {' '.join(f'w{k}x{j}' for j in range(30))}." for k in range(15)] + [shared + "\nshort"]
    df = spark.createDataFrame([(k, t, "en", "h", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.quality_stage(spark, df, "").collect()}
    want = {k: t.replace(shared + "\n", "") for k, t in enumerate(texts[:15])}
    assert got == {k: (t, len(t)) for k, t in want.items()}


# 8: stray quotes


@pytest.mark.parametrize("tag", ["<p class=it's>", '<p class="a"">', "<p 'x>", '<p title="a > b">', "<p class=x=\"y>", "<p a='1' b = \"2>3\" c>"])
def test_stray_quotes_lose_no_text(tag):
    assert html_text.Page().render(f"one{tag}two <b>three</b><p>it is</p>") == "one\n\ntwo three\n\nit is"


def test_unclosed_quote_keeps_the_rest():
    assert html_text.Page().render('a<p class="x>b<p>c') == "a\n\nb\n\nc"
