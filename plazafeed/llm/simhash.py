"""SimHash fingerprints linked by covering locality-sensitive hashing.

For radius r each bit gets a nonzero vector of GF(2)^(r+1). A mask exists for every nonzero
vector v: the bits whose vectors are not orthogonal to v. Any r bits span at most r of the
r+1 dimensions, so some v is orthogonal to all of them and its mask ignores them: every pair
within the radius agrees under at least one of the 2^(r+1) - 1 masks. For a wide radius the
bits are split into parts: of a pair within r bits some part has at most r/parts changes
(pigeonhole), so covering every part at that smaller radius covers the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, slices, stage, text_or_empty
from .quality import _only_if_small

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Shingles hashed at a time: a long text's memory does not grow beyond it.
BLOCK = 1 << 15
#: Hashes of sets that are sent together.
HELD = 1 << 20
#: Members of a bucket that are compared pair by pair; larger ones go through shared neighbours.
PAIRWISE = 16


def words_of(text: str) -> list[bytes]:
    return [w.encode("utf-8", "replace") for w in WORD.findall(text.translate(LOWER) if not text.isascii() else text.lower())]


def shingle_hashes(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """The hashes of the word shingles in order, BLOCK at a time; fewer words than a shingle has are one."""
    if not words:
        return
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    firsts, lasts = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        yield np.array([digest(line[a:b], 42) for a, b in zip(firsts[at : at + BLOCK], lasts[at : at + BLOCK])], ">u8")


def majority(blocks: Iterable[np.ndarray]) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 bits: 1 where more than half the hashes of the word shingles have a 1; no words: 0."""
    return majority(shingle_hashes(words_of(text), shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row; fp is the fingerprint as a signed long. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The masks, as signed longs; bit i has vector 1 + i mod (2^(radius+1) - 1)."""
    size = (1 << (radius + 1)) - 1
    vectors = [1 + i % size for i in range(bits)]
    masks = [sum(1 << i for i, u in enumerate(vectors) if (u & v).bit_count() % 2) for v in range(1, size + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_pairs(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``(a, b)`` between distinct longs ``fp`` at most ``radius`` (0 or 2) bits apart; a group of near ones may come as stars.

    Each fingerprint goes to one bucket a mask. In buckets of up to PAIRWISE members all
    pairs are compared. In a larger one every member goes to itself and to each one-bit
    change outside the mask: two members at most two bits apart meet in such a place, and
    members that meet are at most two bits apart, so each is linked to the smallest there.
    No pair is lost, and the number of rows is linear in the members.
    """
    if radius not in (0, 2):
        raise ValueError("radius must be 0 or 2")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.lit(m).alias("mask")) for k, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(tables).alias("m")).select("fp", "m.t", "m.mask", F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("one")).where("n > 1")
    full = keyed.join(sizes.drop("one"), ["t", "key"])
    full = stage(full, "simhash-buckets")
    small = full.where(F.col("n") <= PAIRWISE)
    pairs = (
        small.groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("g"))
        .select(F.explode(F.flatten(F.transform("g", lambda x, i: F.transform(F.slice(F.col("g"), i + 2, F.size("g")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
        .select("p.a", "p.b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    )
    if radius == 0:
        return pairs
    bits = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)])
    reach = full.where(F.col("n") > PAIRWISE).select("fp", "t", F.explode(F.filter(bits, lambda b: b.bitwiseAND(F.col("mask")) == 0)).alias("bit"))
    met = reach.select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("at"))
    low = met.groupBy("at").agg(F.min("fp").alias("a"), F.count_distinct("fp").alias("n")).where("n > 1").drop("n")
    return pairs.union(met.join(low, "at").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b")))


def hex64(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row per row of ``docs``.

    component_id is the smallest doc_id that links reach, its own included; null ids count
    as none (null if the group has no other). Rows with equal fingerprints form one class
    before anything is compared. Empty and null texts have fingerprint zero and link like
    any other. Only doc_id and text are read; an empty table gives an empty table.
    """
    fps = stage(fingerprints(docs, shingle), "simhash")
    classes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "simhash-classes")
    roots = components(near_pairs(classes.select("fp"), radius))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low", "n")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("m")).where("m > 1").drop("m")
    labels = named.join(lows, "root").select("fp", "component_id")
    out = fps.join(labels, "fp", "left")
    return out.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their group: one document of each stays.

    A row without doc_id stays only if its whole group has none.
    """
    kept = near_groups(docs, shingle, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept_id")), "left_semi")


def part_masks(radius: int, parts: int) -> np.ndarray:
    """Masks that cover ``radius`` in 64 bits, part by part; ``parts=1`` gives ``covering_masks``."""
    cuts = [64 * k // parts for k in range(parts + 1)]
    return np.array([(m & (1 << 64) - 1) << lo for lo, hi in zip(cuts, cuts[1:]) for m in covering_masks(radius // parts, hi - lo)], np.uint64)


def _bucket_of(t: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One long for a table and a masked fingerprint; two buckets that collide only add comparisons."""
    with np.errstate(over="ignore"):  # a scalar that wraps around warns, an array does not
        x = (key + t * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def wide_pairs(classes: DataFrame, radius: int, parts: int, least: float = 0.0) -> DataFrame:
    """All pairs ``(a, b)`` of ``classes(node, fp, n, root)`` within ``radius`` bits whose roots differ.

    Each fingerprint goes to one bucket a mask; buckets are compared pair by pair and a pair
    comes from the first mask under which it agrees. Pairs whose sizes ``n`` have a ratio
    below ``least`` go. Comparisons grow with the square of a bucket, rows out do not.
    """
    masks = part_masks(radius, parts)
    tables = np.arange(len(masks), dtype=np.uint64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(1).to_numpy().view(np.uint64)
            for t, m in zip(tables, masks):
                yield pa.RecordBatch.from_arrays([pa.array(_bucket_of(t, fp & m)), *b.columns], names=["h", "node", "fp", "n", "root"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            now = [c.to_numpy() for c in b.columns]
            cols = now if held is None else [np.concatenate(p) for p in zip(held, now)]
            edges = np.concatenate(([0], np.flatnonzero(np.diff(cols[0])) + 1))
            held = [c[edges[-1] :] for c in cols]
            yield from found(cols, edges)
        if held is not None:
            yield from found(held, np.array([0, len(held[0])]))

    def found(cols: list[np.ndarray], edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, node, fp, n, root = cols
        fp = fp.view(np.uint64)
        for k in np.flatnonzero(np.diff(edges) > 1).tolist():
            hi = int(edges[k + 1])
            for lo in range(int(edges[k]), hi, 512):
                end = min(lo + 512, hi)
                i, j = np.nonzero(np.bitwise_count(fp[lo:end, None] ^ fp[None, lo:hi]) <= radius)
                i, j = i[i < j] + lo, j[i < j] + lo
                ok = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9)
                for at in range(0, len(i), BLOCK):
                    x, y = i[at : at + BLOCK][ok[at : at + BLOCK]], j[at : at + BLOCK][ok[at : at + BLOCK]]
                    if len(x):
                        first = ((fp[x] ^ fp[y])[:, None] & masks[None, :] == 0).argmax(1)
                        here = _bucket_of(tables[first], fp[x] & masks[first]) == h[x]
                        x, y = node[x[here]], node[y[here]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    rows = "node long, fp long, n long, root long"
    dealt = classes.select("node", "fp", "n", "root").mapInArrow(spread, f"h long, {rows}").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


#: Smallest hashes that lead near copies to one another before buckets are compared.
LEADS = 4


def _required(n: Column, similarity: float) -> Column:
    """Shingles that a set of ``n`` has in common with any set of that similarity, at least."""
    return F.ceil(n * F.lit(similarity) - 1e-9)


def _head(n: int, similarity: float) -> int:
    """Smallest hashes of a set of ``n`` that are looked up among all sets: see ``_alike``."""
    return n - ceil(similarity * n - 1e-9) + _spare(n) if n else 0


def _spare(n: int) -> int:
    return max(1, n // 20)


def sketches(docs: DataFrame, shingle: int, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, key, node, fp, n, leads, head)`` for every row.

    node names the sequence of words, key the text; n counts distinct shingles; leads are
    minima by which near copies often agree, head the smallest hashes of the set, in order.
    A null text is empty: it has no shingles, and so no leads and no head.
    """
    salts = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, LEADS, np.uint64) * np.uint64(2) + np.uint64(1)
    names = ["doc_id", "key", "node", "fp", "n", "leads", "head"]
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            node, fp, n, leads, head = [], [], [], [], []
            for t in b.column(2).to_pylist():
                words = words_of(t)
                blocks = list(shingle_hashes(words, shingle))
                h = np.unique(np.concatenate(blocks).astype(np.uint64)) if blocks else np.zeros(0, np.uint64)
                node.append(_word_key(words))
                fp.append(majority(blocks))
                n.append(len(h))
                leads.append([int((h * s).min().view(np.int64)) for s in salts] if len(h) else [])
                head.append(h[: _head(len(h), similarity)].view(np.int64))
            cols = [b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in (node, fp, n)), pa.array(leads, longs), pa.array(head, longs)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    src = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("key"), text_or_empty().alias("text"))
    return src.mapInArrow(run, "doc_id long, key long, node long, fp long, n long, leads array<long>, head array<long>")


def _word_key(words: list[bytes]) -> int:
    return int.from_bytes(xxhash.xxh64_digest(b" ".join(words), 1), "big", signed=True)


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Staged ``(node, s)``: the hashes of the distinct shingles of the classes in ``nodes``, from the texts."""
    keys = stage(classes.select("node", "key").join(nodes, "node", "left_semi").select("key"), "simhash-used")
    texts = docs.select(F.xxhash64(text_or_empty()).alias("key"), text_or_empty().alias("text")).join(_only_if_small(keys), "key", "left_semi")

    def out(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sets, size = [], [], 0
            for t in b.column(0).to_pylist():  # one text's words at a time, and batches of bounded size
                words = words_of(t)
                sets.append(np.unique(np.concatenate([*shingle_hashes(words, shingle), np.zeros(0, ">u8")]).astype(np.uint64)).view(np.int64))
                keys.append(_word_key(words))
                size += len(sets[-1])
                if size > HELD:
                    yield out(keys, sets)
                    keys, sets, size = [], [], 0
            yield out(keys, sets)

    return stage(texts.groupBy("key").agg(F.first("text").alias("text")).select("text").mapInArrow(run, "node long, s array<long>"), "simhash-sets")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` of nodes whose sets of shingles have a Jaccard similarity of ``similarity`` at least."""
    j = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return j.where((1 + similarity) * both >= similarity * (F.size("x") + F.size("y")) - 1e-9).select("a", "b")


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def _alike(named: DataFrame, similarity: float) -> DataFrame:
    """``(node)`` of the rows of ``named(node, root, n, head)`` that may be similar to one of another root; no other can be.

    Two similar sets have ``similarity * n`` shingles in common, for the larger n. So of
    their common shingles the l smallest lie among the first n - similarity * n + l of
    each: the heads of both hold the same l, where l is the spare of the smaller set, whose
    size is at least ``similarity * n``. A node with fewer shingles in heads of other roots is out.
    """
    t = named.select("node", "root", "n", F.explode("head").alias("h"))
    shared = t.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("h")
    spare = F.greatest(F.lit(1), F.floor(_required(F.col("n"), similarity) / 20))
    return t.join(shared, "h").groupBy("node", "n").agg(F.count("*").alias("m")).where(F.col("m") >= spare).select("node")


def set_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Candidates ``(a, b)`` among ``sets(node, root, s)``: every pair of that similarity whose roots differ, and few others.

    Prefix filter: shingles are ordered by the number of sets that hold them (those of one
    root only come first, and meet nothing), then by hash. Two similar sets have their first
    common shingle among the first n - similarity * n + 1 of each; sizes and the places of
    that shingle must leave room for the rest. Sets without shingles meet nothing.
    """
    all_ = sets.select("node", "root", F.size("s").alias("n"), F.explode("s").alias("h"))
    counts = all_.groupBy("h").agg(F.count("*").alias("f"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("h", "f")
    of_node = Window.partitionBy("node")
    ranked = all_.join(counts, "h").select("node", "root", "n", "h", F.row_number().over(of_node.orderBy("f", "h")).alias("r"), F.count("*").over(of_node).alias("m"))
    k = ranked.select("node", "root", "n", "h", (F.col("n") - F.col("m") + F.col("r") - 1).alias("at")).where(F.col("at") <= F.col("n") - _required(F.col("n"), similarity))
    k = stage(k, "simhash-prefixes")
    x, y = (k.select("h", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "n", "at")]) for side in "ab")
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) * (1 + similarity) >= similarity * (F.col("n_a") + F.col("n_b")) - 1e-9
    met = x.join(y, "h").where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & room)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def similar_links(docs: DataFrame, shingle: int, radius: int, parts: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``classes(node, low, ...)`` of equal word sequences, and links that connect all those that are similar.

    Classes with an equal smallest hash are first verified against the smallest class of
    that hash: a crowd of near copies is joined by as many links as it has members. Then
    pairs within ``radius`` bits that this has not joined are found by covering masks, and
    verified. Similar texts that differ in more bits come from an exact set join, over the
    texts that can have a partner outside their group at all.
    """
    rows = stage(sketches(docs, shingle, similarity), "simhash-sketches")
    first = {c: F.min(c).alias(c) for c in ("key", "fp", "n", "leads", "head")}
    classes = stage(rows.groupBy("node").agg(_least(F.struct("doc_id", "key"), "doc_id").alias("low"), *first.values()), "simhash-classes")
    leads = classes.select("node", "fp", "n", F.posexplode("leads").alias("k", "lead"))
    least = leads.groupBy("k", "lead").agg(F.min(F.struct("node", "fp", "n")).alias("o"), F.count("*").alias("m")).where("m > 1")
    close = F.least("n", "o.n") >= similarity * F.greatest("n", "o.n") - 1e-9
    stars = leads.join(least, ["k", "lead"]).where((F.col("node") != F.col("o.node")) & close).select(F.col("o.node").alias("a"), F.col("node").alias("b")).distinct()

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        pairs = stage(pairs, f"simhash-{name}")
        return stage(_verified(pairs, _sets(_nodes_of(pairs), classes, docs, shingle), similarity), "simhash-links")

    def grouped(links: DataFrame, *columns: str) -> DataFrame:
        return classes.join(components(links), "node", "left").select("node", *columns, F.coalesce("root", "node").alias("root")).where("n > 0")

    links = confirmed(stars, "stars")
    links = links.union(confirmed(wide_pairs(grouped(links, "fp", "n"), radius, parts, similarity), "pairs"))
    rest = stage(_alike(stage(grouped(links, "n", "head"), "simhash-heads"), similarity), "simhash-alike")
    sets = _sets(rest, classes, docs, shingle)
    roots = components(links)
    of_root = sets.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "s")
    return classes, links.union(stage(_verified(stage(set_pairs(of_root, similarity), "simhash-rest"), sets, similarity), "simhash-links"))


def keep_one_similar(docs: DataFrame, shingle: int = 5, radius: int = 5, parts: int = 1, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose doc_id (of equal ones, whose text's hash) is the smallest of their group: one document of each stays.

    Rows of one id and different texts are different documents; a row that came twice is one, and comes twice. Groups connect texts with equal words, and texts whose
    sets of word shingles have a Jaccard similarity of ``similarity`` or more; no such pair
    is lost. ``radius`` and ``parts`` say which of them the fingerprints find, not which
    are found. Texts without words are one group. A row without doc_id stays only if its
    whole group has none.
    """
    classes, links = similar_links(docs, shingle, radius, parts, similarity)
    named = classes.join(components(links), "node", "left")
    kept = named.groupBy(F.coalesce("root", "node")).agg(_least(F.col("low"), "low.doc_id").alias("low")).select(F.col("low.doc_id").alias("__kept_id"), F.col("low.key").alias("__kept_key")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__kept_id")) & (F.xxhash64(text_or_empty()) == F.col("__kept_key")), "left_semi")


def _least(row: Column, doc_id: str) -> Column:
    """The least row with an id, else the least without."""
    return F.coalesce(F.min(F.when(F.col(doc_id).isNotNull(), row)), F.min(row))
