"""Fingerprints from a randomised edit embedding.

All texts share one random bit for each step and character. A pointer walks over a text: a
step emits the character under the pointer, and that character's bit says whether the
pointer moves on. Two texts that differ by few edits fall into the same places again soon
after each edit, so the edit distance turns into a Hamming distance between the emitted
strings. A walk takes 2n steps for n characters, and goes on until the pointer has passed the
last one. The fingerprint is one hashed bit at each of 256 shared random steps of the whole
walk, chosen by lowest priority, so walks of nearly equal length look at nearly the same ones.
No bound on steps is set: within 8192 steps every character moves on about 4096 times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranges
from .common import components, n_partitions, stage, text_or_empty
from .simhash import _bucket_of as bucket_of

BITS, SEED, PERIOD = 256, 20240131, 1 << 13
#: Below so many walks a plain loop beats array steps; characters walked at a time (a longer text goes alone).
FEW, BLOCK = 24, 6_000_000
#: Characters of a range of documents.
RANGE = 4_000_000
#: Members of a bucket that are compared pair by pair at once; in a larger one so many leaders come first.
PAIRWISE, LEADERS = 16, 16
#: The chance that banding misses a pair of just the likeness asked for.
MISS = 1e-3
END = 0


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Moves by step and code, the same as bytes, and the fingerprint's bit by sample and code. Code 0 is the text's end."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    moves = rng.integers(0, 2, (PERIOD, 256), np.uint8)
    moves[:, END] = 0
    return moves, [m.tobytes() for m in moves], rng.integers(0, 2, (BITS, 256), np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_records: list[tuple[np.ndarray, np.ndarray]] = []
_reached = [0, np.full(BITS, np.iinfo(np.uint64).max, np.uint64)]


def sample_steps(steps: int) -> np.ndarray:
    """For each sample the step below ``steps`` with the lowest priority (``steps`` at least 1)."""
    while _reached[0] < steps:
        at, size = _reached[0], 1 << 14
        j = np.arange(at, at + size, dtype=np.uint64)
        rank = _mix(j[None, :] * np.uint64(BITS) + np.arange(BITS, dtype=np.uint64)[:, None] + np.uint64(SEED))
        low = np.minimum.accumulate(rank, 1)
        fresh = (low < np.concatenate((_reached[1][:, None], low[:, :-1]), 1)) & (low < _reached[1][:, None])
        who, when = np.nonzero(fresh)
        _records.append((who, when + at))
        _reached[0], _reached[1] = at + size, np.minimum(_reached[1], low[:, -1])
    out = np.zeros(BITS, np.int64)
    for who, when in _records:
        if len(when) and when.min() < steps:
            keep = when < steps
            np.maximum.at(out, who[keep], when[keep])
    return out


def codes(text: str) -> np.ndarray:
    """A code from 1 to 255 for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (1 + (points * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(255)).astype(np.uint8)


def walk_bits(texts: list[str]) -> np.ndarray:
    """The fingerprint bits of the texts, one row each; all zero for an empty text."""
    moves, flat_moves, of_code = _tables()
    size = np.array([len(t) for t in texts])
    order = np.argsort(-size, kind="stable")
    out = np.zeros((len(texts), BITS), np.uint8)
    order = order[size[order] > 0]
    if not len(order):
        return out
    size = size[order]
    data = np.concatenate([x for i in order.tolist() for x in (codes(texts[i]), np.zeros(1, np.uint8))])
    start = np.cumsum(size + 1) - size - 1
    steps = 2 * size
    few = int(steps[FEW]) if len(size) > FEW else 0  # steps that are worth taking together
    live = len(size) - np.searchsorted(steps[::-1], np.arange(few), "right")
    at = np.concatenate(([0], np.cumsum(live)))
    emitted, place = np.empty(at[-1], np.uint8), start.copy()
    for j, n in enumerate(live.tolist()):
        c = data[place[:n]]
        emitted[at[j] : at[j] + n] = c
        place[:n] += moves[j % PERIOD][c]
    samples = np.arange(BITS)
    known: dict[int, np.ndarray] = {}
    for row, i in enumerate(order.tolist()):
        together = min(int(steps[row]), few)
        trail = _tail(data, int(start[row]), int(place[row]), together, int(steps[row]), int(size[row]), flat_moves)
        n = together + len(trail)
        if (pick := known.get(n)) is None:
            known[n] = pick = sample_steps(n)
        seen = np.empty(BITS, np.uint8)
        early = pick < together
        seen[early] = emitted[at[pick[early]] + row]
        seen[~early] = trail[pick[~early] - together]
        out[i] = of_code[samples, seen]
    return out


def _tail(data: np.ndarray, start: int, place: int, step: int, steps: int, size: int, moves: list[bytes]) -> np.ndarray:
    """The characters that one walk emits from ``step`` on, up to ``steps`` and until its pointer has passed the text."""
    p, trail = place - start, bytearray()
    if step >= steps and p >= size:
        return np.zeros(0, np.uint8)
    text = data[start : start + size + 1].tobytes()
    put = trail.append
    base = step % PERIOD
    while step < steps:
        for m in moves[base : base + steps - step]:
            c = text[p]
            put(c)
            p += m[c]
        step, base = step + min(PERIOD - base, steps - step), 0
    while p < size:
        c = text[p]
        put(c)
        p += moves[step % PERIOD][c]
        step += 1
    return np.frombuffer(trail, np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 from the share of equal bits, half of which chance makes equal."""
    return np.clip(2 * (a == b).mean(1) - 1, 0, 1)


def _hex(bits: np.ndarray) -> list[str]:
    raw = np.packbits(bits, axis=1)
    return [r.tobytes().hex() for r in raw]


def _blocks(rows: Iterator[tuple], chars) -> Iterator[list[tuple]]:
    block, n = [], 0
    for r in rows:
        block.append(r)
        n += chars(r)
        if n >= BLOCK:
            yield block
            block, n = [], 0
    if block:
        yield block


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, bits)`` for every row: 64 hex digits and the same as 32 bytes. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for block in _blocks(rows, lambda r: len(r[1])):
            bits = walk_bits([t for _, t in block])
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in block], pa.int64()), pa.array(_hex(bits), pa.string()), pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())], names=["doc_id", "fingerprint", "bits"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fingerprint string, bits binary")


def banding(n: int, apart: float, rows: int | None = None, bands: int | None = None) -> np.ndarray:
    """The bits that each band samples: enough bits for ``n`` classes to have a bucket each, and enough bands that a
    pair with a share ``apart`` of its bits unequal has a common bucket but once in MISS."""
    rows = rows or min(48, max(8, int(np.ceil(np.log2(max(n, 2))))))
    bands = bands or int(np.ceil(np.log(MISS) / np.log1p(-((1 - apart) ** rows)))) if apart else bands or 1
    rng = np.random.Generator(np.random.PCG64(SEED + 1))
    return np.array([rng.permutation(BITS)[:rows] for _ in range(bands)])


def bucket_links(fp: np.ndarray, most: int) -> np.ndarray:
    """Pairs of rows of one bucket at most ``most`` bits apart that connect whatever all such pairs connect.

    First some leaders take the rows near them; then every row outside the largest such
    group is compared with all, and each two groups that meet are linked once.
    """
    n = len(fp)
    group, left, links = np.arange(n), np.arange(n), []
    for _ in range(LEADERS if n > PAIRWISE else 0):
        if len(left) < 2:
            break
        near = left[1:][np.bitwise_count(fp[left[1:]] ^ fp[left[0]]).sum(1, dtype=np.int64) <= most]
        group[near] = left[0]
        links.append(np.stack((np.full(len(near), left[0]), near), 1))
        left = left[1:][group[left[1:]] == left[1:]]
    rest = np.flatnonzero(group != np.bincount(group).argmax())
    step = max(1, (1 << 20) // n)
    for at in range(0, len(rest), step):
        some = rest[at : at + step]
        apart = sum(np.bitwise_count(fp[some, None, w] ^ fp[None, :, w]).astype(np.int16) for w in range(fp.shape[1]))
        i, j = np.nonzero((apart <= most) & (group[some][:, None] != group[None, :]))
        if len(i):
            x = np.sort(np.stack((some[i], j), 1), 1)
            g = np.sort(group[x], 1)
            links.append(x[np.unique(g[:, 0] * n + g[:, 1], return_index=True)[1]])
    return np.concatenate(links) if links else np.zeros((0, 2), np.int64)


def near_links(classes: DataFrame, min_likeness: float, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """Links ``(a, b)`` between ``classes(node, fingerprint)`` whose fingerprints have a likeness of ``min_likeness``; a crowd may come as stars."""
    most = int(np.floor((1 - min_likeness) * BITS / 2 + 1e-9))
    samples = banding(classes.count(), most / BITS, rows, bands)
    names = ["h", "node", *[f"f{w}" for w in range(BITS // 64)]]
    schema = ", ".join(f"{c} long" for c in names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.frombuffer(bytes.fromhex("".join(b.column(1).to_pylist())), np.uint8).reshape(-1, BITS // 8)
            bits, words = np.unpackbits(raw, axis=1), [pa.array(w) for w in np.ascontiguousarray(raw).view(np.int64).T.copy()]
            for t, pick in enumerate(samples):
                key = bits[:, pick].astype(np.uint64) @ (np.uint64(1) << np.arange(len(pick), dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(bucket_of(np.uint64(t), key)), b.column(0), *words], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            now = np.stack([c.to_numpy() for c in b.columns], 1)
            held = now if held is None else np.concatenate((held, now))
            edges = np.concatenate(([0], np.flatnonzero(np.diff(held[:, 0])) + 1))
            yield from found(held, edges)
            held = held[edges[-1] :]
        if held is not None:
            yield from found(held, np.array([0, len(held)]))

    def found(table: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        links = []
        for k in np.flatnonzero(np.diff(edges) > 1).tolist():
            part = table[edges[k] : edges[k + 1]]
            links.append(part[:, 1][bucket_links(part[:, 2:].view(np.uint64), most)])
        if links:
            x = np.unique(np.concatenate(links), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    dealt = classes.select("node", "fingerprint").mapInArrow(spread, schema).repartition("h").sortWithinPartitions("h", "node")
    return dealt.mapInArrow(compare, "a long, b long")


def with_classes(rows: DataFrame, min_likeness: float = 0.8, bands: int | None = None, rows_a_band: int | None = None) -> DataFrame:
    """``rows(doc_id, fingerprint, ...)`` with class_id, the smallest doc_id that links reach; ``rows`` should be staged.

    Banding: each band samples as many bits as the number of classes asks for, and there
    are as many bands as find a pair of ``min_likeness`` but once in a thousand, closer ones more
    surely. All members of a bucket are verified on the whole fingerprints. Equal
    fingerprints form one class first. Empty and null texts are one class.
    """
    classes = stage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("low")).select(F.xxhash64("fingerprint").alias("node"), "fingerprint", "low"), "edit-classes")
    roots = components(near_links(classes, min_likeness, bands, rows_a_band))
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = named.groupBy("root").agg(F.min("low").alias("class_id"))
    return rows.join(named.join(lows, "root").select("fingerprint", "class_id"), "fingerprint").select(*rows.columns, "class_id")


def near_groups(docs: DataFrame, min_likeness: float = 0.8, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """``(doc_id, fingerprint, class_id)``: one row per row of ``docs``; see ``with_classes``."""
    fps = stage(fingerprints(docs).select("doc_id", "fingerprint"), "edit-fingerprints")
    return with_classes(fps, min_likeness, bands, rows)


def edited_pairs(docs: DataFrame, digest_only: bool = True) -> DataFrame:
    """Fingerprint every text, its edited text and the next document's, in order of descending doc_id.

    The edited text is the text with its last half (rounded down) replaced by as many first
    characters of the next document, or all it has; the last document's next is the first.
    Rows are dealt by ranges in that order, cut by their characters; the first row of a
    range also goes to the range before it, where the last row needs it, so neither a task
    nor the driver sees more than one range. Null ids come last; rows with equal ids (null
    ones too) are ordered by a hash of the text, and a range may begin among them. A null text
    is empty, with a fingerprint of zeros; two empty texts are alike (1). One row per row of ``docs``.
    """
    spark = docs.sparkSession
    tied = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("tie"), text_or_empty().alias("text"))
    cuts = spark.sparkContext.broadcast(ranges.cut(tied.select(F.col("doc_id").alias("key"), "tie", (F.length("text") + 50).cast("long").alias("size")), RANGE))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = cuts.value
        for b in batches:
            no = r.of(b.column(0), b.column(1).to_numpy())
            heads = np.flatnonzero(r.ends(b.column(0), b.column(1).to_numpy(), no))
            for take, to, borrowed in ((np.arange(len(no)), no, 0), (heads, (no[heads] + 1) % max(len(r), 1), 1)):
                rows = b.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(len(take), borrowed, np.int32)), *rows.columns], names=["to", "borrowed", "doc_id", "tie", "text"])

    dealt = tied.mapInArrow(deal, "to long, borrowed int, doc_id long, tie long, text string")
    ordered = dealt.repartition(n_partitions(spark), "to").sortWithinPartitions("to", "borrowed", F.col("doc_id").desc_nulls_last(), F.col("tie").desc()).select("to", "borrowed", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[int | None, str, str]]:
            held = None
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns)):
                    if held is not None and held[0] == r[0] and not held[1]:
                        yield held[2], held[3], r[3]
                    if not (r[1] and held is not None and held[1] and held[0] == r[0]):
                        held = r

        for block in _blocks(pairs(), lambda r: 2 * len(r[1])):
            edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for _, t, nxt in block]
            last = block[-1][2]
            bits = walk_bits([*(t for _, t, _ in block), *edited, last])
            own, changed = bits[: len(block)], bits[len(block) : -1]
            after = np.concatenate((own[1:], bits[-1:]))
            for k in range(len(block) - 1):  # the next row is not the next document where a range ended
                if block[k][2] is not block[k + 1][1] and block[k][2] != block[k + 1][1]:
                    after[k] = walk_bits([block[k][2]])[0]
            empty = np.array([[not t, not e, not nxt] for (_, t, nxt), e in zip(block, edited)])
            near = [np.where(empty[:, 0] | e, (empty[:, 0] & e).astype(float), likeness(own, x)) for x, e in ((changed, empty[:, 1]), (after, empty[:, 2]))]
            sha = [hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in edited]
            cols = [pa.array([i for i, _, _ in block], pa.int64()), pa.array([len(t) for _, t, _ in block], pa.int64()), pa.array(sha), pa.array(_hex(own)), pa.array(_hex(changed)), pa.array(near[0]), pa.array(near[1])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
