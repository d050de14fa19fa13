"""Packing documents into sequences by vector best-fit over a histogram of lengths.

A piece of n tokens asks for n of a sequence's tokens, one of its document places and n^2
of its attention cost. Equal pieces are interchangeable, so the plan is made for the counts
of each length, of which there are at most as many as a sequence has tokens, whatever the
size of the corpus: longest first, every length goes to the bins where it leaves the
smallest weighted residual (or with which its weighted dot-product is largest), under all
three capacities; bins with the same contents are one entry with a multiplicity. Documents
then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import load_model
from .common import n_partitions, stage, text_or_empty
from .spans import random_values, span_hashes

#: Pretokens that the memo holds, characters of one that are merged here, characters worked on together.
MEMO, SHORT, BLOCK = 250_000, 40, 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Characters from here on, and some below, are left to the tokenizer's own normaliser.
PLAIN = 0x250
BLANK, LETTER, DIGIT, OTHER, ODD = range(5)
#: What a free token, document place and unit of attention cost count for, as shares of a sequence's.
WEIGHTS = (1.0, 0.01, 0.01)


def _kinds() -> np.ndarray:
    """What each character below PLAIN is to the pattern by which the vocabulary splits lower-cased text; the last entry is for all others.

    Fixed value, the pattern: 's|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+
    """
    of = np.full(PLAIN + 1, ODD, np.uint8)
    for c in map(chr, range(PLAIN)):
        if len(c.lower()) == 1 and not "\x1c" <= c <= "\x1f":
            of[ord(c)] = BLANK if regex.match(r"\s", c) else LETTER if regex.match(r"\p{L}", c.lower()) else DIGIT if regex.match(r"\p{N}", c) else OTHER
    return of


KIND = _kinds()
LOWER = np.array([*(ord(chr(c).lower()[0]) for c in range(PLAIN)), 0xFFFF], np.uint16)
_OF_CHAR = random_values(1 << 16)[LOWER]


def pretokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, hash)`` of the pretokens of ``text``, which begins and ends with a blank.

    A word with a character that is not plain is one whole span, for the tokenizer to split:
    no pretoken crosses white space.
    """
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    at = np.minimum(points, PLAIN).astype(np.uint16)
    kind = KIND[at]
    new = kind[1:] != kind[:-1]
    new |= kind[1:] == DIGIT
    new = np.concatenate(([False], new))
    quote = np.flatnonzero(points == 39)
    quote = quote[kind[quote - 1] != OTHER]
    if len(quote):
        low = LOWER[at[np.minimum(quote[:, None] + np.arange(1, 3), len(at) - 1)]]
        one = np.isin(low[:, 0], [ord(c) for c in "stmd"])
        two = np.any([(low[:, 0] == ord(a)) & (low[:, 1] == ord(b)) for a, b in ("re", "ve", "ll")], 0)
        new[quote[one | two] + 1] = False
        for q, size in ((quote[one], 2), (quote[two], 3)):
            new[q + size] = True
    edge = np.flatnonzero(new)
    full = kind[edge] != BLANK
    start, end = edge[full], np.concatenate((edge[1:], [len(at)]))[full]
    h = span_hashes(_OF_CHAR[at], start, end)
    odd = np.flatnonzero(kind == ODD)
    if len(odd):
        blank = np.flatnonzero(kind == BLANK)
        k = np.unique(np.searchsorted(blank, odd))
        first, last = blank[k - 1] + 1, blank[k]
        inside = np.searchsorted(first, start, "right") - 1
        keep = (inside < 0) | (start >= last[inside])
        words = np.array([xxhash.xxh3_64_intdigest(text[a:b].encode("utf-8", "replace"), 1) for a, b in zip(first.tolist(), last.tolist())], np.uint64)
        start, end, h = np.concatenate((start[keep], first)), np.concatenate((end[keep], last)), np.concatenate((h[keep], words))
        order = np.argsort(start, kind="stable")
        start, end, h = start[order], end[order], h[order]
    return start, end, h


class WordEncoder:
    """A tokenizer that drops white space, memoised by pretoken: its ids are those of the pretokens one after another.

    New pretokens are merged many at a time, with the tokenizer's own merges; what its
    normaliser could change in more than case, and long ones, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.bpe = load_model(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> None:
        plain = [p for p in fresh if len(p) <= SHORT and max(p) < "\u0250" and "\u0130" not in p and not ODD_SPACE.search(p)]
        merged = self.bpe.merge_many([*{p.lower().encode() for p in plain}])
        known = {p: merged[p.lower().encode()] for p in plain}
        whole = [p for p in fresh if p not in known]
        known.update(zip(whole, self._encode(whole)))
        size = np.array([len(known[p]) // 4 for p in fresh], np.int64)
        self.slots.update(zip(fresh, range(len(self.slots), len(self.slots) + len(fresh))))
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join([known[p] for p in fresh]), np.uint32)))

    def _block(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, none with a special token."""
        text = "\n".join(["", *texts, ""])
        start, end, h = pretokens(text)
        coded = pa.array(h).dictionary_encode()
        code = coded.indices.to_numpy()
        at = np.empty(len(coded.dictionary), np.int64)
        at[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        names = [text[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
        if len(self.slots) > MEMO:
            self._forget()
        slots = self.slots
        if fresh := [*{p: 0 for p in names if p not in slots}]:
            self._learn(fresh)
        slot = np.array([slots[p] for p in names], np.int64)[code]
        size = self.size[slot]
        done = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[slot] - done + size, size) + np.arange(done[-1] if len(done) else 0)].tobytes()
        ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]) + 1)
        cut = 4 * np.concatenate(([0], done))[np.concatenate(([0], ends))]
        return [ids[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist())]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as 32-bit numbers."""
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and chars < BLOCK:
                chars += len(texts[to])
                to += 1
            special = [any(s in t for s in self.special) for t in texts[at:to]]
            plain = iter(self._block([t for t, s in zip(texts[at:to], special) if not s]))
            yield from (self._encode([t])[0] if s else next(plain) for t, s in zip(texts[at:to], special))
            at = to


#: White space to Python but not to the tokenizer.
ODD_SPACE = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=2)
def load_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: every whole text's ids and ``end_id``, cut every ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, size = load_encoder(tokenizer), array("I", [end_id]).tobytes(), 4 * capacity
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1).to_pylist())):
                ids += end
                rows += [(doc, at // size, at // 4, len(cut) // 4, zlib.crc32(cut)) for at in range(0, len(ids), size) for cut in [ids[at : at + size]]]
            cols = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = 4096, max_docs: int = 4096, max_attention: int | None = None, weights: tuple[float, float, float] = WEIGHTS, score: str = "norm") -> np.ndarray:
    """Places for ``counts`` (pieces of each length): rows ``(length, first rank, sequence, copies, offset)`` by length and rank.

    Of the pieces of one length those from first rank on fill the sequences from
    ``sequence`` on, ``copies`` in each, the first at ``offset``. A piece alone must fit.
    """
    max_attention = capacity * capacity if max_attention is None else max_attention
    caps, w = np.array([capacity, max_docs, max_attention], float), np.array(weights)
    free = np.empty((64, 3))
    many: list[int] = []
    held: list[list[tuple[int, int]]] = []

    def put(room: np.ndarray, n: int, items: list[tuple[int, int]]) -> None:
        nonlocal free
        if len(many) == len(free):
            free = np.concatenate((free, np.empty_like(free)))
        free[len(many)] = room
        many.append(n)
        held.append(items)

    for length in sorted(counts, reverse=True):
        need, left = np.array([length, 1, length * length], float), counts[length]
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens does not fit an empty sequence")
        while left:
            rooms = free[: len(many)]
            fits = np.nonzero((rooms >= need).all(1))[0]
            if not len(fits):
                each = int((caps // need).min())
                if full := left // each:
                    put(caps - each * need, full, [(length, each)])
                    left -= full * each
                if left:
                    put(caps - left * need, 1, [(length, left)])
                    left = 0
                continue
            if score == "norm":
                k = int(fits[((((rooms[fits] - need) / caps) ** 2) @ w).argmin()])
                each = min(int((free[k] // need).min()), max(1, left // many[k]))
            else:
                k, each = int(fits[((rooms[fits] / caps * need / caps) @ w).argmax()]), 1
            n = min(many[k], left // each)
            if n < many[k]:
                put(free[k].copy(), many[k] - n, held[k])
                many[k] = n
            free[k] -= each * need
            held[k] = [*held[k], (length, each)]
            left -= n * each
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for n, items in zip(many, held):
        at = 0
        for length, each in items:
            out.append((length, rank.get(length, 0), sequence, each, at))
            rank[length] = rank.get(length, 0) + n * each
            at += length * each
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, capacity: int = 4096, max_docs: int = 4096, max_attention: int | None = None, weights: tuple[float, float, float] = WEIGHTS, score: str = "norm") -> DataFrame:
    """``pieces`` (a staged table with doc_id, piece and length) with ``sequence_id`` and ``offset``.

    The driver sees one count for each length, at most ``capacity`` of them. Ranks are
    taken inside salted groups of a length, so one very common length is shared by many tasks.
    Repeated rows and null ids are pieces like others, equal ones in any order; an empty
    table gives an empty one.
    """
    spark = pieces.sparkSession
    salts = 4 * max(n_partitions(spark), 8)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    groups = stage(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack-counts")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = plan(counts, capacity, max_docs, max_attention, weights, score)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    offsets = groups.select("length", "salt", before.alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(offsets, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")
    names = pieces.columns
    table = spark.sparkContext.broadcast(places)
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = table.value
        key = p[:, 0] << 44 | p[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            k, each = rank - p[at, 1], p[at, 3]
            cols = [*(b.column(n) for n in names), pa.array(p[at, 2] + k // each), pa.array(p[at, 4] + k % each * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, **limits) -> DataFrame:
    """Pack every document of ``docs`` into sequences of at most ``capacity`` tokens.

    Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document is
    its ids and ``end_id``; longer ones are cut into pieces. Null and empty texts are the end id
    alone; repeated rows and null ids are documents of their own; only doc_id and text are read.
    """
    return pack_pieces(stage(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity, **limits)
