"""Two tokenizers over the same text: where their tokens end together, and which ids go with which.

Both encode a text; the byte offsets at which a token of either side ends cut the tokens
into groups, and every A token of a group is linked with every B token of it. How many
documents hold a pair of ids linked is counted outside of memory:

1. Tasks align blocks of documents. The (pair, document) records of a block, a *run*, are
   sorted and cut by the pair's A id into radix partitions, each a zstd blob of the run's
   pairs with their numbers of documents, and one of its records. They are written once to
   the shared folder.
2. A radix partition merges the pairs of all runs through a heap, some runs at a time. Pairs
   come out with one A id after the other, so a pair's count and the highest count of its A
   id are known together; both go back to the runs that hold the pair, in the run's order.
3. A run streams its records against what came back and adds up its documents.

A pair is sent once a run, however many documents hold it: no id is too frequent for a task.
The records themselves are never gathered by id.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BpeModel, encode_all
from .common import frugal, n_partitions, slices, stage

#: Bytes of text aligned at once; links of a run; documents of a run (their numbers take 16 bits);
#: links of one group beyond which equal ids are put together first; runs merged at a time; pairs of a block of a run.
TEXT_BYTES, RUN_LINKS, RUN_DOCS, BIG_GROUP, FAN_IN, BLOCK = 2 << 20, 4_000_000, 1 << 16, 4096, 64, 4096
DOC_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


class Vocabulary:
    """The bytes, their number and the decimal digits of each id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.size = np.array([*map(len, tokens)])
        width = len(str(len(tokens)))
        self.digits = np.array([str(i) for i in range(len(tokens))], f"S{width}").view(np.uint8).reshape(-1, width)
        self.bits = (len(tokens) - 1).bit_length()

    def join(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Aligner:
    """Both tokenizers, read from their files: a byte-level BPE (A, given a blank first) and a sentencepiece model (B, which adds one)."""

    def __init__(self, path_a: str, path_b: str):
        self.model_a = BpeModel(path_a)
        self.model_a.added, self.model_a.added_split = {}, None  # their strings are plain text
        self.model_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = self.model_a.bytes_of
        self.a = Vocabulary([of.get(i, b"") for i in range(max(of) + 1)])
        pieces = [self.model_b.id_to_piece(i) for i in range(self.model_b.get_piece_size())]
        self.b = Vocabulary([bytes([int(s[3:5], 16)]) if self.model_b.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(pieces)])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text by A and by B; none where either side does not give back a blank and the text."""
        packed = [b"".join(x for g in groups for x in g) for groups in encode_all(self.model_a, [" " + t if t else "" for t in texts])]
        a = [np.frombuffer(x, np.uint32) for x in packed]
        b, none = [], np.zeros(0, np.uint32)
        for k, (t, ids) in enumerate(zip(texts, self.model_b.encode(texts, num_threads=1) if texts else [])):
            whole = (" " + t).encode()
            if t and self.b.join(ids) == whole and self.a.join(a[k].tolist()) == whole:
                b.append(np.array(ids, np.uint32))
            else:
                a[k] = none
                b.append(none)
        return a, b


@lru_cache(maxsize=1)
def load_aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


class Aligned:
    """Texts one after the other, aligned: tokens, the group of each, which of them end one, and the groups' sizes."""

    def __init__(self, aligner: Aligner, texts: list[str]):
        a, b = aligner.encode(texts)
        self.of, self.docs = aligner, len(texts)
        self.a, self.b = (np.concatenate([*x, np.zeros(0, np.uint32)]).astype(np.int64) for x in (a, b))
        self.n_a, self.n_b = (np.array([*map(len, x)], np.int64) for x in (a, b))
        end_a, end_b = np.cumsum(aligner.a.size[self.a]), np.cumsum(aligner.b.size[self.b])
        seen = np.zeros((2, int(end_a[-1]) + 1 if len(end_a) else 1), bool)
        seen[0, end_a] = seen[1, end_b] = True
        self.cut_a, self.cut_b = seen[1, end_a], seen[0, end_b]
        self.group_a, self.group_b = np.cumsum(self.cut_a) - self.cut_a, np.cumsum(self.cut_b) - self.cut_b
        n = int(self.cut_a.sum())
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        self.doc_a = np.repeat(np.arange(self.docs), self.n_a)
        self.doc = self.doc_a[self.cut_a]  # of each group
        self.n_groups = np.bincount(self.doc, minlength=self.docs)
        before = np.concatenate([[0], np.cumsum(self.size_a * self.size_b)])
        ends = np.cumsum(self.n_groups)
        self.n_links = before[ends] - before[ends - self.n_groups]

    def described(self) -> list[bytes]:
        """Each text's groups, ``a1,a2|b1;a3|b2,b3``."""
        width = max(self.of.a.digits.shape[1], self.of.b.digits.shape[1])
        cells = np.zeros((len(self.a) + len(self.b), width + 1), np.uint8)
        at_a = np.arange(len(self.a)) + (np.cumsum(self.size_b) - self.size_b)[self.group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(self.size_a)[self.group_b]
        for at, ids, digits, cut, mark in ((at_a, self.a, self.of.a.digits, self.cut_a, b"|"), (at_b, self.b, self.of.b.digits, self.cut_b, b";")):
            cells[at, : digits.shape[1]] = digits[ids]
            cells[at, width] = np.where(cut, mark[0], b","[0])
        tokens = np.cumsum(self.n_a + self.n_b)
        used = cells != 0
        ends = np.concatenate([[0], np.cumsum(used.sum(1))])[tokens]
        flat = cells[used].tobytes()
        return [flat[i : max(i, k - 1)] for i, k in zip([0, *ends.tolist()], ends.tolist())]

    def links(self, most: int = RUN_LINKS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """(document, A id, B id, times) of all links, at most about ``most`` at once; times None: each once, repeats apart.

        In a group of many links equal ids of a side are put together first, so that a long
        unaligned stretch costs its distinct ids, not its occurrences.
        """
        big = self.size_a * self.size_b > BIG_GROUP
        few_a, few_b = (~big[g] if big.any() else np.ones(len(g), bool) for g in (self.group_a, self.group_b))
        yield from self._pairs(self.group_a[few_a], self.a[few_a], None, self.group_b[few_b], self.b[few_b], None, most)
        if big.any():
            sides = []
            for group, ids, few, bits in ((self.group_a, self.a, few_a, self.of.a.bits), (self.group_b, self.b, few_b, self.of.b.bits)):
                found, times = np.unique(group[~few] << bits | ids[~few], return_counts=True)
                sides += [found >> bits, found & ((1 << bits) - 1), times]
            yield from self._pairs(*sides, most)

    def _pairs(self, group_a, a, times_a, group_b, b, times_b, most):
        sizes = np.bincount(group_b, minlength=len(self.doc)) if len(group_b) else np.zeros(len(self.doc), np.int64)
        starts, reach = np.cumsum(sizes) - sizes, sizes[group_a]
        ends, at = np.cumsum(reach), 0
        while at < len(a):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            n, g = reach[at:to], group_a[at:to]
            other = np.repeat(starts[g] - (ends[at:to] - n - before), n) + np.arange(int(n.sum()))
            times = None if times_a is None else np.repeat(times_a[at:to], n) * times_b[other]
            yield np.repeat(self.doc[g], n), np.repeat(a[at:to], n), b[other], times
            at = to


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays in one zstd blob, each in as few bytes a number as its largest takes."""
    out = []
    for x in arrays:
        kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
        out += [np.array([kind.itemsize, len(x)], np.uint64).tobytes(), x.astype(kind).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        width, n = np.frombuffer(raw, np.uint64, 2, at).tolist()
        out.append(np.frombuffer(raw, f"u{width}", n, at + 16).astype(np.int64))
        at += 16 + n * width
    return out


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


class Run:
    """Sorted (pair, document) records of a block of documents, spilled as compressed pieces when there are many.

    A record is one number: the place of its A id among the ids by radix partition, its B id, its document.
    """

    def __init__(self, aligner: Aligner, parts: int):
        ids = np.arange(len(aligner.a.tokens))
        order = np.lexsort((ids, ids % parts))
        self.place = np.empty(len(ids), np.int64)
        self.place[order] = ids
        self.shift = aligner.b.bits + 16
        self.bounds = np.searchsorted(ids[order] % parts, np.arange(parts + 1)) << self.shift
        self.clear()

    def clear(self) -> None:
        self.raw, self.held, self.links, self.spilled, self.docs = [], 0, 0, [], []

    def add(self, doc: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray | None) -> None:
        keys = self.place[a] << self.shift
        keys |= b << 16
        keys |= doc
        self.links += len(keys)
        if times is not None:
            self.spilled.append(self._cut(*summed(keys, times), pack))
            return
        self.raw.append(keys)
        self.held += len(keys)
        if self.held > RUN_LINKS:
            self.spilled.append(self._cut(*self._sorted(), pack))

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([*self.raw, np.zeros(0, np.int64)])
        self.raw, self.held = [], 0
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        return keys[first], np.diff(np.append(first, len(keys)))

    def _cut(self, keys, times, of) -> list:
        at = np.searchsorted(keys, self.bounds).tolist()
        return [of(keys[i:k], times[i:k]) for i, k in zip(at, at[1:])]

    def close(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(radix partition, pairs with their numbers of documents, records) of each partition that has some."""
        pieces = self._cut(*self._sorted(), lambda *x: x)
        for p, (keys, times) in enumerate(pieces):
            if self.spilled:
                more = [unpack(s[p]) for s in self.spilled]
                keys, times = summed(np.concatenate([keys, *(x[0] for x in more)]), np.concatenate([times, *(x[1] for x in more)]))
            if len(keys):
                pairs = keys >> 16
                first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
                n, pairs = np.diff(np.append(first, len(keys))), pairs[first]
                yield p, pack(np.diff(pairs, prepend=0), n), pack(n, keys & 0xFFFF, times)


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (pair, number) runs as one, numbers of equal pairs added: a heap holds the end of each run's block, and what lies up to the first end is settled."""
    blocks = [(k, 0) for k, (pairs, _) in enumerate(runs) if len(pairs)]
    heap = [(int(runs[k][0][min(BLOCK, len(runs[k][0])) - 1]), k) for k, _ in blocks]
    heapq.heapify(heap)
    at, out = dict(blocks), []
    while heap:
        end = heap[0][0]
        keys, values = [], []
        for k, i in at.items():
            pairs, n = runs[k]
            to = i + int(np.searchsorted(pairs[i : i + BLOCK], end, "right"))
            if to > i:
                keys.append(pairs[i:to])
                values.append(n[i:to])
                at[k] = to
        out.append(summed(np.concatenate(keys), np.concatenate(values)))
        while heap and heap[0][0] <= end:
            _, k = heapq.heappop(heap)
            if (i := at[k]) < len(pairs := runs[k][0]):
                heapq.heappush(heap, (int(pairs[min(i + BLOCK, len(pairs)) - 1]), k))
            else:
                del at[k]
    return tuple(np.concatenate([*(x[k] for x in out), np.zeros(0, np.int64)]) for k in (0, 1))


def _pairs_of(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, n = unpack(blob)
    return np.cumsum(steps), n


def count_pairs(blobs: list[bytes], b_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a radix partition in order, their counts, and the highest count of each one's A id. At most ``FAN_IN`` runs are open at once."""
    while len(blobs) > FAN_IN:
        groups = [merged([*map(_pairs_of, blobs[k : k + FAN_IN])]) for k in range(0, len(blobs), FAN_IN)]
        blobs = [pack(np.diff(pairs, prepend=0), n) for pairs, n in groups]
    pairs, counts = merged([*map(_pairs_of, blobs)])
    side = pairs >> b_bits
    first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]])) if len(side) else np.zeros(0, int)
    highest = np.maximum.reduceat(counts, first) if len(first) else counts
    return pairs, counts, np.repeat(highest, np.diff(np.append(first, len(pairs))))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and whole texts of rows that together have about ``TEXT_BYTES`` of text; null texts are empty."""
    for b in slices(batches):
        texts = [t or "" for t in b.column(1).to_pylist()]
        sizes = np.cumsum([len(t) for t in texts])
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT_BYTES, "right")))
            yield b.column(0)[at:to], texts[at:to]
            at = to


def token_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, groups array<struct<a: array<int>, b: array<int>>>`` of each row: the ids of either side between common ends.

    A null or empty text, and one that either side does not give back byte for byte (with
    the blank before it), has no groups. Rows repeat as they do in ``docs``.
    """
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load_aligner(path_a, path_b)
        for ids, texts in _blocks(batches):
            x = Aligned(aligner, texts)
            lists = [pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), pa.array(side, pa.int32())) for size, side in ((x.size_a, x.a), (x.size_b, x.b))]
            groups = pa.StructArray.from_arrays(lists, ["a", "b"])
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(np.append(0, np.cumsum(x.n_groups)).astype(np.int32), groups).cast(kind)], names=["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def spilled_runs(docs: DataFrame, path_a: str, path_b: str, parts: int) -> DataFrame:
    """The runs of ``docs``, written to the shared folder: ``run, p, pairs, records``; p is -1 for the run's documents (in ``records``, as an Arrow stream)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load_aligner(path_a, path_b)
        now, numbers = Run(aligner, parts), itertools.count(TaskContext.get().partitionId() << 32)

        def close() -> Iterator[pa.RecordBatch]:
            no = next(numbers)
            table = pa.Table.from_batches(now.docs)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            for p, pairs, records in itertools.chain([(-1, None, sink.getvalue().to_pybytes())], now.close()):
                yield pa.RecordBatch.from_arrays([pa.array([no]), pa.array([p], pa.int32()), pa.array([pairs], pa.binary()), pa.array([records], pa.binary())], names=["run", "p", "pairs", "records"])
            now.clear()

        rows = 0
        for ids, texts in _blocks(batches):
            if now.docs and (rows + len(texts) > RUN_DOCS or now.links > RUN_LINKS):
                yield from close()
                rows = 0
            x = Aligned(aligner, texts)
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in x.described()]
            columns = [ids, *(pa.array(c, pa.int64()) for c in (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array(digests, pa.string())]
            now.docs.append(pa.RecordBatch.from_arrays(columns, names=DOC_COLUMNS))
            for doc, a, b, times in x.links():
                now.add(doc + rows, a, b, times)
            rows += len(texts)
        if now.docs:
            yield from close()

    return stage(docs.select("doc_id", "text").mapInArrow(frugal(run), "run long, p int, pairs binary, records binary"), "token-runs")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Runs and their pairs of one radix partition after the other; rows come in its order."""
    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3))))
    for p, own in itertools.groupby(rows, lambda r: r[0]):
        _, runs, blobs = zip(*own)
        yield p, [*runs], [*blobs]


def _dealt(runs: DataFrame) -> DataFrame:
    return runs.where("p >= 0").select("p", "run", "pairs").repartition("p").sortWithinPartitions("p", "run")


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``a_id, b_id, n_docs``: how many rows of ``docs`` hold the two ids linked. An empty table has none."""
    parts = n_partitions(docs.sparkSession)
    runs = spilled_runs(docs, path_a, path_b, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load_aligner(path_a, path_b)
        bits, place = aligner.b.bits, Run(aligner, parts).place
        ids = np.argsort(place)
        for _, _, blobs in _by_part(batches):
            pairs, counts, _ = count_pairs(blobs, bits)
            for at in range(0, len(pairs), 1 << 16):
                x = pairs[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[x >> bits], pa.int32()), pa.array(x & ((1 << bits) - 1), pa.int32()), pa.array(counts[at : at + (1 << 16)])], names=["a_id", "b_id", "n_docs"])

    return _dealt(runs).mapInArrow(frugal(run), "a_id int, b_id int, n_docs long")


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` and, over its links, ``n_best, count_sum``.

    count: the number of rows whose texts link the two ids; best: no other B id has a higher
    count with the same A id. Null and empty texts, and texts that a side does not give back
    byte for byte, have zeros and ''. Repeated rows are documents of their own, a null
    ``doc_id`` stays null, further columns of ``docs`` are ignored, and an empty table gives
    no rows. Texts are taken whole: one of many links spills sorted pieces on its own.
    """
    parts = n_partitions(docs.sparkSession)
    runs = spilled_runs(docs, path_a, path_b, parts)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = load_aligner(path_a, path_b).b.bits
        for p, of, blobs in _by_part(batches):
            pairs, counts, highest = count_pairs(blobs, bits)
            known = counts << 1 | (counts == highest)
            for no, blob in zip(of, blobs):
                reply = pack(known[np.searchsorted(pairs, _pairs_of(blob)[0])])
                yield pa.RecordBatch.from_arrays([pa.array([no]), pa.array([p], pa.int32()), pa.array([1], pa.int32()), pa.array([reply])], names=["run", "p", "kind", "blob"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4))))
        for _, own in itertools.groupby(rows, lambda r: r[0]):
            table = pa.ipc.open_stream(next(own)[3]).read_all()
            best, total = np.zeros((2, table.num_rows), np.int64)
            for _, _, kind, blob in own:
                if kind == 0:
                    n, doc, times = unpack(blob)
                    continue
                known = np.repeat(unpack(blob)[0], n)
                np.add.at(total, doc, times * (known >> 1))
                np.add.at(best, doc, times * (known & 1))
            for name, values in (("n_best", best), ("count_sum", total)):
                table = table.append_column(name, pa.array(values))
            yield from table.combine_chunks().to_batches()

    replies = _dealt(runs).mapInArrow(frugal(back), "run long, p int, kind int, blob binary")
    records = runs.select("run", "p", F.lit(0).alias("kind"), F.col("records").alias("blob"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return records.union(replies).repartition("run").sortWithinPartitions("run", "p", "kind").mapInArrow(frugal(add_up), schema)
