"""Byte-level BPE as a streaming transducer with bounded lookahead, and the inverse state machine.

A merge can change a token only through a chain of later rules, so the merge list fixes how
many bytes to the right can still matter (``lookahead``). The encoder holds back that many
bytes of a run it has not seen the end of, emits every token before them, and forgets it;
its memory does not grow with the text. Decoding turns ids into bytes and bytes into
characters with an incremental UTF-8 decoder that keeps at most three bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: White space as the vocabulary's pattern sees it (Unicode White_Space).
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the pattern that splits text before merging.
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A word with the blank before it, or white space that no word follows directly: pretokens never cross such a cut.
WORD = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
CLASSES = [regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", rf"[^{SPACE}\p{{L}}\p{{N}}]*", rf"[{SPACE}]*")]
#: Entries that a memo of words or pretokens may hold (of words, each of two generations); characters fed at a time;
#: a word that is streamed; a word that the memo takes.
MEMO, CHUNK, LONG_WORD, SHORT = 300_000, 1 << 16, 2048, 40
#: No rule for a pair.
NONE = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Bytes after a token's end that can still change it, for rules in order of rank.

    ``reach[r]``: how far before the first unseen byte the boundary that rule r removes can
    lie. It was kept or removed because of an earlier rule q beyond it: either q would have
    swallowed the end of r's right part (q's left part ends that part), or q made a piece of
    it. The longest such chain, plus one byte, is enough for every token to its left.
    """
    made: dict[str, tuple[str, str, int]] = {}
    reach: list[int] = []
    by_left: dict[str, int] = {}
    for r, (x, y) in enumerate(merges):
        far, s = 0, y
        while True:
            if s in by_left:
                far = max(far, len(y) + by_left[s])
            if s not in made:
                break
            s = made[s][1]
        todo = [(y, 0)]
        while todo:
            s, at = todo.pop()
            if s in made:
                a, b, q = made[s]
                far = max(far, at + len(a) + reach[q])
                todo += [(a, at), (b, at + len(a))]
        reach.append(far)
        by_left[x] = max(far, by_left.get(x, 0))
        made.setdefault(x + y, (x, y, r))
    return 1 + max(reach, default=0)


class BpeModel:
    """Vocabulary, ranks and lookahead read from a tokenizer file of a byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        #: Some vocabularies mark the last symbol of a word; theirs are merged whole, not streamed.
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        known = {*(symbols := byte_symbols()), *(s + self.suffix for s in symbols)}
        for x, y in merges:
            if x not in known or y not in known:
                raise ValueError("a merge uses a symbol that no earlier merge makes")
            known.add(x + y)
        #: Rank and result of a rule in one number, by its two parts in one number.
        self.ranks = {vocab[x] << 20 | vocab[y]: r << 20 | vocab[x + y] for r, (x, y) in reversed([*enumerate(merges)])}
        self.byte_ids = [vocab[s] for s in symbols]
        self.byte_table = np.array(self.byte_ids)
        self.last_table = np.array([vocab[s + self.suffix] for s in symbols])
        self.byte_pairs = np.array([[self.ranks.get(a << 20 | b, NONE) for b in self.byte_ids] for a in self.byte_ids])
        self.pair_keys = np.array(sorted(self.ranks))
        self.pair_ranks = np.array([self.ranks[k] for k in self.pair_keys.tolist()])
        self.lookahead = 0 if self.suffix else sufficient_lookahead(merges)
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in s.removesuffix(self.suffix)) for s, i in vocab.items() if s not in self.added}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        size = max(self.bytes_of) + 1
        tokens = [self.bytes_of.get(i, b"") for i in range(size)]
        #: For whole arrays of ids: where a token's bytes lie and how many there are, and its decimal text with a comma.
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_size = np.array([*map(len, tokens)])
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.decimals = np.array([f"{i}," for i in range(size)], "S8").view(np.uint8).reshape(size, 8)[:, : len(str(size)) + 1]
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """All merges inside ``data``: the lowest rank first, of equal ones the leftmost."""
        ids, ranks = [self.byte_ids[b] for b in data], self.ranks
        todo = [ranks.get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while todo and (best := min(todo)) != NONE:
            k = todo.index(best)
            ids[k : k + 2] = [new := best & 0xFFFFF]
            del todo[k]
            if k:
                todo[k - 1] = ranks.get(ids[k - 1] << 20 | new, NONE)
            if k < len(todo):
                todo[k] = ranks.get(new << 20 | ids[k + 1], NONE)
        return ids

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 20 | right
        at = np.searchsorted(self.pair_keys, pair)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == pair, self.pair_ranks[at], NONE)

    def merge_many(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """``merge`` of many short pieces at once, packed: those of one length are the rows of a matrix."""
        done: dict[bytes, bytes] = {}
        by_size: dict[int, list[bytes]] = {}
        for p in pieces:
            by_size.setdefault(len(p), []).append(p)
        for size, rows in by_size.items():
            raw = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, size)
            ids, todo = self.byte_table[raw], self.byte_pairs[raw[:, :-1], raw[:, 1:]]
            if self.suffix:
                ids[:, -1] = self.last_table[raw[:, -1]]
                if size > 1:
                    todo[:, -1] = self._rank(ids[:, -2], ids[:, -1])
            who = np.arange(len(rows))
            for width in range(size, 0, -1):
                k = todo.argmin(1) if width > 1 else np.zeros(len(who), int)
                best = todo[np.arange(len(who)), k] if width > 1 else np.full(len(who), NONE)
                over = best == NONE
                flat, step = ids[over].astype(np.uint32).tobytes(), 4 * width
                for at, i in enumerate(who[over].tolist()):
                    done[rows[i]] = flat[at * step : at * step + step]
                live = ~over
                if not live.any():
                    break
                ids, todo, k, who, n = ids[live], todo[live], k[live][:, None], who[live], int(live.sum())
                new, col = best[live] & 0xFFFFF, np.arange(width - 1)
                ids = np.take_along_axis(ids, col + (col > k), 1)
                np.put_along_axis(ids, k, new[:, None], 1)
                col = np.arange(width - 2)
                todo = np.take_along_axis(todo, col + (col >= k), 1)
                k, row = k[:, 0], np.arange(n)
                if (left := k > 0).any():
                    todo[row[left], k[left] - 1] = self._rank(ids[row[left], k[left] - 1], new[left])
                if (right := k < width - 2).any():
                    todo[row[right], k[right]] = self._rank(new[right], ids[row[right], k[right] + 1])
        return done

    def piece(self, text: str) -> list[int]:
        """Ids of one pretoken of any length."""
        run = RunEncoder(self)
        return [*run.feed(text.encode("utf-8", "replace")), *run.finish()]

    def prime(self, words: set[str]) -> None:
        """Fill the memo with those of ``words`` that it lacks, all their merges at once."""
        known, old, pieces = self.words, self.old_words, self.pieces
        short = [w for w in words if w not in known and len(w) <= SHORT]
        if len(known) + len(short) > MEMO:
            old, known = known, {}
            self.old_words, self.words = old, known
            short = [w for w in words if len(w) <= SHORT]
            if len(pieces) > MEMO:
                self.pieces = pieces = {}
        parts = {}
        for w in short:
            if (got := old.get(w)) is not None:
                known[w] = got
            else:
                parts[w] = (w,) if w[1:].isalpha() and (w[0] == " " or w[0].isalpha()) else PRETOKEN.findall(w)
        coded = {p: p.encode("utf-8", "replace") for ps in parts.values() for p in ps if p not in pieces}
        merged = self.merge_many([*set(coded.values())])
        pieces.update({p: merged[b] for p, b in coded.items()})
        known.update({w: pieces[ps[0]] if len(ps) == 1 else b"".join([pieces[p] for p in ps]) for w, ps in parts.items()})

    def word(self, text: str) -> bytes:
        """Ids of a word with its blank, packed."""
        return self.words.get(text) or self.old_words.get(text) or packed([i for p in PRETOKEN.findall(text) for i in self.piece(p)])


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class RunEncoder:
    """The transducer proper: bytes of one pretoken in, stable ids out. Up to three lookaheads are held and merged whole: most pretokens never stream."""

    def __init__(self, model: BpeModel):
        self.model, self.held = model, b""

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        out: list[int] = []
        room = self.model.lookahead
        if len(self.held) <= 3 * room:
            return out
        data, self.held, at = self.held, b"", 0
        while len(data) - at > 3 * room:
            window = data[at : at + 3 * room]
            stable = len(window) - room
            for i in self.model.merge(window):
                if (end := len(self.model.bytes_of[i])) > stable:
                    break
                out.append(i)
                stable -= end
                at += end
        self.held = data[at:]
        return out

    def finish(self) -> list[int]:
        data, self.held = self.held, b""
        return self.model.merge(data)


class StreamEncoder:
    """Text in pieces of any size, packed ids out as soon as they are stable."""

    def __init__(self, model: BpeModel):
        self.model, self.tail, self.run = model, "", None

    def feed(self, text: str) -> Iterator[bytes]:
        if self.run is not None:
            kind, enc = self.run
            n = CLASSES[kind].match(text).end()
            if n == len(text):
                yield from self._out(enc.feed(text.encode("utf-8", "replace")))
                return
            yield from self._out(enc.feed(text[:n].encode("utf-8", "replace")) + enc.finish())
            self.run, text = None, text[n:]
        text = self.tail + text
        words = WORD.findall(text)
        #: The last two may go on: "ab" + "c", or white space whose last blank joins the next word.
        keep = words[-2:]
        self.tail = "".join(keep)
        if len(text) > CHUNK // 2:
            self.model.prime({*words})
        yield from map(self.model.word, words[:-2])
        if len(self.tail) > 2 * LONG_WORD:
            yield from self._long()

    def _long(self) -> Iterator[bytes]:
        """A word without end in sight: emit its settled pretokens, and stream the last if it is a long run."""
        parts = PRETOKEN.findall(self.tail)
        done = [p for p in parts[:-3]]
        for p in done:
            yield from self._out(self.model.piece(p))
        self.tail = self.tail[sum(map(len, done)) :]
        last = PRETOKEN.findall(self.tail)[-1]
        if len(last) > LONG_WORD and last[-1] not in "'" and not last[-1].isspace():
            for p in PRETOKEN.findall(self.tail)[:-1]:
                yield from self._out(self.model.piece(p))
            enc = RunEncoder(self.model)
            kind = next(k for k, c in enumerate(CLASSES) if c.match(last[-1]).end())
            yield from self._out(enc.feed(last.encode("utf-8", "replace")))
            self.tail, self.run = "", (kind, enc)

    def finish(self) -> Iterator[bytes]:
        if self.run is not None:
            yield from self._out(self.run[1].finish())
        yield from map(self.model.word, WORD.findall(self.tail))
        self.tail, self.run = "", None

    @staticmethod
    def _out(ids: list[int]) -> Iterator[bytes]:
        if ids:
            yield packed(ids)


class StreamDecoder:
    """Ids in, characters out; a character split between tokens waits for its last byte."""

    def __init__(self, model: BpeModel):
        self.model, self.state = model, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Sequence[int]) -> str:
        m, ids = self.model, np.asarray(ids, np.int64)
        size = m.token_size[ids]
        end = np.cumsum(size)
        at = np.repeat(m.token_start[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)
        return self.state.decode(m.token_bytes[at].tobytes())

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=2)
def load_model(path: str) -> BpeModel:
    return BpeModel(path)


def encode_stream(model: BpeModel, text: str, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """Groups of stable outputs for ``text`` fed ``chunk`` characters at a time; added tokens stand for themselves."""
    for k, part in enumerate(model.added_split.split(text) if model.added_split and any(a in text for a in model.added) else [text]):
        if k % 2:
            yield [packed([model.added[part]])]
            continue
        enc = StreamEncoder(model)
        for at in range(0, len(part), chunk):
            if got := [*enc.feed(part[at : at + chunk])]:
                yield got
        if got := [*enc.finish()]:
            yield got


def encode_text(model: BpeModel, text: str, chunk: int = CHUNK) -> list[int]:
    return array("I", b"".join([ids for group in encode_stream(model, text, chunk) for ids in group])).tolist()


def decode_ids(model: BpeModel, ids: list[int]) -> str:
    dec = StreamDecoder(model)
    return dec.feed(ids) + dec.finish()


def encode_all(model: BpeModel, texts: list[str]) -> Iterator[Iterator[list[bytes]]]:
    """For each text the groups that ``encode_stream`` gives; the words of many short texts are merged together."""
    at = 0
    while at < len(texts):
        found, chars, words = [], 0, set()
        while at < len(texts) and chars < 32 * CHUNK:
            t = texts[at]
            if len(t) > CHUNK or any(a in t for a in model.added):
                found.append(encode_stream(model, t))
            else:
                found.append(w := WORD.findall(t))
                words.update(w)
            chars += min(len(t), CHUNK)
            at += 1
        model.prime(words)
        memo, slow = model.words.get, model.word
        for x in found:
            yield [[memo(w) or slow(w) for w in x]] if isinstance(x, list) else x


def _round_trip(model: BpeModel, groups: Iterator[list[bytes]]) -> tuple[int, str, str]:
    n = 0
    of_ids, of_text, dec = hashlib.sha256(), hashlib.sha256(), StreamDecoder(model)
    for group in groups:
        if len(ids := np.frombuffer(b"".join(group), np.uint32)):
            text = model.decimals[ids].ravel()
            of_ids.update(b"," * (n > 0) + text[text != 0].tobytes()[:-1])
            n += len(ids)
            of_text.update(dec.feed(ids).encode())
    of_text.update(dec.finish().encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()


def encode(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with a column ``out`` of token ids (array of int). A null text gives no ids; other columns stay."""
    schema = docs.select("*", F.lit(None).cast("array<int>").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(tokenizer)
        for b in batches:
            ids = [[i for g in gs for x in g for i in array("I", x)] for gs in encode_all(model, [t or "" for t in b.column(text).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with a column ``out``: the text of the ids. Null ids give an empty text."""
    schema = tokens.select("*", F.lit("").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(tokenizer)
        for b in batches:
            texts = [decode_ids(model, i or []) for i in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return tokens.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode and decode every whole text; digests of both results, ids never leaving the task.

    Rows are as those of ``docs`` (repeated rows repeat, a null ``doc_id`` stays null, a null
    text is empty and has the digests of nothing); columns other than these two are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(tokenizer)
        for b in batches:
            got = [_round_trip(model, g) for g in encode_all(model, b.column(1).to_pylist())]
            n, ids, texts = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
