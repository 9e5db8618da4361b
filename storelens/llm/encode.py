"""Token ids of whole texts, by the ``tokenizers`` library.

A text is cut where the tokenizer's own rules always cut: between white space
and what follows it, and between ASCII (or Latin-1) letters or digits and ASCII
punctuation other than the apostrophe.  Each distinct piece is encoded once and
the texts' ids are gathered from those; pieces are told apart by 64-bit hashes
of their bytes, a numpy pass over the Arrow buffer.  The result equals encoding
whole texts (tests compare both).  The string of an added token, such as the end mark,
in a text gives that token's id, as in the library's plain call: the text is
cut around it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, written
from .textbatch import U, Words, slices

#: How a tokenizer treats white space: dropped, or a space goes with what follows it.
WORD_PIECES, BYTE_PIECES = "word", "byte"
END_ID = 1
#: Distinct pieces a worker remembers before it starts afresh (bounds its memory).
REMEMBERED = 1_000_000
#: White space outside ASCII, which the byte-level rules join with ASCII space.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_ALNUM, _PUNCT = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCT[[c for c in range(33, 127) if not _ALNUM[c] and c != 39]] = True


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file's content and its kind of pieces; small and of fixed
    size, so it is broadcast to the executors."""

    json: str
    pieces: str

    @staticmethod
    def load(path: str, pieces: str) -> Vocabulary:
        return Vocabulary(Path(path).read_text(encoding="utf-8"), pieces)

    def broadcast(self, spark: SparkSession) -> Broadcast:
        return spark.sparkContext.broadcast(self)


def alnum_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions between ASCII (or Latin-1) letters or digits and ASCII
    punctuation other than the apostrophe, inside texts."""
    n = len(data)
    alnum, punct = _ALNUM[data], _PUNCT[data]
    if n > 1:  # Latin-1 letters: byte C3 and one more, but not the signs C3 97 and C3 B7
        two = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        alnum[:-1] |= two
        alnum[1:] |= two
    cut = np.zeros(n, bool)
    cut[1:] = (alnum[:-1] & punct[1:]) | (punct[:-1] & alnum[1:])
    cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = False
    return np.flatnonzero(cut)


class Places:
    """Place of each 64-bit key, an open-addressing table in numpy."""

    def __init__(self, bits: int = 21):
        self._bits = bits
        self._shift, self._mask = U(64 - bits), (1 << bits) - 1
        self._key = np.zeros(1 << bits, U)  # 0: free
        self._value = np.zeros(1 << bits, np.int32)
        self.size = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 where unknown."""
        slot = (keys >> self._shift).astype(np.int64)
        there = self._key[slot]
        out = np.where(there == keys, self._value[slot], -1)
        rest = np.flatnonzero((there != keys) & (there != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self._mask
            there = self._key[slot[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self._value[slot[rest[hit]]]
            rest = rest[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Gives distinct new keys the next places, in order."""
        if 2 * (self.size + len(keys)) > len(self._key):
            old = np.flatnonzero(self._key)
            known = self._key[old][np.argsort(self._value[old])]
            self.__init__(int(2 * (len(known) + len(keys)) + 1).bit_length())
            self.add(known)
        value = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self.size += len(keys)
        slot = (keys >> self._shift).astype(np.int64)
        while len(keys):
            free = self._key[slot] == 0
            self._key[slot[free]] = keys[free]  # of several, one stays
            won = self._key[slot] == keys
            self._value[slot[won]] = value[won]
            keys, value, slot = keys[~won], value[~won], (slot[~won] + 1) & self._mask


class Encoder:
    _kept: dict[int, Encoder] = {}

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> Encoder:
        """The worker process's encoder, kept from task to task."""
        key = hash(vocabulary)
        if key not in cls._kept:
            cls._kept.clear()
            cls._kept[key] = cls(vocabulary)
        return cls._kept[key]

    def __init__(self, vocabulary: Vocabulary):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_str(vocabulary.json)
        self._spaced = vocabulary.pieces == BYTE_PIECES
        self._added = {t.content.encode(): i for i, t in self._tok.get_added_tokens_decoder().items()}
        self._added_in = re.compile(b"|".join(re.escape(t) for t in sorted(self._added, key=len, reverse=True)))
        self._mark = next(t.content for t in self._tok.get_added_tokens_decoder().values() if t.special)
        self._mark_id = self._tok.token_to_id(self._mark)
        self.dtype = np.dtype("<u2" if self._tok.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self._known = Places()
        self._ids = np.zeros(1 << 16, self.dtype)
        self._at = np.zeros(1 << 16, np.int64)
        self._len = np.zeros(1 << 16, np.int64)
        self._used = len(self._added)
        for i, (text, token) in enumerate(self._added.items()):
            raw = np.frombuffer(text, np.uint8)
            w = Words(raw, np.array([0, len(raw)]))
            self._known.add(np.maximum(w.bytes(np.zeros(1, np.int64), np.array([len(raw)])), U(1)))
            self._ids[i], self._at[i], self._len[i] = token, i, 1

    def _room(self, name: str, need: int) -> np.ndarray:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)
        return getattr(self, name)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encodes new pieces, many in one call, a special token between them
        (no new piece holds its string: texts are cut around those)."""
        mark = self._mark.encode()
        base = self._known.size
        self._known.add(keys)
        for lo in range(0, len(keys), 1000):
            some = pieces[lo : lo + 1000]
            text = mark.join(some).decode("utf-8", "replace")
            ids = np.array(self._tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            gap = np.flatnonzero(ids == self._mark_id)
            first, last = np.append(0, gap + 1), np.append(gap, len(ids))
            k, real = base + lo, ids[ids != self._mark_id]
            self._room("_at", k + len(some))[k : k + len(some)] = self._used + first - np.arange(len(some))
            self._room("_len", k + len(some))[k : k + len(some)] = last - first
            self._room("_ids", self._used + len(real))[self._used : self._used + len(real)] = real
            self._used += len(real)

    def _bounds(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of the pieces of a slice of texts, in order."""
        data, cut = w.data, alnum_cuts(w.data, w.offsets)
        start = np.sort(np.concatenate((w.start, cut)))
        end = np.sort(np.concatenate((w.end, cut)))
        if not self._spaced:
            return start, end
        # White space: what stands before a word in its text, and at the end of a text.
        first_word = np.concatenate(([True], w.doc[1:] != w.doc[:-1])) if len(w.doc) else np.zeros(0, bool)
        run_at = np.where(first_word, w.offsets[w.doc], np.concatenate(([0], w.end[:-1])) if len(w.end) else 0)
        run = w.start - run_at
        some = run > 0
        joins = some.copy()
        joins[some] = data[w.start[some] - 1] == 0x20
        start[np.searchsorted(start, w.start[joins])] -= 1
        long, lone = run > 1, some & ~joins
        last = np.concatenate((np.zeros(0, np.int64), w.offsets[:-1]))
        has = w.count > 0
        last[has] = w.end[w.first[1:][has] - 1]
        tail = last < w.offsets[1:]
        start = np.concatenate((start, run_at[long], w.start[lone] - 1, last[tail]))
        end = np.concatenate((end, w.start[long] - 1, w.start[lone], w.offsets[1:][tail]))
        order = np.argsort(start, kind="stable")
        return start[order], end[order]

    def _added_places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of added tokens' strings inside texts."""
        found = [m.span() for m in self._added_in.finditer(data)] if len(data) else []
        start, end = np.array(found, np.int64).reshape(-1, 2).T
        inside = np.searchsorted(offsets, start, side="right") == np.searchsorted(offsets, end - 1, side="right")
        return start[inside], end[inside]

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, place): byte ranges of a slice's pieces and their places in the memory."""
        if self._known.size > REMEMBERED:
            self._forget()
        first, last = self._added_places(data, offsets)
        w = Words(data, np.union1d(offsets, np.concatenate((first, last))) if len(first) else offsets)
        start, end = self._bounds(w)
        if len(first):
            at = np.searchsorted(first, start, side="right") - 1
            other = (at < 0) | (start >= last[at])
            start, end = np.concatenate((start[other], first)), np.concatenate((end[other], last))
            order = np.argsort(start)
            start, end = start[order], end[order]
        key = np.maximum(w.bytes(start, end), U(1))
        place = self._known.find(key)
        new = np.flatnonzero(place < 0)
        if len(new):
            unique, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            raw, at, base = data.tobytes(), new[first], self._known.size
            self._learn(unique, [raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            place[new] = base + back
        return start, end, place

    def lengths(self, place: np.ndarray) -> np.ndarray:
        """Ids of each piece."""
        return self._len[place]

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole texts at once, for texts with white space outside ASCII."""
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        found = [e.ids for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, self.dtype), *(np.array(f, self.dtype) for f in found)])
        return ids, np.concatenate(([0], np.cumsum([len(f) for f in found], dtype=np.int64)))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts in a row, and where each text's begin (one more entry than texts)."""
        if self._spaced and _WIDE_SPACE.search(data):
            ids, at = self._whole(data, offsets)
        else:
            start, _, place = self.pieces(data, offsets)
            n = self._len[place]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            ids = self._ids[np.arange(total) + np.repeat(self._at[place] - (ends - n), n)]
            at = np.concatenate(([0], ends))[np.searchsorted(start, offsets)]
        if end is not None:
            ids = np.insert(ids, at[1:], end)
            at = at + np.arange(len(at))
        return ids, at

    def encode_texts(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        parts = [(t or "").encode() for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
        return self.encode(np.frombuffer(b"".join(parts), np.uint8), offsets, end)


def binary_rows(ids: np.ndarray, at: np.ndarray, dtype: np.dtype) -> pa.Array:
    """Each text's ids as little-endian bytes, without a copy per row."""
    data = np.ascontiguousarray(ids.astype(dtype, copy=False))
    off = (at * dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(off), pa.py_buffer(data)])


def encoded(docs: DataFrame, vocabulary: Vocabulary, end_id: int = END_ID) -> DataFrame:
    """doc_id, key (a number per row), ids (little-endian bytes), n_tokens; written once."""
    ship(docs.sparkSession)
    shared = vocabulary.broadcast(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(shared.value)
        for b in batches:
            for lo, hi, data, offsets in slices(b, "text"):
                ids, at = enc.encode(data, offsets, end_id)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), binary_rows(ids, at, enc.dtype), pa.array(np.diff(at))],
                    names=["doc_id", "key", "ids", "n_tokens"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("key"), "text")
    out = rows.mapInArrow(run, f"doc_id {kind}, key bigint, ids binary, n_tokens bigint")
    return written(out, "encoded", compression="zstd")
