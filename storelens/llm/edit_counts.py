"""Operator 6, edit-aware token counts.

Each document keeps a segment tree over its pre-tokens: leaves of about
``LEAF`` consecutive pieces (the tokenizer always cuts between pieces), and above
them sums of bytes and of tokens.  An edit descends by bytes to the leaves it
touches; those and the nearest with text to each side, the boundary context,
are encoded again, and the sums above the replaced leaves are updated.  The
rest of the text is neither encoded nor copied again: an edit costs what the
leaves it touches hold, and the way down to them.

A tree is an array in heap order for each sum (node i has children 2i and
2i + 1; the leaves are the last half, as many as the least power of two that
holds them).  Sums of code points, by which edits are placed, are made from
the text when it is taken up.

Defined cases: null text is empty and has one empty leaf; edits apply in the
order given, each to the text that the ones before left; positions count code
points and are clipped to the text; null or no edits change nothing; rows that
repeat an id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .encode import WORD_PIECES, Encoder, Vocabulary
from .textbatch import slices

LEAF = 16
#: Bytes of context to each side of an edit at least, where the text has them.
CONTEXT = 32


def _heap(leaves: np.ndarray) -> np.ndarray:
    size = 1 << max(0, int(len(leaves) - 1).bit_length())
    t = np.zeros(2 * size, np.int64)
    t[size : size + len(leaves)] = leaves
    while size > 1:
        t[size // 2 : size] = t[size : 2 * size : 2] + t[size + 1 : 2 * size : 2]
        size //= 2
    return t


def _leaf_at(t: np.ndarray, position: int) -> tuple[int, int]:
    """(leaf, its first byte): the leaf that holds a byte position."""
    size, node, before = len(t) // 2, 1, 0
    while node < size:
        node *= 2
        if position >= before + t[node] and t[node + 1]:
            before += int(t[node])
            node += 1
    return node - size, before


def _set_leaves(t: np.ndarray, first: int, values: np.ndarray) -> None:
    """Replaces leaves and updates the sums above them."""
    size = len(t) // 2
    lo, hi = first + size, first + size + len(values)
    t[lo:hi] = values
    while lo > 1:
        lo, hi = lo // 2, (hi + 1) // 2
        t[lo:hi] = t[2 * lo : 2 * hi : 2] + t[2 * lo + 1 : 2 * hi : 2]


def _build(enc: Encoder, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bytes, tokens) trees of every text of a slice."""
    start, _, place = enc.pieces(data, offsets)
    n = np.concatenate(([0], np.cumsum(enc.lengths(place))))
    bound = np.searchsorted(start, offsets)
    out = []
    for a, b, lo, hi in zip(bound[:-1].tolist(), bound[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        cut = np.arange(a, b, LEAF)
        at = start[cut].copy()
        if len(cut):
            at[0] = lo
            leaves, tokens = np.diff(np.append(at, hi)), np.diff(n[np.append(cut, b)])
        else:
            leaves, tokens = np.array([hi - lo]), np.zeros(1, np.int64)
        out.append((_heap(leaves), _heap(tokens)))
    return out


def _pieces_of(raw: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [raw[e - n : e] for e, n in zip(ends, sizes.tolist(), strict=True)]


def _points(raw: bytes, sizes: np.ndarray) -> np.ndarray:
    """Code points of consecutive byte ranges."""
    first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    total = np.concatenate(([0], np.cumsum(first)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class _Document:
    """A text as the bytes of its leaves, and trees of their bytes, code points
    and tokens.  An edit reads and writes the leaves it touches, and the sums
    above them; the whole text is only put together when it is asked for."""

    def __init__(self, text: str, bytes_: np.ndarray, tokens: np.ndarray):
        raw, size = text.encode(), len(bytes_) // 2
        self.bytes, self.tokens = bytes_, tokens
        self.points = _heap(_points(raw, bytes_[size:]))
        self._leaf = _pieces_of(raw, bytes_[size:])
        self.reencoded = 0

    @property
    def text(self) -> str:
        return b"".join(self._leaf).decode()

    def begin(self, position: int, delete: int, insert: str) -> bytes:
        """Takes an edit up; the bytes that have to be encoded again."""
        n = int(self.points[1])
        p = min(max(position, 0), n)
        q = min(p + max(delete, 0), n)
        i, before = _leaf_at(self.points, p)
        j, at = _leaf_at(self.points, q)
        left = self._leaf[i].decode()[: p - before].encode()
        right = self._leaf[j].decode()[q - at :].encode()
        size = len(self.points) // 2
        # Context: the nearest leaves that hold bytes (a large deletion leaves empty ones), as many as any token's string needs.
        first, last, end = i, j, at + int(self.points[size + j])
        context = 0
        while before and (first == i or context < CONTEXT):
            first, before = _leaf_at(self.points, before - 1)
            context += len(self._leaf[first])
        context = 0
        while end < n and (last == j or context < CONTEXT):
            last, start = _leaf_at(self.points, end)
            end = start + int(self.points[size + last])
            context += len(self._leaf[last])
        self._from, self._leaves = first, last - first + 1
        self._region = b"".join((*self._leaf[first:i], left, insert.encode(), right, *self._leaf[j + 1 : last + 1]))
        self.reencoded += len(self._region)
        return self._region

    def finish(self, start: np.ndarray, tokens: np.ndarray, length: int) -> None:
        """Puts the re-encoded region's pieces (first bytes, token counts) into the touched leaves."""
        k = self._leaves
        if len(start) > 2 * LEAF * k:
            k = -(-len(start) // LEAF)
        cut = (np.arange(k) * len(start)) // k
        at = start[np.minimum(cut, max(len(start) - 1, 0))].copy() if len(start) else np.zeros(k, np.int64)
        at[cut >= len(start)] = length
        at[0] = 0
        total = np.concatenate(([0], np.cumsum(tokens)))
        leaves, counts = np.diff(np.append(at, length)), np.diff(total[np.append(cut, len(start))])
        changed = {"bytes": leaves, "points": _points(self._region, leaves), "tokens": counts}
        size = len(self.bytes) // 2
        self._leaf[self._from : self._from + self._leaves] = _pieces_of(self._region, leaves)
        if k == self._leaves:
            for name, new in changed.items():
                _set_leaves(getattr(self, name), self._from, new)
            return
        # More leaves: the sums are laid out anew, without the empty places at the end.
        used = np.flatnonzero(self.bytes[size:])
        last = max(int(used[-1]) + 1 if len(used) else 1, self._from + self._leaves)
        for name, new in changed.items():
            t = getattr(self, name)[size : size + last]
            setattr(self, name, _heap(np.concatenate((t[: self._from], new, t[self._from + self._leaves :]))))
        del self._leaf[last + k - self._leaves :]
        self._leaf += [b""] * (len(self.bytes) // 2 - len(self._leaf))


def _apply(enc: Encoder, docs: list[_Document], edits: list[list[dict] | None]) -> None:
    """Applies each document's edits, round by round: one encoder call a round."""
    for step in range(max((len(e or []) for e in edits), default=0)):
        turn = [i for i, e in enumerate(edits) if len(e or []) > step]
        parts = []
        for i in turn:
            e = edits[i][step] or {}
            parts.append(docs[i].begin(int(e.get("pos") or 0), int(e.get("del") or 0), e.get("ins") or ""))
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
        start, _, place = enc.pieces(np.frombuffer(b"".join(parts), np.uint8), offsets)
        n, bound = enc.lengths(place), np.searchsorted(start, offsets)
        for i, a, b, lo, hi in zip(turn, bound[:-1].tolist(), bound[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            docs[i].finish(start[a:b] - lo, n[a:b], hi - lo)


EDITS = "array<struct<pos:bigint,del:bigint,ins:string>>"


def token_trees(docs: DataFrame, vocabulary: Broadcast, edits: str | None = None) -> DataFrame:
    """doc_id, text, tree_bytes, tree_tokens (and the edits column, if named)."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text", "tree_bytes", "tree_tokens", *([edits] if edits else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(vocabulary.value)
        for b in batches:
            for lo, hi, data, offsets in slices(b, "text"):
                trees = _build(enc, data, offsets)
                cols = [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo)]
                cols += [pa.array([t[k] for t in trees], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols + [c.slice(lo, hi - lo) for c in b.columns[2:]], names=names)

    rows = docs.select("doc_id", "text", *([edits] if edits else []))
    more = f", {edits} {EDITS}" if edits else ""
    return rows.mapInArrow(run, f"doc_id {kind}, text string, tree_bytes array<bigint>, tree_tokens array<bigint>{more}")


def apply_edits(trees: DataFrame, vocabulary: Broadcast, edits: str = "edits") -> DataFrame:
    """The trees after the edits in column ``edits``: doc_id, text, both trees,
    n_tokens_before, n_tokens, bytes_reencoded."""
    ship(trees.sparkSession)
    kind = trees.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text", "tree_bytes", "tree_tokens", "n_tokens_before", "n_tokens", "bytes_reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(vocabulary.value)
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                b = whole.slice(lo, 1000)
                texts, edit = b.column(1).to_pylist(), b.column(4).to_pylist()
                heaps = [[x.values.to_numpy(zero_copy_only=False).copy() for x in b.column(k)] for k in (2, 3)]
                docs = [_Document(t or "", x, y) for t, x, y in zip(texts, *heaps, strict=True)]
                before = [int(d.tokens[1]) for d in docs]
                _apply(enc, docs, edit)
                cols = [
                    b.column(0),
                    pa.array([d.text if d.text or t is not None else None for d, t in zip(docs, texts, strict=True)], pa.string()),
                    pa.array([d.bytes for d in docs], pa.list_(pa.int64())),
                    pa.array([d.tokens for d in docs], pa.list_(pa.int64())),
                    pa.array(before, pa.int64()),
                    pa.array([int(d.tokens[1]) for d in docs], pa.int64()),
                    pa.array([d.reencoded for d in docs], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = trees.select("doc_id", "text", "tree_bytes", "tree_tokens", edits)
    return rows.mapInArrow(
        run,
        f"doc_id {kind}, text string, tree_bytes array<bigint>, tree_tokens array<bigint>, "
        "n_tokens_before bigint, n_tokens bigint, bytes_reencoded bigint",
    )


def revision(docs: DataFrame) -> DataFrame:
    """doc_id, text and edits: a revision of every document made from its own
    text (a passage repeated at one third, a cut at two thirds, a word put into
    the middle)."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    edit = lambda pos, cut, ins: F.struct(pos.cast("long").alias("pos"), F.lit(cut).cast("long").alias("del"), ins.alias("ins"))
    passage = F.concat(F.lit(" "), F.substring(F.coalesce(F.col("text"), F.lit("")), 1, 40))
    edits = F.array(edit(F.floor(n / 3), 0, passage), edit(F.floor(n * 2 / 3), 17, F.lit("")), edit(F.floor(n / 2), 5, F.lit("revised")))
    return docs.select("doc_id", "text", edits.cast(EDITS).alias("edits"))


def edited_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens_before, n_tokens (after the revision), n_bytes and
    bytes_reencoded of every document."""
    vocabulary = Vocabulary.load(vocabulary_path, WORD_PIECES).broadcast(docs.sparkSession)
    after = apply_edits(token_trees(revision(docs), vocabulary, "edits"), vocabulary)
    return after.select("doc_id", "n_tokens_before", "n_tokens", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "bytes_reencoded")
