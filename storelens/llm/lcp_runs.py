"""Operator 12, periodic runs of words, by maximal pairs.

A run is a stretch of consecutive words with smallest period q, at least
``max(LEAST, RATIO * q)`` long, that neither neighbour extends.  Its first word
and the word q later begin equal stretches that differ before and after: a
maximal pair.  So no run has to be grown: the maximal pairs (i, j) with common
length l are listed from the LCP-interval tree of the words' suffix array, and
those whose distance p = j - i satisfies l >= (RATIO - 1) p and l + p >= LEAST
are the runs (of several periods of one stretch the least counts).

The tree is walked bottom-up.  An open interval holds its positions, sorted,
and lists of them by the word to their left.  Where a smaller child joins, each
of its positions looks for positions at an allowed distance with another word
to the left; stretches of positions with the same word are passed over by
counting in both lists.

Suffixes are sorted by prefix doubling in numpy, many texts at once, over
salted word hashes (no interval spans two texts).  Only intervals of common
length ``LEAST - 1`` or more can hold a run, so only words at which a longer
window repeats enter the tree, and of those none whose interval has its nearest
positions too far apart.

Defined cases: null or blank text has no words, no runs and an empty collapse;
rows are searched one by one, so repeated rows get equal results; a null doc_id
is not rewritten by the drill; memory grows with the longest text (about 100
bytes a word of it), which is searched alone.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .textbatch import RangeHash, U, Words, mix, slices

LEAST = 6
RATIO = 4
_SALT = U(0xD6E8FEB86659FD93)

Run = tuple[int, int, int]  # start, period, length


class _Positions:
    """Positions of an open LCP interval: sorted, and sorted by left word."""

    __slots__ = ("all", "left")

    def __init__(self, at: int, left: int):
        self.all = [at]
        self.left = {left: [at]}

    def add(self, other: _Positions) -> None:
        for left, some in other.left.items():
            mine = self.left.setdefault(left, [])
            for x in some:
                insort(mine, x)
        for x in other.all:
            insort(self.all, x)

    def others(self, lo: int, hi: int, left: int) -> Iterator[int]:
        """Positions in [lo, hi] with another left word, by halving ranges that hold any."""
        everything, same = self.all, self.left.get(left, [])
        open_ = [(bisect_left(everything, lo), bisect_right(everything, hi))]
        while open_:
            a, b = open_.pop()
            if a >= b:
                continue
            alike = bisect_right(same, everything[b - 1]) - bisect_left(same, everything[a])
            if alike == b - a:
                continue
            if b - a == 1:
                yield everything[a]
            elif not alike:
                yield from everything[a:b]
            else:
                half = (a + b) // 2
                open_ += [(a, half), (half, b)]


def _pairs(a: _Positions, b: _Positions, common: int, found: dict[tuple[int, int], int]) -> _Positions:
    """Reports the maximal pairs between two children of an interval and joins them."""
    if len(a.all) < len(b.all):
        a, b = b, a
    reach = common // (RATIO - 1)
    for left, some in b.left.items():
        for x in some:
            for y in a.others(x - reach, x + reach, left):
                start, period = min(x, y), abs(x - y)
                if period + common >= LEAST:
                    stretch = (start, period + common)
                    found[stretch] = min(found.get(stretch, period), period)
    a.add(b)
    return a


def maximal_pairs(order: list[int], common: list[int], left: list[int]) -> list[Run]:
    """Runs from a piece of a suffix array: positions in order, the common
    length of each with the one before (0 at the first), the word to the left
    of each (a value of its own where there is none)."""
    found: dict[tuple[int, int], int] = {}
    open_: list[tuple[int, _Positions]] = []
    now: _Positions | None = None

    def close(until: int) -> None:
        nonlocal now
        while open_ and open_[-1][0] > until:
            length, earlier = open_.pop()
            now = _pairs(earlier, now, length, found)

    for at, length, before in zip(order, common, left, strict=True):
        close(length)
        if open_ and open_[-1][0] == length:
            open_[-1] = (length, _pairs(open_[-1][1], now, length, found))
        elif length >= LEAST - 1 and now is not None:
            open_.append((length, now))
        now = _Positions(at, before)
    close(0)
    return [(start, period, length) for (start, length), period in found.items()]


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks of the keys, from 1; equal keys share one."""
    order = np.argsort(key)
    step = np.ones(len(key), np.int64)
    step[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(step)
    return rank


def _starts(same_as_before: np.ndarray) -> np.ndarray:
    """For each entry the place where its run of equal entries begins."""
    place = np.arange(len(same_as_before))
    return np.maximum.accumulate(np.where(same_as_before, 0, place))


def _equal_before(key: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(min(1, len(key)), bool), key[1:] == key[:-1]))


def suffix_order(word: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The suffixes at whose first word a window of four words repeats, in the
    order of their words; a suffix ends with its text (at ``end``)."""
    n = len(word)
    rank, size = _dense(word), 1

    def ahead(at: np.ndarray) -> np.ndarray:
        there = at + size
        return np.where(there < end[at], rank[np.minimum(there, n - 1)], 0)

    while size < LEAST - 2:
        rank = _dense(rank * (n + 1) + ahead(np.arange(n)))
        size *= 2
    # From here a rank counts the lesser suffixes: the parts of a group find room within it.
    count = np.bincount(rank)
    repeated = np.flatnonzero(count[rank] > 1)
    rank = (np.cumsum(count) - count)[rank] + 1
    busy = repeated
    while len(busy):
        key = rank[busy] * (n + 2) + ahead(busy)
        order = np.argsort(key)
        busy, key = busy[order], key[order]
        same = _equal_before(key)
        rank[busy] += _starts(same) - _starts(_equal_before(rank[busy]))
        size *= 2
        busy = busy[same | np.append(same[1:], False)]
    return repeated[np.argsort(rank[repeated])]


def common_lengths(word: RangeHash, order: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it (0 at the first)."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    a, b = order[:-1], order[1:]
    most = np.minimum(end[a] - a, end[b] - b)
    length = out[1:]
    step = 1 << (int(most.max()).bit_length() - 1)
    while step:
        fits = np.flatnonzero(length + step <= most)
        x, y = a[fits] + length[fits], b[fits] + length[fits]
        fits = fits[word(x, x + step) == word(y, y + step)]
        length[fits] += step
        step //= 2
    return out


def runs(word: np.ndarray, first: np.ndarray) -> list[list[Run]]:
    """Runs (start, period, length) of each text, by start, then period.  The
    texts' words are given as hashes in a row, ``first`` where each begins (one
    more entry than texts)."""
    out: list[list[Run]] = [[] for _ in range(len(first) - 1)]
    if not len(word):
        return out
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    word = mix(word + doc.astype(U) * _SALT)
    end = first[1:][doc]
    order = suffix_order(word, end)
    common = common_lengths(RangeHash(word), order, end)
    # Pieces of the suffix array whose neighbours share enough; of those, the ones with positions near enough.
    common[common < LEAST - 1] = 0
    piece = np.cumsum(common == 0) - 1
    if not len(order):
        return out
    by = np.argsort(piece * len(word) + order)
    gap = np.diff(order[by], append=0)
    gap[np.append(piece[by][1:] != piece[by][:-1], True)] = len(word)
    head = np.flatnonzero(common == 0)
    near = np.minimum.reduceat(gap, head) * (RATIO - 1) <= np.maximum.reduceat(common, head)
    rows = near[piece]
    order, common = order[rows], common[rows]
    left = [int(word[i - 1]) if i > first[d] else -1 for i, d in zip(order.tolist(), doc[order].tolist(), strict=True)]
    for start, period, length in maximal_pairs(order.tolist(), common.tolist(), left):
        d = int(doc[start])
        out[d].append((start - int(first[d]), period, length))
    for found in out:
        found.sort()
    return out


def drill_words(n: int, seed: int) -> np.ndarray:
    """Which of its n words stands at each place of a text after the drill: one
    text in ten becomes periodic from some word on."""
    at, g = np.arange(n), seed // 10
    if seed % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts of ``n`` words each, given as byte ranges, a space between two words."""
    size = end - start
    gap = np.ones(len(start), np.int64)
    last = np.cumsum(n)[n > 0] - 1
    gap[last] = 0
    to = np.cumsum(size + gap) - size - gap
    before = np.cumsum(size) - size
    out = np.full(int((size + gap).sum()), 0x20, np.uint8)
    here = np.arange(int(size.sum()))
    out[here + np.repeat(to - before, size)] = data[here + np.repeat(start - before, size)]
    total = np.concatenate(([0], np.cumsum(size + gap)))
    return out, total[np.concatenate(([0], np.cumsum(n)))]


RUNS = "array<struct<start:bigint,period:bigint,length:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())])


def periodic_runs(docs: DataFrame, seed: Column | None = None) -> DataFrame:
    """One row per document: doc_id, runs (by start, then period), collapsed:
    the words that no run holds after its first period, a space between two.
    With a ``seed`` (a number per row; null: none) texts go through the drill first."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in slices(b, "text"):
                w = Words(data, offsets)
                seeds = b.column(2).slice(lo, hi - lo).to_pylist()
                at = [drill_words(n, 1 if s is None else s) + f for n, s, f in zip(w.count.tolist(), seeds, w.first.tolist(), strict=False)]
                at = np.concatenate([np.zeros(0, np.int64), *at])
                found = runs(w.hash[at], w.first)
                kept = np.ones(len(at), np.int64)
                for f, of_doc in zip(w.first.tolist(), found, strict=False):
                    for start, period, length in of_doc:
                        kept[f + start + period : f + start + length] = 0
                n = np.add.reduceat(np.append(kept, 0), w.first[:-1]) * (w.count > 0)
                at = at[kept > 0]
                text, ends = joined(data, w.start[at], w.end[at], n)
                text = pa.Array.from_buffers(pa.large_string(), hi - lo, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text)])
                listed = pa.array([[dict(zip(("start", "period", "length"), r, strict=True)) for r in of_doc] for of_doc in found], pa.list_(_RUN))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), listed, text.cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = docs.select("doc_id", "text", (F.lit(None) if seed is None else seed).cast("bigint").alias("seed"))
    return rows.mapInArrow(run, f"doc_id {kind}, runs {RUNS}, collapsed string")


def run_report(docs: DataFrame) -> DataFrame:
    """Runs of every document after the drill: doc_id, n_runs, the run of the
    greatest exact length / period (start, length, period, exponent_milli; null
    without runs), runs_sha256, collapsed_sha256."""
    found = periodic_runs(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")))
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,period:bigint,length:bigint>"), better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("_best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
