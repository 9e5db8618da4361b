"""Operator 8, packing by non-negative least squares.

Documents are cut into whole windows and one rest each.  The histogram of the
rests (at most ``window`` - 1 lengths, a Spark aggregate) decides the packing:

1. shallow combinations are enumerated that fill a window exactly (k equal
   rests and one other, k up to ``DEPTH``);
2. repeat counts x >= 0 are solved against the histogram, min |A x - h|;
3. the counts are rounded down to what the histogram holds;
4. what remains is packed greedily, largest first; a window's last gap is
   filled by cutting a rest.  The very last sequence, if short, is split into
   sequences of a power of two.

All of this works on lengths and counts, so its size does not depend on the
number of documents.  Each document then finds its places by its rest's rank
among the rests of that length; ranks are counted in salted groups, so one
common length (copies of one text) never meets in one task.

Defined cases: null or empty text holds only the end id; rows repeating an id
are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship
from .encode import BYTE_PIECES, Vocabulary, encoded

WINDOW = 2048
DEPTH = 4
ITERATIONS = 400


def combinations(hist: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, k, b): k rests of length a and one of length b fill a window; every
    length occurs in the histogram (indexed by length)."""
    window = len(hist)
    a, k = (x.ravel() for x in np.meshgrid(np.arange(1, window), np.arange(1, depth + 1), indexing="ij"))
    b = window - k * a
    ok = (b > 0) & ((k > 1) | (a <= b))
    a, k, b = a[ok], k[ok], b[ok]
    need = np.where(a == b, k + 1, k)
    ok = (hist[a] >= need) & (hist[b] >= 1)
    return a[ok], k[ok], b[ok]


def nnls(a: np.ndarray, k: np.ndarray, b: np.ndarray, hist: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Non-negative x that minimises |A x - h|; column j uses length a[j] k[j]
    times and b[j] once.  Multiplicative updates keep x non-negative and never
    raise the residual."""
    h = hist.astype(float)
    back = lambda v: k * v[a] + v[b]
    goal = back(h)
    x = np.minimum(h[a] / k, h[b]) / 2
    for _ in range(iterations):
        model = np.bincount(a, k * x, len(h)) + np.bincount(b, x, len(h))
        x = x * goal / np.maximum(back(model), 1e-12)
    return x


@dataclass
class Plan:
    """Where rests go: rests of length ``bin`` with rank in [``first``, ``last``)
    give ``take`` ids to sequence ``seq`` + rank - first at ``offset``; what is
    cut off goes on as a rest of length ``next_bin`` from rank ``next_rank``."""

    key: np.ndarray  # bin << 40 | first, ascending
    seq: np.ndarray
    offset: np.ndarray
    take: np.ndarray
    next_bin: np.ndarray
    next_rank: np.ndarray
    n_sequences: int

    def place(self, row: np.ndarray, length: np.ndarray, rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start, length, sequence, offset) of all pieces of the given rests."""
        out = []
        while len(row):
            at = np.searchsorted(self.key, (length << 40) | rank, side="right") - 1
            step = rank - (self.key[at] & ((1 << 40) - 1))
            out.append((row, start, self.take[at], self.seq[at] + step, self.offset[at]))
            more = self.next_bin[at] > 0
            row, start = row[more], (start + self.take[at])[more]
            length, rank = self.next_bin[at][more], (self.next_rank[at] + step)[more]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5


def plan(hist: np.ndarray) -> Plan:
    """The packing of a histogram of rests (index: length; the window is its size)."""
    window = len(hist)
    left = hist.astype(np.int64).copy()
    rank = np.zeros(window, np.int64)  # rests of a length placed so far
    total = left.copy()  # rests of a length there ever were
    uses: list[tuple[int, ...]] = []
    n_seq = 0

    def use(length: int, times: int, offset: int, take: int) -> None:
        """``times`` rests of one length, one for each of as many sequences."""
        rest = length - take
        uses.append((length << 40 | int(rank[length]), n_seq, offset, take, rest, int(total[rest]) if rest else 0))
        rank[length] += times
        left[length] -= times
        if rest:
            left[rest] += times
            total[rest] += times

    a, k, b = combinations(hist)
    x = np.floor(nnls(a, k, b, hist) + 1e-9).astype(np.int64) if len(a) else np.zeros(0, np.int64)
    for j in np.argsort(-x, kind="stable"):
        one, many, other = int(a[j]), int(k[j]), int(b[j])
        times = int(min(x[j], left[one] // (many + (one == other)), left[other]))
        if times <= 0:
            continue
        for i in range(many):
            use(one, times, i * one, one)
        use(other, times, many * one, other)
        n_seq += times

    while left.any():
        filled, chosen, spare = 0, [], left.copy()
        while filled < window and (fits := np.flatnonzero(spare[: window - filled + 1])).size:
            chosen.append((int(fits[-1]), int(fits[-1])))
            spare[fits[-1]] -= 1
            filled += int(fits[-1])
        if filled < window and spare.any():
            longest = int(np.argmax(spare))  # the commonest rest left is cut
            chosen.append((longest, window - filled))
            filled = window
        if filled < window:
            break
        used = np.bincount([c for c, _ in chosen], minlength=window)
        times = int((left[used > 0] // used[used > 0]).min())
        offset = 0
        for length, take in chosen:
            use(length, times, offset, take)
            offset += take
        n_seq += times
    # Fewer ids than a window: sequences of a power of two.
    remains = int((left * np.arange(window)).sum())
    for size in (1 << i for i in range(remains.bit_length() - 1, -1, -1) if remains >> i & 1):
        offset = 0
        while offset < size:
            length = int(np.flatnonzero(left)[-1])
            take = min(length, size - offset)
            use(length, 1, offset, take)
            offset += take
        n_seq += 1
    cols = np.array(sorted(uses), np.int64).reshape(-1, 6).T
    return Plan(*cols, n_sequences=n_seq)


def pack(enc: DataFrame, window: int = WINDOW, salts: int | None = None) -> DataFrame:
    """Pieces of ``encoded`` documents: key, doc_id, start, length, doc_tokens,
    sequence_id, offset and ``piece`` (the ids as stored, little-endian)."""
    spark = enc.sparkSession
    ship(spark)
    salts = salts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = enc.select(
        "key",
        "n_tokens",
        F.expr(f"n_tokens div {window}").alias("full"),
        (F.col("n_tokens") % window).alias("rest"),
        F.pmod(F.xxhash64("key"), F.lit(salts)).alias("salt"),
    )
    counted = {r.rest: r.n for r in rows.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``window`` rows
    hist = np.zeros(window, np.int64)
    for length, n in counted.items():
        hist[length] = n
    hist[0] = 0
    packing = plan(hist)
    shared = spark.sparkContext.broadcast(packing)  # bounded by the window, not by the data

    # Rank of each rest among those of its length, and of each whole window, in two steps.
    by_rest = rows.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("n"))
    rest_before = by_rest.select("rest", "salt", (F.sum("n").over(W.partitionBy("rest").orderBy("salt")) - F.col("n")).alias("_rb"))
    by_salt = rows.groupBy("salt").agg(F.sum("full").alias("n"))
    full_before = by_salt.select("salt", (F.sum("n").over(W.orderBy("salt")) - F.col("n")).alias("_fb"))
    inside = W.partitionBy("salt").orderBy("key")
    ranked = rows.repartition("salt").select(
        "*",
        F.row_number().over(W.partitionBy("salt", "rest").orderBy("key")).alias("_ri"),
        (F.sum("full").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("full")).alias("_fi"),
    )
    ranked = ranked.join(full_before, "salt").join(rest_before, ["rest", "salt"])
    ranked = ranked.select("key", "n_tokens", "full", "rest", (F.col("_rb") + F.col("_ri") - 1).alias("rank"), (F.col("_fb") + F.col("_fi")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            key, n, full, rest, rank, before = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns)
            some = np.flatnonzero(rest)
            row, start, length, seq, offset = p.place(some, rest[some], rank[some], (full * window)[some])
            whole = np.repeat(np.arange(len(key)), full)
            nth = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
            row = np.concatenate((row, whole))
            cols = {
                "key": key[row],
                "start": np.concatenate((start, nth * window)),
                "length": np.concatenate((length, np.full(len(whole), window))),
                "doc_tokens": n[row],
                "sequence_id": np.concatenate((seq, p.n_sequences + before[whole] + nth)),
                "offset": np.concatenate((offset, np.zeros(len(whole), np.int64))),
            }
            yield pa.RecordBatch.from_pydict(cols)

    pieces = ranked.mapInArrow(run, "key bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    width = (F.length("ids") / F.col("n_tokens")).cast("int")
    return pieces.join(enc.select("key", "doc_id", "ids", "n_tokens"), "key").select(
        *pieces.columns,
        "doc_id",
        F.substring("ids", F.col("start").cast("int") * width + 1, F.col("length").cast("int") * width).alias("piece"),
    )


def packed(docs: DataFrame, vocabulary_path: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    enc = encoded(docs, Vocabulary.load(vocabulary_path, BYTE_PIECES))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [zlib.crc32(np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes()) for x, n in zip(b.column(6).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = [b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64()), b.column(3), b.column(4), b.column(5)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    pieces = pack(enc, window).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "piece")
    return pieces.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
