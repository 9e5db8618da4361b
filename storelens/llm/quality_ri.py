"""Operator 5, quality classifier: random-indexing word vectors pooled per
document, a two-layer network, temperature-calibrated probabilities; numpy.

Every word piece has a sparse random index vector that follows from its hash.
A piece's word vector is the sum of the index vectors around it in the training
texts.  Pieces that are rare there share the vector of their shape (case,
digits, script, length).  A document is the mean of its pieces' vectors, of
their squares, and of how often a piece equals the one 1 to ``LAGS`` before it
(the agreement of their index vectors).

Word vectors and network are fitted on a bounded sample of labelled rows
(``SAMPLE_DOCS`` texts of at most ``SAMPLE_CHARS`` characters); every document
is scored, whole, in one Arrow pass against the broadcast model, whose size is
bounded by ``VOCABULARY`` x ``DIMENSIONS``.

Defined cases: null and empty text pool to zero and get the model's score of
zero; a null doc_id is not held out and is never learned from; of several label
rows of one id the least quality counts; without labels every score is 0.5; a
task holds about 140 to 160 bytes for each byte of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .encode import Places, alnum_cuts
from .textbatch import SLICE_BYTES, U, Words, mix, slices

SAMPLE_DOCS = 4_000
SAMPLE_CHARS = 20_000
VOCABULARY = 40_000
DIMENSIONS = 64
NONZERO = 4
WINDOW = 2
LAGS = 6
FEATURES = 2 * DIMENSIONS + LAGS
HIDDEN = 32
THRESHOLD = 0.3
_FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % _FOLDS


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, shape) of every piece: words cut between letters or
    digits and punctuation; shape keys are small numbers."""
    w = Words(data, offsets)
    cut = alnum_cuts(data, offsets)
    start = np.sort(np.concatenate((w.start, cut)))
    end = np.sort(np.concatenate((w.end, cut)))
    doc = np.searchsorted(offsets, start, side="right") - 1

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[end] - total[start]

    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    digit = (data >= 48) & (data <= 57)
    wide = data >= 128
    n = end - start
    length = np.minimum(np.log2(n).astype(np.int64), 7)
    nu, nl, nd, nw = count(upper), count(lower), count(digit), count(wide)
    case = np.where(nu == 0, 0, np.where(nl == 0, 3, np.where(nu == 1, 1, 2)))
    kind = np.where(nu + nl + nd + nw == 0, 0, np.where(nd == 0, 1, np.where(nd == n, 2, 3)))
    shape = ((case * 4 + kind) * 2 + (nw > 0)) * 8 + length
    return doc, np.maximum(w.bytes(start, end), U(1)), shape


N_SHAPES = 4 * 4 * 2 * 8


def _runs(texts: list[str], limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of runs of texts, about ``limit`` bytes each."""
    held: list[bytes] = []
    for i, t in enumerate(texts):
        held.append(t.encode())
        if sum(map(len, held)) >= limit or i == len(texts) - 1:
            yield np.frombuffer(b"".join(held), np.uint8), np.concatenate(([0], np.cumsum([len(h) for h in held], dtype=np.int64)))
            held = []


def index_vectors(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, sign) of the ``NONZERO`` entries of each key's index vector."""
    h = mix(key[:, None] + np.arange(NONZERO, dtype=U)[None, :] * U(0xA0761D6478BD642F))
    return (h % U(DIMENSIONS)).astype(np.int64), np.where(h >> U(63), 1.0, -1.0)


@dataclass
class Model:
    keys: np.ndarray  # the vocabulary, most frequent first
    vectors: np.ndarray  # shapes first, then the vocabulary
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def places(self) -> Places:
        p = Places(18)
        p.add(self.keys)
        return p

    def pooled(self, data: np.ndarray, offsets: np.ndarray, places: Places) -> np.ndarray:
        doc, key, shape = _pieces(data, offsets)
        out = np.zeros((len(offsets) - 1, FEATURES), np.float32)
        if len(doc):
            known = places.find(key)
            v = self.vectors[np.where(known >= 0, known + N_SHAPES, shape)]
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            n = np.diff(np.append(first, len(doc)))[:, None]
            out[doc[first], :DIMENSIONS] = np.add.reduceat(v, first) / n
            out[doc[first], DIMENSIONS : 2 * DIMENSIONS] = np.add.reduceat(v * v, first) / n
            for lag in range(1, LAGS + 1):
                same = np.zeros(len(doc))
                same[lag:] = (key[lag:] == key[:-lag]) & (doc[lag:] == doc[:-lag])
                out[doc[first], 2 * DIMENSIONS + lag - 1] = np.add.reduceat(same, first) / n[:, 0]
        return out

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        h = np.maximum((x - self.mean) / self.scale @ w1 + b1, 0)
        return (h @ w2 + b2)[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def _word_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary keys, vectors): random indexing over the training texts."""
    parts, n = [], 0
    for data, offsets in _runs(texts):
        d, k, s = _pieces(data, offsets)
        parts.append(((d + n).astype(np.int32), k, s.astype(np.int16)))
        n += len(offsets) - 1
    doc, key, shape = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    unique, code, count = np.unique(key, return_inverse=True, return_counts=True)
    often = np.argsort(-count, kind="stable")[: min(VOCABULARY, int((count >= 5).sum()))]
    row = np.full(len(unique), -1)
    row[often] = np.arange(len(often)) + N_SHAPES
    at = row[code]
    rows = N_SHAPES + len(often)
    position, sign = index_vectors(unique)
    # A rare neighbour counts by its shape, which has an index vector as well.
    shape_position, shape_sign = index_vectors(np.arange(1, N_SHAPES + 1, dtype=U))
    rare = at < 0
    total = np.zeros(rows * DIMENSIONS)
    for step in (s for d in range(1, WINDOW + 1) for s in (-d, d)):
        here = np.arange(max(0, -step), len(doc) - max(0, step))
        there = here + step
        same = doc[here] == doc[there]
        here, there = here[same], there[same]
        for j in range(NONZERO):
            p = np.where(rare[there], shape_position[shape[there], j], position[code[there], j])
            s = np.where(rare[there], shape_sign[shape[there], j], sign[code[there], j])
            total += np.bincount(shape[here].astype(np.int64) * DIMENSIONS + p, s, len(total))
            own = ~rare[here]
            total += np.bincount(at[here][own] * DIMENSIONS + p[own], s[own], len(total))
    vectors = total.reshape(rows, DIMENSIONS)
    # The piece's own index vector stays in it, so that like contexts remain apart.
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    own = np.zeros_like(vectors)
    for j in range(NONZERO):
        np.add.at(own, (np.arange(N_SHAPES), shape_position[:, j]), shape_sign[:, j] / 2)
        np.add.at(own, (np.arange(len(often)) + N_SHAPES, position[often, j]), sign[often, j] / 2)
    return unique[often], (vectors + own).astype(np.float32)


def _train(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, seed: int = 7) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, 1)), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 128):
            b = order[lo : lo + 128]
            h = np.maximum(x[b] @ layers[0] + layers[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3], -30, 30)))[:, 0] - y[b])[:, None] / len(b)
            back = (d @ layers[2].T) * (h > 0)
            grads = [x[b].T @ back, back.sum(0), h.T @ d, d.sum(0)]
            step += 1
            for i, g in enumerate(grads):
                g = g + 1e-4 * layers[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                layers[i] = layers[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def _temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
    loss = [np.mean(np.logaddexp(0, -np.where(y > 0, 1, -1) * logit / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(texts: list[str], y: np.ndarray) -> Model:
    """Word vectors from all texts, network from four fifths, temperature from the rest."""
    if not texts:
        zero = [np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)]
        return Model(np.zeros(0, U), np.zeros((N_SHAPES, DIMENSIONS), np.float32), np.zeros(FEATURES), np.ones(FEATURES), zero)
    keys, vectors = _word_vectors(texts)
    model = Model(keys, vectors, np.zeros(FEATURES), np.ones(FEATURES), [])
    places = model.places()
    x = np.concatenate([model.pooled(data, offsets, places) for data, offsets in _runs(texts)]).astype(float)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    z = (x - model.mean) / model.scale
    rest = np.arange(len(x)) % _FOLDS == _FOLDS - 1
    model.layers = _train(z[~rest], y[~rest].astype(float))
    if rest.any():
        model.temperature = _temperature(model.logit(x[rest]), y[rest])
    return model


def labelled(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Texts and labels of the training sample: the labelled ids outside fold
    0 with the least hash, at most ``sample_docs``."""
    known = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    some = known.withColumn("_h", F.xxhash64("doc_id"))
    if n > 2 * sample_docs:
        some = some.where(F.col("_h") <= F.lit(int((4 * sample_docs / n - 1) * (1 << 63))))
    ids = some.orderBy("_h").limit(sample_docs).select("doc_id", "quality", "_h")
    rows = docs.select("doc_id", "text").where(F.length("text").between(0, SAMPLE_CHARS)).join(F.broadcast(ids), "doc_id")
    rows = rows.orderBy("_h", "text").limit(sample_docs).select("text", "quality").collect()
    return [r.text for r in rows], np.array([r.quality for r in rows], np.int64)


def quality_scores(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(*labelled(docs, labels, sample_docs)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        places = model.places()
        for b in batches:
            parts = [model.score(model.pooled(data, off, places)) for _, _, data, off in slices(b, "text")]
            score = np.concatenate(parts) if parts else np.zeros(0)
            cols = [b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
