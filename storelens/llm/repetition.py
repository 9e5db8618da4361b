"""Operator 2, quality rules: repetition coverage.

Rolling hashes of several n-gram lengths in numpy measure, per text, the
characters inside n-grams and lines that repeat an earlier one of the same
text.  A single Arrow pass per partition, no shuffle.

Defined cases: a null or empty text has no words and fails the base rule;
rows are judged one by one, so repeated rows get equal results; other columns
of the input pass through ``filter_repetitive`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship
from .textbatch import U, Words, mix, per_doc, repeats, slices

#: Largest share of word characters inside repeated n-grams, by n-gram length.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of word characters inside repeated lines.
LINE_LIMIT = 0.30
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _covered(at: np.ndarray, n: int, n_words: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Per-text counts of one slice of texts."""
    w = Words(data, offsets)
    n = w.n_docs
    point = (data & 0xC0) != 0x80  # one per code point
    chars = np.concatenate(([0], np.cumsum(point & w.inside)))
    word_chars = chars[w.end] - chars[w.start]
    out = {
        "n_words": w.count,
        "word_chars": chars[offsets[1:]] - chars[offsets[:-1]],
        "n_symbols": per_doc(_SYMBOL[data], offsets),
    }
    # Lines: between line feeds and the ends of the texts.
    feeds = np.flatnonzero(data == 10)
    line_start = np.union1d(offsets[:-1][offsets[1:] > offsets[:-1]], feeds + 1)
    line_start = line_start[line_start < len(data)]
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    ends = np.append(feeds, len(data))
    line_end = np.minimum(ends[np.searchsorted(ends, line_start)], offsets[line_doc + 1])
    full = chars[line_end] > chars[line_start]
    line_start, line_end, line_doc = line_start[full], line_end[full], line_doc[full]
    key = mix(w.bytes(line_start, line_end) + line_doc.astype(U) * U(0xD6E8FEB86659FD93))
    _, again = repeats(key)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n)
    out["dup_line_chars"] = np.bincount(
        line_doc[again], weights=(chars[line_end] - chars[line_start])[again], minlength=n
    ).astype(np.int64)
    # Windows of three words; only where those repeat can longer ones repeat.
    total = len(w.start)
    salt = w.doc.astype(U) * U(0xD6E8FEB86659FD93)
    at, h = w.windows(3)
    both, _ = repeats(mix(h + salt[at]))
    out["n_repeat_words"] = np.bincount(w.doc[_covered(at[both], 3, total)], minlength=n)
    run = np.zeros(total + 1, bool)
    run[at[both]] = True
    size = 3
    for length in sorted(NGRAM_LIMITS):
        at, h = w.windows(length)
        keep = np.ones(len(at), bool)
        for shift in range(length - size + 1):
            keep &= run[at + shift]
        at, h = at[keep], h[keep]
        both, again = repeats(mix(h + salt[at]))
        run[:] = False
        run[at[both]] = True
        size = length
        cover = _covered(at[again], length, total)
        out[f"dup_chars_{length}"] = np.bincount(w.doc[cover], weights=word_chars[cover], minlength=n).astype(np.int64)
    return out


def verdict(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """``base_failed`` and ``kept`` of the measured texts (integer arithmetic)."""
    words = m["n_words"]
    m["base_failed"] = (words < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * words)
    bad = 100 * m["dup_line_chars"] > round(100 * LINE_LIMIT) * m["word_chars"]
    for length, limit in NGRAM_LIMITS.items():
        bad = bad | (100 * m[f"dup_chars_{length}"] > round(100 * limit) * m["word_chars"])
    m["kept"] = ~m["base_failed"] & ~bad
    return m


LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "dup_line_chars", *[f"dup_chars_{n}" for n in sorted(NGRAM_LIMITS)]]


def _measured(batch: pa.RecordBatch, text: str) -> dict[str, np.ndarray]:
    parts = [verdict(measures(data, off)) for _, _, data, off in slices(batch, text)]
    names = [*LONGS, *MORE, "base_failed", "kept"]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in names}


def repetition_coverage(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per text: id, the measures, ``base_failed`` and ``kept``."""
    schema = T.StructType(
        [T.StructField(doc_id, docs.schema[doc_id].dataType)]
        + [T.StructField(c, T.LongType()) for c in LONGS]
        + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
        + [T.StructField(c, T.LongType()) for c in MORE]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _measured(b, text)
            cols = [b.column(b.schema.get_field_index(doc_id))]
            for f in schema.fields[1:]:
                kind = pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int64()
                cols.append(pa.array(m[f.name].astype(bool if kind == pa.bool_() else np.int64), kind))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    ship(docs.sparkSession)
    return docs.select(doc_id, text).mapInArrow(run, schema)


def filter_repetitive(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text is kept, all columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_measured(b, text)["kept"].astype(bool)))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
