"""Operator 9, benchmark decontamination (DataFrame functions only).

The benchmark's normalised 10-word windows become a hash set that is broadcast
to the scan of the training documents; every window of every document is
looked up, hits are verified word by word, and documents or the hit spans can
be removed.  The set is broadcast only when its counted rows and their size
(words and item ids: a window may lie in very many items) stay under limits; beyond them the same join shuffles (windows are spread by their hash, and
each document's own row by its key, so no key gathers the documents).

Words: A-Z lowered, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A benchmark item
of fewer than 10 words, but not none, is one window.

Defined cases: null or empty text has no words and no hits; a null item_id
counts as the empty string; rows repeating an item_id share it; rows with equal
id and text give one result each; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, text_key, unpacked, whole_rows, written

WINDOW = 10
#: Windows that are broadcast at most, and bytes of their words and item ids (with 16 bytes for each of these).
BROADCAST_WINDOWS = 500_000
BROADCAST_BYTES = 128 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: k (words), wh (hash), gram (the words), items (ids as strings)."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), _words(F.col("text")).alias("ws"))
    w = w.where(F.size("ws") > 0).withColumn("k", F.least(F.size("ws"), F.lit(window)))
    w = w.withColumn("p", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("k") + 1)))
    gram = w.select("item", "k", F.slice("ws", F.col("p"), F.col("k")).alias("gram"))
    hashed = gram.withColumn("wh", F.xxhash64(F.transform("gram", lambda x: F.xxhash64(x))))
    return hashed.groupBy("k", "wh", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _size(parts: str) -> Column:
    """Bytes of an array of strings as it is held in a row."""
    return F.octet_length(F.array_join(parts, "")).cast("long") + 16 * F.size(parts)


def hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per distinct (doc_id, text): _th, copies, n_words, spans (sorted array of
    first word and end, from 1), items (sorted ids as strings)."""
    grams = written(benchmark_windows(benchmark, window), "windows")
    # One row: at most ``window`` lengths, and what the set weighs.
    held = grams.agg(F.sort_array(F.collect_set("k")).alias("ks"), F.count(F.lit(1)).alias("n"), F.sum(_size("gram") + _size("items")).alias("size")).first()
    lengths = held["ks"] or [window]
    d = text_key(docs).withColumn("ws", _words(F.col("text"))).drop("text")
    d = d.withColumn("n_words", F.size("ws")).withColumn("hs", F.transform("ws", lambda x: F.xxhash64(x)))
    # Position 0 is the document's own row; it never matches.
    d = d.withColumn("p", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n_words") - lengths[0] + 1))))
    d = d.withColumn("k", F.lit(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*[F.lit(k) for k in lengths])))
    if len(lengths) > 1:
        d = d.where((F.col("p") + F.col("k") - 1 <= F.col("n_words")) | ((F.col("p") == 0) & (F.col("k") == lengths[0])))
        d = d.where((F.col("p") > 0) | (F.col("k") == lengths[0]))
    own = F.col("p") == 0
    d = d.withColumn("wh", F.when(own, F.col("_th")).otherwise(F.xxhash64(F.slice("hs", F.greatest(F.col("p"), F.lit(1)), F.col("k")))))
    d = d.withColumn("k", F.when(own, 0).otherwise(F.col("k")))
    g, words = grams.select("wh", "k", "gram", "items"), F.slice("ws", F.greatest(F.col("p"), F.lit(1)), F.col("k"))
    if held["n"] <= broadcast_windows and (held["size"] or 0) <= broadcast_bytes:
        # The set goes to the documents; only hits have their words cut out.
        found = d.select("doc_id", "_th", "n_words", "p", "k", "wh", "ws").join(F.broadcast(g), ["wh", "k"], "left")
    else:
        # Windows go to the set, each with its own words instead of the document's.
        found = d.select("doc_id", "_th", "n_words", "p", "k", "wh", words.alias("dw")).join(g, ["wh", "k"], "left")
        words = F.col("dw")
    found = found.where((F.col("p") == 0) | (F.col("gram").isNotNull() & (words == F.col("gram"))))
    return found.groupBy("doc_id", "_th").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(F.col("p") == 0, 1)).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("p") > 0, F.struct("p", (F.col("p") + F.col("k")).alias("e"))))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("p") > 0, F.col("items")))))).alias("items"),
    )


def _n_hit(spans: Column) -> Column:
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("last"))
    total = F.aggregate(
        spans,
        start,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["p"], a["last"]))).alias("n"),
            F.greatest(a["last"], x["e"]).alias("last"),
        ),
    )
    return total["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    h = hits(docs, benchmark, window).withColumn("n_hit", _n_hit(F.col("spans")).cast("long"))
    h = h.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return h.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a benchmark window, columns unchanged."""
    bad = written(hits(docs, benchmark, window).where(F.size("spans") > 0).select("doc_id", "_th"), "contaminated")
    bad = small(bad.select(F.col("doc_id").alias("_bad"), F.col("_th").alias("_h")))
    rows = whole_rows(docs)
    return unpacked(rows.join(bad, (rows["_th"] == bad["_h"]) & rows["_id"].eqNullSafe(bad["_bad"]), "left_anti"), docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents, without the hit words and what separates each from the next word."""
    bad = written(hits(docs, benchmark, window).where(F.size("spans") > 0).select("doc_id", "_th", "spans"), "hit-spans")
    bad = small(bad.select(F.col("doc_id").alias("_bad"), F.col("_th").alias("_h"), F.col("spans").alias("_spans")))
    rows = whole_rows(docs)
    j = rows.join(bad, (rows["_th"] == bad["_h"]) & rows["_id"].eqNullSafe(bad["_bad"]), "left")
    text = F.col("_row.text")
    words = F.regexp_extract_all(text, F.lit(_WORD_ANY_CASE), F.lit(0))
    gaps = F.split(text, _WORD_ANY_CASE, -1)
    after = F.transform(
        F.arrays_zip(words.alias("w"), F.slice(gaps, F.lit(2), F.size(words)).alias("g")),
        lambda x, i: F.struct(F.concat(x["w"], x["g"]).alias("t"), (i + 1).alias("i")),
    )
    kept = F.filter(after, lambda x: ~F.exists(F.col("_spans"), lambda s: (s["p"] <= x["i"]) & (x["i"] < s["e"])))
    rest = F.concat(F.element_at(gaps, 1), F.array_join(F.transform(kept, lambda x: x["t"]), ""))
    return unpacked(j, docs.columns, F.when(F.col("_spans").isNull(), text).otherwise(rest))
