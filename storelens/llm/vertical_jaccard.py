"""Operator 7, n-gram Jaccard join by vertical partitioning.

A document's set holds its distinct shingles of some words as 64-bit values.  Their
global order is by hash, with shingles seen to be common put last; ranges of it
are the vertical partitions (``FRAGMENTS``).  Sets are cut into those
fragments, a candidate pair's overlaps are counted fragment by fragment in
separate rows, and the partial counts are summed per pair and held against the
threshold.

Candidates, none lost:

* equal sets are one class; only classes are paired.
* linked sets share ``SHARED`` n-grams (or their least possible overlap, if that
  is less) within the first n - ceil(t n) + SHARED ones of each, and the position of the first n-gram they share bounds their
  overlap, which rules most others out.
* n-grams in at most ``SMALL`` prefixes give their pairs directly, counted per
  pair; a pair that shares fewer of those stays a candidate only
  if both classes also have an n-gram of a larger group.
* every pair is held against counts of each set's n-grams in ``COUNTS`` narrower
  fragments: the summed differences bound the overlap from above, exactly, so
  pairs that share n-grams by chance end there.
* a larger group is first joined as a star (all with its best member).  After
  those links are known, only members of different components are paired, and
  only where sizes and positions allow a link.  No group is ever expanded into
  all its pairs, and none is cut.

Which shingles count as common only shapes the order, not the result, so they
may be counted where they meet: within a task, then summed.

Defined cases: null, empty or blank text has an empty set, links with nothing
and is its own component; fewer words than a shingle has make one shingle; equal rows
link; null doc_ids are skipped in the least doc_id (null if there is no other).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, small, text_key, unpacked, whole_rows, written
from .components import components
from .textbatch import RangeHash, U, Words, slices

#: Near-duplicate stages: five-word shingles, similarity of 0.8 or more.
WORDS = 5
PERCENT = 80
FRAGMENTS = 4
COUNTS = 256
#: N-grams that a pair shares within its prefixes at least (small sets: see _shared).
SHARED = 3
#: Groups up to this size are paired directly.
SMALL = 32
#: Common shingles: seen so often, counting tasks' runs of COUNTED shingles in
#: which they occur twice or more; the COMMON_MOST most frequent ones (8 bytes
#: each) are broadcast to order the sets by.
COMMON = 16
COMMON_MOST = 1_000_000
COUNTED = 2_000_000


def _shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(document, 63-bit hash) of every shingle, and the number of texts."""
    w = Words(data, offsets, fold_case=True)
    at, h = w.windows(words)
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < words))
    if len(short):
        doc = np.concatenate((doc, short))
        h = np.concatenate((h, RangeHash(w.hash)(w.first[short], w.first[short + 1])))
    return doc, h >> U(1), w.n_docs


def common_shingles(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the common shingles, at most ``COMMON_MOST``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_pydict({"s": value[n > 1].view(np.int64), "n": n[n > 1]})

        for b in batches:
            for _, _, data, offsets in slices(b, "text"):
                held.append(_shingles(data, offsets, words)[1])
                if sum(map(len, held)) >= COUNTED:
                    yield counted()
        if held:
            yield counted()

    ship(docs.sparkSession)
    seen = docs.select("text").mapInArrow(run, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    seen = written(seen, "common-shingles")
    if seen.count() > COMMON_MOST:
        seen = seen.orderBy(F.desc("n"), "s").limit(COMMON_MOST)
    return np.sort(seen.select("s").toPandas()["s"].to_numpy(np.int64).view(U))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, common: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, bounds, class): each text's distinct shingles, in the global
    order, lie between its bounds; class is a hash of the whole set."""
    doc, h, n_docs = _shingles(data, offsets, words)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h = h | ((common[at] == h).astype(U) << U(63))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[keep], h[keep]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n_docs))))
    return h, bounds, RangeHash(h)(bounds[:-1], bounds[1:])


def _needed(n, percent: int):
    """Least overlap of a set of n with any partner: ceil(percent n / 100)."""
    return (percent * n + 99) // 100


def _shared(na: Column, nb: Column, percent: int) -> Column:
    """N-grams that linked sets of these sizes share within their prefixes at least."""
    return F.least(F.lit(SHARED), F.ceil(F.greatest(na, nb) * percent / 100).cast("int"))


def _least_size(percent: int) -> int:
    """Smaller sets differ by too much from any other set."""
    return max(1, -(-percent // (100 - percent)))


def _lists(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    take = np.arange(total) + np.repeat(start - (ends - size), size)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values[take].view(np.int64)))


def document_sets(docs: DataFrame, common: Broadcast, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, _th, cid (class), n (set size), prefix (its first n-grams),
    counts (n-grams by their last bits, saturated); written once."""
    ship(docs.sparkSession)
    kind, least = docs.schema["doc_id"].dataType.simpleString(), _least_size(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in slices(b, "text"):
                h, at, cid = shingle_sets(data, offsets, common.value, words)
                n = np.diff(at)
                size = np.where(n >= least, np.minimum(n, n - _needed(n, percent) + SHARED), 0)
                cell = np.repeat(np.arange(len(n)), n) * COUNTS + (h % U(COUNTS)).astype(np.int64)
                counts = np.minimum(np.bincount(cell, minlength=len(n) * COUNTS), 127).astype(np.int8)
                counts = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * COUNTS), pa.array(counts))
                cols = [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(cid.view(np.int64)), pa.array(n), _lists(h, at[:-1], size), counts]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "_th", "cid", "n", "prefix", "counts"])

    rows = text_key(docs)
    return written(rows.mapInArrow(run, f"doc_id {kind}, _th bigint, cid bigint, n bigint, prefix array<bigint>, counts array<tinyint>"), "sets")


def fragments(docs: DataFrame, sets: DataFrame, wanted: DataFrame, common: Broadcast, words: int = WORDS) -> DataFrame:
    """cid, frag, n, tokens: the sets of the wanted classes (cid), each made
    again from one of its documents and cut into the vertical partitions;
    written once."""
    width = U(64 - (FRAGMENTS - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in slices(b, "text"):
                h, at, cid = shingle_sets(data, offsets, common.value, words)
                n = np.diff(at)
                doc = np.repeat(np.arange(len(n)), n)
                size = np.bincount(doc * FRAGMENTS + (h >> width).astype(np.int64), minlength=len(n) * FRAGMENTS)
                start = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
                cols = [pa.array(np.repeat(cid.view(np.int64), FRAGMENTS)), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(n))), pa.array(np.repeat(n, FRAGMENTS)), _lists(h, start, size)]
                yield pa.RecordBatch.from_arrays(cols, names=["cid", "frag", "n", "tokens"])

    place = sets.join(small(wanted), "cid", "left_semi").groupBy("cid").agg(F.min(F.struct("doc_id", "_th")).alias("p"))
    key = small(written(place.select(F.col("p.doc_id").alias("_id"), F.col("p._th").alias("_h")).distinct(), "wanted"))
    rows = text_key(docs)
    rows = rows.join(key, (rows["_th"] == key["_h"]) & rows["doc_id"].eqNullSafe(key["_id"]), "left_semi").select("text")
    out = rows.mapInArrow(run, "cid bigint, frag int, n bigint, tokens array<bigint>")
    return written(out, "fragments")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _can_reach(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Whether sets whose first common n-gram stands at these positions can link."""
    most = F.least(na - pa_, nb - pb)
    return F.lit(100) * most >= F.lit(percent) * (na + nb - most)


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _group_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs within the (small) groups of each token, with repeats: a, b, hot
    (both belong to a large group too), fit (sizes and positions allow a link),
    least (n-grams that they have to share)."""
    groups = entries.groupBy("token").agg(F.collect_list(F.struct("cid", "n", "pos", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("m"))
    one = groups.select("m", F.explode("m").alias("x")).select("x", F.explode(F.filter("m", lambda y: (y["cid"] > F.col("x.cid")) & _sizes_fit(F.col("x.n"), y["n"], percent))).alias("y"))
    fit = _can_reach(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent)
    return one.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), (F.col("x.hot") & F.col("y.hot")).alias("hot"), fit.alias("fit"), _shared(F.col("x.n"), F.col("y.n"), percent).alias("least"))


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose fragment counts differ by no more than a link allows."""
    left = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    right = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"))
    apart = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, d: s + d)
    both = pairs.join(left, "a").join(right, "b")
    return both.where(F.lit(100 + percent) * apart <= F.lit(100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b")


def linked(pairs: DataFrame, frags: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlap, summed over the fragments, links them."""
    left = frags.select(F.col("cid").alias("a"), "frag", F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = frags.select(F.col("cid").alias("b"), "frag", F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    partial = pairs.join(left, "a").join(right, ["b", "frag"]).select("a", "b", "frag", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("o"))
    # A class made from several equal rows has each fragment as often; it counts once.
    once = partial.groupBy("a", "b", "frag", "na", "nb").agg(F.max("o").alias("o"))
    total = once.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where(F.lit(100) * F.col("o") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _across_components(big: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of a large group's members that lie in different components and
    can link, found by cells of equal size and position."""
    e = big.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    e = written(e.select("token", "n", "pos", "cid", "root"), "large-groups")
    cell = e.groupBy("token", "n", "pos").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    x = cell.select("token", *[F.col(c).alias(f"{c}1") for c in ("n", "pos", "lo", "hi")])
    y = cell.select("token", *[F.col(c).alias(f"{c}2") for c in ("n", "pos", "lo", "hi")])
    c = x.join(y, "token").where(
        (F.struct("n1", "pos1") <= F.struct("n2", "pos2"))
        & (F.least("lo1", "lo2") != F.greatest("hi1", "hi2"))
        & _sizes_fit(F.col("n1"), F.col("n2"), percent)
        & _can_reach(F.col("n1"), F.col("pos1"), F.col("n2"), F.col("pos2"), percent)
    )
    one = e.select("token", F.col("n").alias("n1"), F.col("pos").alias("pos1"), F.col("cid").alias("c1"), F.col("root").alias("r1"))
    two = e.select("token", F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("cid").alias("c2"), F.col("root").alias("r2"))
    both = c.join(one, ["token", "n1", "pos1"]).join(two, ["token", "n2", "pos2"]).where("r1 <> r2")
    return both.select(*_pair(F.col("c1"), F.col("c2"))).distinct()


def class_links(docs: DataFrame, sets: DataFrame, common: Broadcast, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(links, roots): verified links (a, b) that join the classes, and (node,
    root) of every linked class."""
    classes = written(sets.where(F.col("n") >= _least_size(percent)).groupBy("cid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("counts").alias("counts")), "classes")
    entries = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "token"))
    counts = entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # The counts are the smaller side and already dealt by token: hashing them spares sorting the entries.
    entries = written(entries.join(counts.hint("shuffle_hash"), "token").select("token", "cid", "n", "pos", "c"), "shared-prefixes")
    large = written(entries.where(F.col("c") > SMALL).select("cid").distinct().withColumn("hot", F.lit(True)), "classes-of-large-groups")

    few = entries.where(F.col("c") <= SMALL).join(small(large), "cid", "left")
    # Later shared n-grams count too: they may stand SHARED - 1 places behind the first.
    few = _group_pairs(few, percent)
    few = few.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.max("hot").alias("hot"), F.max("fit").alias("fit"), F.max("least").alias("least"))
    few = few.where(F.col("fit") & ((F.col("k") >= F.col("least")) | F.col("hot"))).select("a", "b")
    big = entries.where(F.col("c") > SMALL).drop("c")
    best = big.groupBy("token").agg(F.min(F.struct("pos", "cid", "n")).alias("best"))
    fits = _sizes_fit(F.col("best.n"), F.col("n"), percent) & _can_reach(F.col("best.n"), F.col("best.pos"), F.col("n"), F.col("pos"), percent)
    star = big.join(best, "token").where((F.col("cid") != F.col("best.cid")) & fits)
    star = star.select(*_pair(F.col("cid"), F.col("best.cid")))
    pairs = written(_possible(few.unionByName(star).distinct(), classes, percent), "pairs")

    links = written(linked(pairs, fragments(docs, sets, _members(pairs), common, words), percent), "links")
    roots = components(links)
    more = _across_components(big, roots, percent).join(pairs, ["a", "b"], "left_anti")
    more = written(_possible(more, classes, percent), "late-pairs")
    if not more.isEmpty():
        links = links.unionByName(written(linked(more, fragments(docs, sets, _members(more), common, words), percent), "late-links"))
        roots = components(links)
    return links, roots


def _members(pairs: DataFrame) -> DataFrame:
    return written(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "members")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id
    reachable by links), root (names the component; null for an empty set) and
    _th (hash of the text)."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))
    sets = document_sets(docs, common, words, percent)
    _, roots = class_links(docs, sets, common, words, percent)
    least = sets.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"))
    least = least.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    whole = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = written(least.join(whole, "root").select("cid", "component_id", "root"), "class-components")
    rows = sets.select("doc_id", "_th", F.col("n").alias("n_shingles"), "cid")
    out = rows.where("n_shingles > 0").join(of_class, "cid").select("doc_id", "n_shingles", "component_id", "root", "_th")
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("root"), "_th")
    return out.unionByName(empty)


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one of the least doc_id (of equal
    rows one); documents with an empty set all stay.  Columns unchanged."""
    c = written(jaccard_components(docs, words, percent), "near-duplicates").where("n_shingles > 0")
    out = small(c.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_out"), F.col("_th").alias("_h")).distinct())
    # Rows that repeat the kept id: their texts may differ, one of them stays.
    first = c.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    again = first.groupBy("doc_id", "root").agg(F.count(F.lit(1)).alias("k"), F.collect_set("_th").alias("_ths")).where("k > 1")
    again = small(written(again.select(F.col("doc_id").alias("_again"), "_ths", F.array_min("_ths").alias("_keep")), "repeated-ids"))
    rows = whole_rows(docs)
    kept = rows.join(out, (rows["_th"] == out["_h"]) & rows["_id"].eqNullSafe(out["_out"]), "left_anti")
    same = kept["_id"].eqNullSafe(again["_again"]) & F.array_contains(again["_ths"], kept["_th"])
    once = kept.join(again, same, "left_anti")
    repeated = kept.join(again, same & (kept["_th"] == again["_keep"]), "left_semi").dropDuplicates(["_id", "_th"])
    return unpacked(once.unionByName(repeated), docs.columns)
