"""Operator 1, WARC fixity audit with Merkle trees (DataFrame functions only).

Every record of an archive file is hashed; records whose offsets fall into the
same fixed byte range form a leaf range, and ``FANOUT`` neighbouring ranges one
node of the next level, up to one root a file.  A node's hash covers its
children's positions and hashes in order.  Two replicas are compared from the
roots down: at each level only the children of nodes that differ are joined,
and only the records of differing leaf ranges are looked at.

Records are hashed and measured where they are read; what is laid out, compared
and shuffled are hashes (``laid_out``, ``audit_hashes``).  ``archive`` and
``audit`` do the same for records that are at hand with their offsets.

Ranges are byte ranges of a file, so a node has a bounded number of children
whatever the size of a file, and no step gathers a whole file.

Defined cases: null record bytes count as empty; several records at one offset
are compared as one ordered list; a file in one replica only is missing or
extra record by record; empty replicas give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, written
from .merkle_manifest import positions

SPAN = 1 << 18
FANOUT = 16
PAGES_PER_FILE = 512
#: Records whose lengths are summed one after the other.
BLOCK = 4096


def warc_record(url: Column, html: Column) -> Column:
    """A WARC/1.0 response record of a page."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def archive(pages: DataFrame, per_file: int = PAGES_PER_FILE) -> DataFrame:
    """file, offset, record, page_id: the pages laid out in archive files of
    ``per_file`` consecutive ids (rows without an id are dealt out by content)."""
    rows = pages.select("page_id", warc_record(F.col("url"), F.col("html")).alias("record"))
    rows = rows.withColumn(
        "file",
        F.coalesce(F.expr(f"page_id div {per_file}"), F.lit(-1) - F.pmod(F.xxhash64("record"), F.lit(4096))).cast("long"),
    )
    size = F.octet_length("record").cast("long")
    before = W.partitionBy("file").orderBy("page_id", F.xxhash64("record")).rowsBetween(W.unboundedPreceding, -1)
    return rows.select("file", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("offset"), "record", "page_id")


def measured(records: DataFrame, copies: list[str]) -> DataFrame:
    """page_id, ``_n`` (a number per row) and, for each named column of record
    texts, a struct(length, sha), null where the record is missing; written, so
    that every use sees one numbering."""
    thin = [F.when(F.col(c).isNotNull(), F.struct(F.octet_length(c).cast("long").alias("length"), F.sha2(c, 256).alias("sha"))).alias(c) for c in copies]
    return written(records.select("page_id", F.monotonically_increasing_id().alias("_n"), *thin), "measured-records")


def laid_out(thin: DataFrame, by: str, per_file: int = PAGES_PER_FILE) -> DataFrame:
    """``thin`` with file and offset: files of ``per_file`` consecutive ids,
    records in the order of id and hash; lengths are those of column ``by``
    (a missing record has none).  Rows without an id are dealt out over as many
    files of their own as they fill.  A file may hold any number of rows (of a
    repeated id): lengths are summed in blocks of rows."""
    lone = thin.where(F.col("page_id").isNull()).count()
    dealt = F.lit(-1) - F.pmod(F.xxhash64("_n"), F.lit(max(1, lone // per_file)))
    rows = thin.withColumn("file", F.coalesce(F.expr(f"page_id div {per_file}"), dealt).cast("long"))
    rows = rows.withColumn("_sha", F.col(f"{by}.sha")).withColumn("_size", F.coalesce(F.col(f"{by}.length"), F.lit(0).cast("long")))
    rows = positions(rows, "file", ["page_id", "_sha", "_n"]).withColumn("_block", F.expr(f"idx div {BLOCK}"))
    rows = written(rows, "placed-records")
    ends = W.partitionBy("file").orderBy("_block")
    sums = rows.groupBy("file", "_block").agg(F.sum("_size").alias("_sum"))
    sums = sums.select("file", "_block", (F.sum("_sum").over(ends) - F.col("_sum")).alias("_before"))
    inside = W.partitionBy("file", "_block").orderBy("idx")
    rows = rows.withColumn("_inside", F.sum("_size").over(inside) - F.col("_size")).join(sums, ["file", "_block"])
    return rows.select(*thin.columns, "file", (F.col("_before") + F.col("_inside")).alias("offset"))


def hashes_of(laid: DataFrame, copy: str) -> DataFrame:
    """file, offset, length, sha of one of the measured columns."""
    return laid.where(F.col(copy).isNotNull()).select("file", "offset", f"{copy}.length", f"{copy}.sha")


def record_hashes(records: DataFrame) -> DataFrame:
    """file, offset, length, sha: one row per offset."""
    record = F.coalesce(F.col("record"), F.lit(""))
    rows = records.select("file", "offset", F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("sha"))
    return rows.groupBy("file", "offset").agg(
        F.sum("length").alias("length"), F.array_join(F.sort_array(F.collect_list("sha")), "+").alias("sha")
    )


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.collect_list(parts)), "\n"), 256)


def _ordered(position: str) -> Column:
    """A child's line: its position, wide enough to sort as text, and its hash."""
    return F.concat_ws(":", F.lpad(F.col(position).cast("string"), 20, "0"), "sha")


def levels(largest_offset: int, span: int = SPAN, fanout: int = FANOUT) -> int:
    """Levels above the leaf ranges until one node holds the largest offset."""
    n, nodes = 0, largest_offset // span + 1
    while nodes > 1:
        nodes, n = -(-nodes // fanout), n + 1
    return n


def tree(hashes: DataFrame, height: int, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """level, file, idx, sha of all nodes; written by level."""
    line = F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 20, "0"), "length", "sha")
    node = hashes.groupBy("file", F.expr(f"offset div {span}").alias("idx")).agg(_digest(line).alias("sha"))
    path = scratch(hashes.sparkSession, "merkle")
    spark = hashes.sparkSession
    for level in range(height + 1):
        if level:
            below = spark.read.parquet(f"{path}/level={level - 1}")
            node = below.groupBy("file", F.expr(f"idx div {fanout}").alias("idx")).agg(_digest(_ordered("idx")).alias("sha"))
        node.select("file", "idx", "sha").write.parquet(f"{path}/level={level}")
    return spark.read.schema("file bigint, idx bigint, sha string, level int").parquet(path)


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hashes differ or stand on one side only."""
    both = a.select(*keys, F.col("sha").alias("sha_a")).join(b.select(*keys, F.col("sha").alias("sha_b")), keys, "full_outer")
    return both.where(~F.col("sha_a").eqNullSafe(F.col("sha_b")))


def audit(primary: DataFrame, replica: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """Damaged records of two archives (file, offset, record): file, offset,
    range_idx, kind (changed, missing or extra in the replica), length, sha,
    replica_length, replica_sha."""
    return audit_hashes(record_hashes(primary), record_hashes(replica), span, fanout)


def audit_hashes(primary: DataFrame, replica: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """``audit`` of two archives given as hashes: file, offset (once each), length, sha."""
    a, b = (written(r, "record-hashes") for r in (primary, replica))
    most = a.select("offset").unionByName(b.select("offset")).agg(F.max("offset")).first()[0]
    height = levels(most or 0, span, fanout)
    ta, tb = tree(a, height, span, fanout), tree(b, height, span, fanout)
    at = lambda t, level: t.where(F.col("level") == level).select("file", "idx", "sha")
    open_ = _differing(at(ta, height), at(tb, height), ["file", "idx"]).select("file", "idx")
    for level in range(height - 1, -1, -1):
        parents = written(open_.select("file", F.col("idx").alias("_parent")), "open-nodes")
        down = lambda t: at(t, level).withColumn("_parent", F.expr(f"idx div {fanout}")).join(parents, ["file", "_parent"], "left_semi")  # noqa: B023, E731
        open_ = _differing(down(ta), down(tb), ["file", "idx"]).select("file", "idx")
    ranges = written(open_.select("file", F.col("idx").alias("range_idx")), "open-ranges")
    leaves = lambda h: h.withColumn("range_idx", F.expr(f"offset div {span}")).join(ranges, ["file", "range_idx"], "left_semi")
    x = leaves(a)
    y = leaves(b).select("file", "range_idx", "offset", F.col("length").alias("replica_length"), F.col("sha").alias("replica_sha"))
    out = x.join(y, ["file", "range_idx", "offset"], "full_outer")
    out = out.where(~F.col("sha").eqNullSafe(F.col("replica_sha")) | ~F.col("length").eqNullSafe(F.col("replica_length")))
    kind = F.when(F.col("replica_sha").isNull(), "missing").when(F.col("sha").isNull(), "extra").otherwise("changed")
    return out.select("file", "offset", "range_idx", kind.alias("kind"), "length", "sha", "replica_length", "replica_sha")


def roots(records: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """file and root hash of an archive, for publication beside it."""
    h = written(record_hashes(records), "record-hashes")
    height = levels(h.agg(F.max("offset")).first()[0] or 0, span, fanout)
    return tree(h, height, span, fanout).where(F.col("level") == height).select("file", F.col("sha").alias("root"))


def aged(page_id: Column, record: Column) -> Column:
    """A record's copy with damage at known places, for a scrub drill: by page_id
    some are gone (null), some have one character changed, some are cut short."""
    changed = F.overlay(record, F.lit("\u0000"), F.lit(25))
    cut = F.substring(record, F.lit(1), F.length(record) - 3)
    copy = F.when(F.pmod(page_id, F.lit(499)) == 7, changed).when(F.pmod(page_id, F.lit(1009)) == 11, cut).otherwise(record)
    return F.when(F.coalesce(F.pmod(page_id, F.lit(997)) != 5, F.lit(True)), copy)


def aged_replica(records: DataFrame) -> DataFrame:
    """The damaged copy of an archive (file, offset, record, page_id)."""
    copy = records.select("file", "offset", aged(F.col("page_id"), F.coalesce(F.col("record"), F.lit(""))).alias("record"), "page_id")
    return copy.where(F.col("record").isNotNull())


def scrub_drill(pages: DataFrame) -> DataFrame:
    """``audit`` of the archive of pages against its aged copy.  The records are
    read once, hashed with their copies there, and never shuffled."""
    record = warc_record(F.col("url"), F.col("html"))
    both = pages.select("page_id", record.alias("record")).withColumn("copy", aged(F.col("page_id"), F.col("record")))
    laid = written(laid_out(measured(both, ["record", "copy"]), "record"), "laid-out")
    return audit_hashes(hashes_of(laid, "record"), hashes_of(laid, "copy"))
