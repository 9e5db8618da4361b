"""Sinks: change-detecting publication and the row preview (SNK-1, SNK-2).

``publish_if_changed`` re-aims the reference's "copy the workbook and push
it only when it differs" onto rows: the new data is compared with the
latest published version as a multiset, and written as a new version
directory only when it changed.  Versions are immutable; readers take the
newest complete one (Spark's commit protocol writes ``_SUCCESS`` last).  A job
lost half-way leaves a folder without that marker; the next version takes a
higher number.

Comparing shuffles whole rows, several times what they take as a written
table.  Large versions are compared part by part, equal rows in the same part,
and the shuffle files of a part are gone before the next one begins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffles_freed
from .readers import _FS

_VERSION = re.compile(r"^version=(\d+)$")
# Written bytes behind each part that is shuffled on its own.
PART_BYTES = 64 << 20
# Every part reads all rows again, so parts are as few as keep the shuffle files of one below about twice
# the table: moving its rows once takes two to three times the table, comparing two versions seven.
MOVED_PARTS = 2
COMPARED_PARTS = 5


def part_count(size: int, most: int) -> int:
    """Parts for a table of ``size`` bytes."""
    return max(1, min(most, -(-size // PART_BYTES)))


def _hash(columns: list[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def parts(df: DataFrame, n: int, by: list[str] | None = None) -> list[DataFrame]:
    """The rows of ``df`` in ``n`` parts that together hold each row once, equal
    rows in the same part, dealt out by the values of ``by`` (null is a value as
    well).  By default these are the numbers and dates, whose hash is cheap and
    leaves the text of other parts unread, or all columns where there are none;
    few distinct values make uneven parts, not wrong ones."""
    if n == 1:
        return [df]
    fixed = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.DatetimeType))]
    part = F.pmod(_hash(by or fixed or df.columns), F.lit(n))
    return [df.where(part == i) for i in range(n)]


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free multiset fingerprint: row count and the sum of a 64-bit
    row hash, summed as decimal(38,0) so it cannot overflow."""
    h = _hash(df.columns).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").alias("digest"))


def _fingerprint_of(found: list[DataFrame]) -> tuple[int, int]:
    """The fingerprint of the rows of all parts: both its numbers add up."""
    rows = [fingerprint(p).first() for p in found]
    return sum(r["rows"] for r in rows), sum(int(r["digest"]) for r in rows)


def column_digests(df: DataFrame) -> DataFrame:
    """What a table holds, in a form that another engine can compute as well: one
    row per column and one for whole rows (``column`` null), with the non-null
    values (whole rows: all) and the sum of the first 60 bits of each value's
    md5 as text.  Order-free; equal values count each time.  Values are hashed
    as text, whole rows as ``length:value`` or ``-`` for null, joined.

    One aggregate, whose result is one row however large the table; where two
    versions differ, the columns with other digests are those that changed.
    Each value is hashed once, in a projection; its bits are summed as three
    integers of 20 bits (which overflow at 2**43 rows, not before), and only the
    three totals become one decimal."""
    text = {c: F.col(f"`{c}`").cast("string") for c in df.columns}
    row = F.concat(F.lit(""), *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text.values()])

    def bits(value):
        return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("bigint")

    names = [None, *text]
    hashed = df.select(*[bits(v).alias(f"b{i}") for i, v in enumerate([row, *text.values()])])
    sums = [F.sum(F.shiftright(f"b{i}", 20 * k).bitwiseAND(F.lit(0xFFFFF))).alias(f"s{i}_{k}") for i in range(len(names)) for k in range(3)]
    one = hashed.agg(*[F.count(f"b{i}").alias(f"n{i}") for i in range(len(names))], *sums)

    def digest(i):
        part = lambda k: F.coalesce(F.col(f"s{i}_{k}"), F.lit(0)).cast("decimal(20,0)") * F.lit(1 << 20 * k).cast("decimal(13,0)")
        return (part(2) + part(1) + part(0)).cast("decimal(38,0)").cast("string")

    rows = [F.struct(F.lit(c).cast("string").alias("column"), F.col(f"n{i}").alias("filled"), digest(i).alias("digest")) for i, c in enumerate(names)]
    return one.select(F.inline(F.array(*rows)))


def multiset_equal(a: DataFrame, b: DataFrame) -> bool:
    """Exact multiset equality in one aggregation: +1 per row of ``a``, -1 per
    row of ``b``, grouped by the whole row; equal iff every group nets 0.
    Duplicate-heavy data collapses in the map-side partial aggregate."""
    if [f.dataType for f in a.schema.fields] != [f.dataType for f in b.schema.fields] or a.columns != b.columns:
        return False
    cols = [f"`{c}`" for c in a.columns]
    tagged = a.withColumn("__w", F.lit(1)).unionByName(b.withColumn("__w", F.lit(-1)))
    diff = tagged.groupBy(*cols).agg(F.sum("__w").alias("__n")).where(F.col("__n") != 0)
    return diff.isEmpty()


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows added to and removed from a version: the columns of ``new``, and
    ``change`` (copies added, or removed if below 0).  One aggregation."""
    cols = [f"`{c}`" for c in new.columns]
    tagged = new.withColumn("__w", F.lit(1)).unionByName(old.select(*cols).withColumn("__w", F.lit(-1)))
    return tagged.groupBy(*cols).agg(F.sum("__w").alias("change")).where(F.col("change") != 0)


def versions(spark, target: str) -> list[tuple[int, str]]:
    """Complete versions under ``target`` (those with a ``_SUCCESS`` marker)."""
    fs = _FS(spark, target)
    if not fs.exists():
        return []
    out = []
    for name, path, is_dir in fs.children():
        m = _VERSION.match(name)
        if m and is_dir and _FS(spark, f"{path}/_SUCCESS").exists():
            out.append((int(m.group(1)), path))
    return sorted(out)


def latest_version(spark, target: str) -> str | None:
    v = versions(spark, target)
    return v[-1][1] if v else None


def publish_if_changed(
    df: DataFrame,
    target: str,
    fmt: str = "parquet",
    exact: bool = True,
    partition_by: list[str] | None = None,
) -> bool:
    """SNK-1: write ``df`` as ``target/version=N+1`` unless it equals the
    latest version.  Returns whether a new version was written.

    Fingerprints decide a change cheaply; when they agree and ``exact`` is
    set, a multiset comparison confirms equality.  Both go part by part, by the
    size of the latest version.
    """
    with shuffles_freed(df.sparkSession):
        return _publish(df, target, fmt, exact, partition_by)


def _publish(df: DataFrame, target: str, fmt: str, exact: bool, partition_by: list[str] | None) -> bool:
    spark = df.sparkSession
    options = {"header": "true"} if fmt == "csv" else {}
    all_v = versions(spark, target)
    if all_v:
        names = _column_names(spark, all_v[-1][1], fmt, options)
        if sorted(names) == sorted(df.columns):
            # Read with the new data's types by name: partition columns come
            # last in a folder and text formats keep no types.
            by_name = T.StructType([df.schema[c] for c in names])
            old = spark.read.format(fmt).options(**options).schema(by_name).load(all_v[-1][1]).select(*[f"`{c}`" for c in df.columns])
            same_types = fmt in _TEXT_FORMATS or _types(spark.read.format(fmt).load(all_v[-1][1])) == _types(df)
            if same_types:
                size = _FS(spark, all_v[-1][1]).bytes()
                moved, compared = part_count(size, MOVED_PARTS), part_count(size, COMPARED_PARTS)
                alike = _fingerprint_of([old]) == _fingerprint_of(parts(df, moved))
                pairs = zip(parts(old, compared), parts(df, compared), strict=True)
                if alike and (not exact or all(multiset_equal(o, d) for o, d in pairs)):
                    return False
    n = max(_version_numbers(spark, target), default=0) + 1
    w = df.write.format(fmt).options(**options).mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(f"{target.rstrip('/')}/version={n:06d}")
    return True


_TEXT_FORMATS = ("csv", "json")


def _types(df: DataFrame) -> dict[str, str]:
    """Type by column; partition columns may come back narrower or as text."""
    return {f.name: f.dataType.simpleString() for f in df.schema.fields if not isinstance(f.dataType, (T.IntegerType, T.StringType))}


def _column_names(spark, path: str, fmt: str, options: dict) -> list[str]:
    return spark.read.format(fmt).options(**options).load(path).columns


def _version_numbers(spark, target: str) -> list[int]:
    """Numbers of all version folders, complete or not."""
    fs = _FS(spark, target)
    found = [_VERSION.match(name) for name, _, _ in fs.children()] if fs.exists() else []
    return [int(m.group(1)) for m in found if m]


def sample_rows(
    df: DataFrame, n: int = 100, order_by: list[str] | None = None, decimals_as_double: bool = True
) -> DataFrame:
    """SNK-2: a deterministic preview of ``n`` rows (ordered by ``order_by``,
    default all columns); text columns stay text and, as in the reference's
    float columns, decimals are shown as doubles.  A top-k sort: each task
    keeps its first ``n`` rows, only those reach the final merge."""
    keys = order_by or df.columns
    top = df.orderBy(*[F.asc_nulls_first(f"`{k}`") for k in keys]).limit(n)
    if not decimals_as_double:
        return top
    return top.select(
        *[
            (F.col(f"`{f.name}`").cast("double") if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")).alias(
                f.name
            )
            for f in top.schema.fields
        ]
    )
