"""``column_digests``: order-free, exact about nulls and repeats, names the changed columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from storelens.sources import column_digests


def _digests(df) -> dict:
    return {r["column"]: (r.filled, r.digest) for r in column_digests(df).collect()}


def _bits(*texts: str) -> str:
    return str(sum(int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in texts))


def test_against_hashlib(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "")], "k int, `odd name` string")
    assert _digests(df) == {
        None: (4, _bits("1:11:a", "1:11:a", "1:2-", "1:30:")),
        "k": (4, _bits("1", "1", "2", "3")),
        "odd name": (3, _bits("a", "a", "")),
    }


def test_order_and_partitions_do_not_matter(spark):
    df = spark.range(1000).select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("t"))
    assert _digests(df) == _digests(df.orderBy(F.desc("id")).repartition(7))


def test_changed_columns_differ(spark):
    old = spark.range(100).select("id", (F.col("id") % 5).alias("q"), F.lit("x").alias("t"))
    new = old.withColumn("q", F.when(F.col("id") == 7, 9).otherwise(F.col("q")))
    a, b = _digests(old), _digests(new)
    assert {c for c in a if a[c] != b[c]} == {None, "q"}


def test_values_moved_between_rows_change_the_rows_alone(spark):
    a = _digests(spark.createDataFrame([(1, "x"), (2, "y")], "k int, t string"))
    b = _digests(spark.createDataFrame([(1, "y"), (2, "x")], "k int, t string"))
    assert {c for c in a if a[c] != b[c]} == {None}


def test_null_is_not_its_mark(spark):
    a = _digests(spark.createDataFrame([(None, "b")], "x string, y string"))
    b = _digests(spark.createDataFrame([("-", "b")], "x string, y string"))
    assert a[None] != b[None] and a["x"] != b["x"]


def test_empty_table(spark):
    assert _digests(spark.createDataFrame([], "k int, t string")) == {None: (0, "0"), "k": (0, "0"), "t": (0, "0")}


def test_a_column_named_like_the_result(spark):
    df = spark.createDataFrame([("a", "b", 1)], "`column` string, digest string, n0 int")
    assert set(_digests(df)) == {None, "column", "digest", "n0"}


def test_sums_beyond_a_long(spark):
    df = spark.range(3000).select((F.col("id") * 7).alias("k"))
    texts = [str(7 * i) for i in range(3000)]
    assert int(_bits(*texts)) > 2**63
    assert _digests(df) == {None: (3000, _bits(*(f"{len(t)}:{t}" for t in texts))), "k": (3000, _bits(*texts))}


def test_each_value_is_hashed_once_below_the_aggregate(spark):
    df = spark.range(10).select("id", F.lit("x").alias("t"))
    plan = column_digests(df)._jdf.queryExecution().optimizedPlan().toString()
    hashing = [line for line in plan.splitlines() if "md5(" in line]
    assert len(hashing) == 1 and "Project" in hashing[0], plan
