"""Work and memory of a task as the tables grow: facts derived once, groups dealt out by input size."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F

import rows
from conftest import SF_ORACLE, SF_SMALL
from storelens.operators import products as prd
from storelens.plans import catalog, inspect
from storelens.session import FREE_SHUFFLES_CONF
from storelens.sources import publish, star


def test_publish_cycle_derives_the_fact_once(spark, monkeypatch):
    seen = []
    real = publish.publish_if_changed

    def noted(df, target, **kw):
        seen.append(" ".join(df.inputFiles()))
        return real(df, target, **kw)

    monkeypatch.setattr(publish, "publish_if_changed", noted)
    steps = {r["step"]: (r["written"], r["version"], r["rows"]) for r in catalog.QUERIES["publish_cycle"](spark, SF_SMALL).collect()}
    n = star.purchases(spark, SF_SMALL).count()
    assert steps["first"] == (True, 1, n) and steps["same rows"] == (False, 1, n)
    assert steps["changed"][:2] == (True, 2) and steps["changed"][2] < n
    assert len(seen) == 3 and not [files for files in seen if "lineitem.parquet" in files]


def _purchases(spark):
    lines = [{"invoice_id": i % 40, "product_name": f"p{i % 7}", "revenue_subcategory": f"s{i % 3}", "quantity": float(i)} for i in range(300)]
    return rows.make(spark, *lines, {"invoice_id": None}, {"invoice_id": None}, {"product_name": None}, {"revenue_subcategory": None}, {"purchase_price_w_discount": None})


def test_product_stats_in_given_partitions(spark):
    p = _purchases(spark)
    dealt = prd.product_stats(p, partitions=37)
    # dealt out by the groups' keys, once, in a number that is not merged
    assert inspect.plan_text(dealt).count(", 37), REPARTITION_BY_NUM") == 1
    assert sorted(dealt.collect()) == sorted(prd.product_stats(p).collect())
    assert "REPARTITION_BY_NUM" not in inspect.plan_text(prd.product_stats(p))


def test_partitions_follow_the_input(spark, monkeypatch):
    size = star._inputs(spark, SF_ORACLE).bytes
    assert star.partitions(spark, SF_ORACLE) is None
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(star, "PARTITION_BYTES", size // (4 * cores))
    n = star.partitions(spark, SF_ORACLE)
    assert 4 * cores <= n <= 4 * cores + 1
    for name in ("product_stats", "product_sketch_bounds"):
        assert f", {n}), REPARTITION_BY_NUM" in inspect.plan_text(catalog.QUERIES[name](spark, SF_ORACLE))


def _shuffles(spark):
    """Numbers of the shuffles that have files on disk."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    blocks = env.blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {int(n) for n in re.findall(r"shuffle_(\d+)_", blocks)}


def _left(spark, before):
    """Shuffles begun since that still have files; their removal runs beside the query."""
    for _ in range(50):
        if not (left := _shuffles(spark) - before):
            break
        time.sleep(0.1)
    return left


@pytest.mark.parametrize("part_bytes", [publish.PART_BYTES, 1000])
def test_publish_cycle_holds_one_shuffle_at_a_time(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(publish, "PART_BYTES", part_bytes)
    before, left, sizes = _shuffles(spark), [], []
    real = publish.multiset_equal

    def noted(a, b):
        left.append(_left(spark, before))
        sizes.append(a.count())
        before.update(_shuffles(spark))  # of the count above
        return real(a, b)

    monkeypatch.setattr(publish, "multiset_equal", noted)
    derived = []
    folder = catalog.scratch
    monkeypatch.setattr(catalog, "scratch", lambda s, tag: derived.append(folder(s, tag)) or derived[-1])
    cycle = catalog.QUERIES["publish_cycle"](spark, SF_SMALL)
    assert left and not any(left) and not _left(spark, before)
    assert spark.conf.get(FREE_SHUFFLES_CONF) == "false"
    assert [os.path.exists(d.removeprefix("file:")) for d in derived] == [True, False]
    steps = {r["step"]: (r["written"], r["version"], r["rows"]) for r in cycle.collect()}
    n = star.purchases(spark, SF_SMALL).count()
    assert steps["first"] == (True, 1, n) and steps["same rows"] == (False, 1, n) and steps["changed"][:2] == (True, 2)
    # every row is compared, in parts that are about as large
    assert sum(sizes) == n and len(sizes) == (1 if part_bytes > 1000 else publish.COMPARED_PARTS)
    assert max(sizes) < 1.5 * n / len(sizes)


def test_parts_hold_every_row_once(spark):
    values = [(i % 9 or None, f"t{i % 4}" if i % 7 else None, (0.0, -0.0, float("nan"), None, 1.5)[i % 5]) for i in range(300)]
    df = spark.createDataFrame(values, "n int, s string, x double")
    for table, by in ((df, None), (df, ["s"]), (df.select("s"), None), (df.where("false"), None)):
        found = publish.parts(table, 5, by)
        whole = found[0]
        for part in found[1:]:
            whole = whole.unionByName(part)
        assert publish.multiset_equal(whole, table)
        assert sum(p.distinct().count() for p in found) == table.distinct().count()
        assert publish._fingerprint_of(found) == publish._fingerprint_of([table])
    assert publish.parts(df, 1) == [df]


def test_publish_in_parts_finds_a_change_of_one_row(spark, monkeypatch, scratch):
    monkeypatch.setattr(publish, "PART_BYTES", 1)
    schema = "n int, s string"
    values = [(1, "a"), (1, "a"), (2, "b"), (None, None), (None, None), *((i, f"t{i}") for i in range(50))]
    first, target = spark.createDataFrame(values, schema), f"{scratch}/t"
    assert publish.publish_if_changed(first, target)
    assert not publish.publish_if_changed(first.orderBy(F.desc("s")).repartition("s"), target)
    # the same distinct rows and as many rows, but other copies
    copies = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), *values[3:]], schema)
    assert publish.publish_if_changed(copies, target) and not publish.publish_if_changed(copies, target)
    assert publish.publish_if_changed(copies.where("n is not null or s is not null"), target)
    # fingerprints that agree: only the whole rows decide
    monkeypatch.setattr(publish, "_fingerprint_of", lambda found: 0)
    latest = publish.latest_version(spark, target)
    other = spark.read.parquet(latest).withColumn("s", F.when(F.col("n") == 49, "other").otherwise(F.col("s")))
    assert publish.publish_if_changed(other, target) and publish.latest_version(spark, target) != latest
