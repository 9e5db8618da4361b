"""Vendor performance, concentration and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import mean, percent, percent_or_zero, truncate_label
from ..functions.roles import ColumnRoles, roles_of

RANK_KEYS = ("total_sales", "transaction_count", "avg_transaction", "profit", "profit_margin")


def vendor_performance(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """VEN-1: per vendor: sales, count, mean; with a cost column also cost,
    profit and margin % (1 digit).  Null vendors are dropped; by sales."""
    r = roles_of(df, roles, "vendor", "price")
    v = r.vendor
    aggs = [
        F.coalesce(F.sum(r.price), F.lit(0)).alias("_s"),
        F.count(r.price).alias("transaction_count"),
        mean(r.price).alias("avg_transaction"),
    ]
    if r.cost:
        aggs.append(F.coalesce(F.sum(r.cost), F.lit(0)).alias("_c"))
    g = df.where(F.col(v).isNotNull()).groupBy(v).agg(*aggs)
    cols = [v, F.col("_s").cast("double").alias("total_sales"), "transaction_count", "avg_transaction"]
    if r.cost:
        cols += [F.col("_c").cast("double").alias("total_cost"), (F.col("_s") - F.col("_c")).cast("double").alias("profit")]
    out = g.select(*cols)
    if r.cost:
        out = out.withColumn("profit_margin", percent("profit", "total_sales", 1))
    return out.orderBy(F.desc_nulls_last("total_sales"), F.asc(v))


def top_vendors(
    df: DataFrame,
    by: str = "total_sales",
    n: int = 15,
    min_txns: int = 0,
    columns: list[str] | None = None,
    roles: ColumnRoles | None = None,
) -> DataFrame:
    """VEN-3..6 / TOP-12: the ``n`` vendors with the largest ``by`` among those
    with at least ``min_txns`` transactions (nulls last, name breaks ties)."""
    if by not in RANK_KEYS:
        raise ValueError(f"by must be one of {RANK_KEYS}")
    r = roles_of(df, roles, "vendor", "price")
    vp = vendor_performance(df, r)
    if min_txns:
        vp = vp.where(F.col("transaction_count") >= min_txns)
    out = vp.orderBy(F.desc_nulls_last(by), F.asc(r.vendor)).limit(n)
    return out.select(*columns) if columns else out


def vendor_detail(df: DataFrame, n: int = 30, roles: ColumnRoles | None = None) -> DataFrame:
    """VEN-6: the detail table of the top ``n`` vendors by sales."""
    r = roles_of(df, roles, "vendor", "price")
    cols = [r.vendor, "total_sales", "transaction_count", "avg_transaction"]
    if r.cost:
        cols += ["profit", "profit_margin"]
    return top_vendors(df, "total_sales", n, columns=cols, roles=r)


def vendor_concentration(df: DataFrame, k: int = 5, roles: ColumnRoles | None = None) -> DataFrame:
    """VEN-2 / TOP-12: vendor count, top vendor (label cut to 15 chars), its
    sales, and the share of the top ``k`` vendors in *all* sales (null
    vendors included in the denominator; 0 when sales <= 0).

    The top-k sum is taken over exact decimal vendor totals, so it does not
    depend on summation order.
    """
    r = roles_of(df, roles, "vendor", "price")
    v = r.vendor
    # Both uses below read the same columns of this one aggregate, so its
    # shuffled result is reused: one scan.  The null-vendor group only feeds
    # the all-sales denominator; it sorts last and is left out of the sum
    # (a filter would be pushed into one of the two uses and part them).
    per_vendor = df.groupBy(v).agg(F.coalesce(F.sum(r.price), F.lit(0)).alias("s"))
    named = F.col(v).isNotNull()
    top_k = (
        per_vendor.orderBy(F.desc(named), F.desc("s"), F.asc(v))
        .limit(k)
        .agg(F.coalesce(F.sum(F.when(named, F.col("s"))), F.lit(0)).cast("double").alias("t"))
        .select("t")
        .scalar()
    )
    one = per_vendor.agg(
        F.count(F.when(named, F.lit(1))).alias("total_vendors"),
        F.min(F.when(named, F.struct((-F.col("s")).alias("k"), F.col(v).alias("name"), F.col("s").alias("s")))).alias(
            "top"
        ),
        F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("all_sales"),
    )
    return one.withColumn("top5_sales", top_k).select(
        "total_vendors",
        truncate_label(F.col("top.name")).alias("top_vendor"),
        F.col("top.s").cast("double").alias("top_vendor_sales"),
        F.coalesce("top5_sales", F.lit(0.0)).alias("top5_sales"),
        percent_or_zero(F.coalesce("top5_sales", F.lit(0.0)), "all_sales").alias("top5_share"),
    )
