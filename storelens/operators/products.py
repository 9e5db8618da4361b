"""Product statistics and highlights.

Top-1 per subcategory is an aggregate (``min`` of a struct ordered by
descending quantity, then name) rather than a window: it partially
aggregates map-side, so a subcategory holding a third of all products is
still reduced in parallel instead of being sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.exprs import half_even, money_text
from ..functions.roles import ColumnRoles, roles_of
from .rollups import subcategory_sales


def product_stats(
    df: DataFrame, roles: ColumnRoles | None = None, approx: bool = False, partitions: int | None = None
) -> DataFrame:
    """PRD-2: per (subcategory, product): quantity, sales, mean price (rounded 2)
    and distinct invoices.

    Two levels: one row per (subcategory, product, invoice) first, then per
    product; the distinct count becomes a plain count of invoice groups.
    ``approx=True``: one level with a HyperLogLog invoice count instead.

    A task of the first level holds a group for nearly every line it reads.
    ``partitions`` deals the lines out to so many tasks by those groups' keys, a
    number that adaptive execution does not merge; by default the lines stay in
    the planner's partitions (after a join: up to 64 MB of shuffled data each).
    """
    r = roles_of(df, roles, "subcategory", "product", "quantity", "price", "invoice")
    return _product_stats(df, r, approx=approx, partitions=partitions)


def _sums(r: ColumnRoles) -> list:
    """Quantity, sales and mean price of a group of lines."""
    return [
        half_even(F.coalesce(F.sum(r.quantity), F.lit(0.0)), 2).alias("total_quantity"),
        half_even(F.coalesce(F.sum(r.price), F.lit(0)).cast("double"), 2).alias("total_sales"),
        half_even(F.try_divide(F.sum(r.price).cast("double"), F.count(r.price).cast("double")), 2).alias("avg_price"),
    ]


def _product_stats(df: DataFrame, r: ColumnRoles, approx: bool = False, partitions: int | None = None) -> DataFrame:
    sub, prod = r.subcategory, r.product
    lines = df.where(F.col(sub).isNotNull() & F.col(prod).isNotNull())
    if approx:
        return lines.groupBy(sub, prod).agg(*_sums(r), F.approx_count_distinct(r.invoice).alias("unique_transactions"))
    if partitions:
        lines = lines.repartition(partitions, sub, prod, r.invoice)
    per_invoice = lines.groupBy(sub, prod, F.col(r.invoice).alias("inv")).agg(
        F.sum(r.quantity).alias("q"), F.sum(r.price).alias("s"), F.count(r.price).alias("c")
    )
    return per_invoice.groupBy(sub, prod).agg(
        half_even(F.coalesce(F.sum("q"), F.lit(0.0)), 2).alias("total_quantity"),
        half_even(F.coalesce(F.sum("s"), F.lit(0)).cast("double"), 2).alias("total_sales"),
        half_even(F.try_divide(F.sum("s").cast("double"), F.sum("c").cast("double")), 2).alias("avg_price"),
        F.count("inv").alias("unique_transactions"),
    )


def product_highlights(
    df: DataFrame, n: int = 10, pattern: str = K.BENEFIT_PATTERN, roles: ColumnRoles | None = None
) -> DataFrame:
    """TOP-9, ordered by rank (at most ``n`` rows, sorted in one partition)."""
    return _highlights(df, n, pattern, roles).coalesce(1).sortWithinPartitions("rank")


def _highlights(
    df: DataFrame, n: int = 10, pattern: str = K.BENEFIT_PATTERN, roles: ColumnRoles | None = None
) -> DataFrame:
    """TOP-9: best product (by quantity; lower name on ties) of each of the
    ``n`` best-selling subcategories (benefit lines excluded from the
    ranking), with the subcategory's sales; ordered by those sales.

    The top-``n`` list has at most ``n`` rows, so it is broadcast to cut the
    fact down to those subcategories before any product is aggregated.
    A subcategory whose lines all lack a product name yields no row.
    """
    r = roles_of(df, roles, "subcategory", "product", "quantity", "price", "invoice")
    sub = r.subcategory
    top = (
        subcategory_sales(df, n=n, exclude_pattern=pattern, roles=r)
        .select(F.col(sub).alias("__cat"), F.col("total_sales").alias("category_sales"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("category_sales"), F.asc("__cat"))))
    )
    # Inner join with the n-row list: keeps only those subcategories' lines.
    lines = df.join(F.broadcast(top), F.col(sub) == F.col("__cat")).where(F.col(r.product).isNotNull())
    sums = lines.groupBy(F.col("__cat").alias("category"), F.col(r.product).alias("product")).agg(
        F.first("category_sales").alias("category_sales"),
        F.first("rank").alias("rank"),
        *_sums(r),
    )
    best = sums.groupBy("category").agg(
        F.min(F.struct((-F.col("total_quantity")).alias("k"), "product", "total_quantity", "total_sales", "avg_price")).alias("b"),
        F.first("category_sales").alias("category_sales"),
        F.first("rank").alias("rank"),
    )
    # Invoices are counted for the at most n winners only.
    won = best.select(F.col("category").alias("__wcat"), F.col("b.product").alias("__wprod"))
    theirs = df.join(F.broadcast(won), (F.col(sub) == F.col("__wcat")) & (F.col(r.product) == F.col("__wprod")))
    invoices = theirs.groupBy("__wcat", F.col(r.invoice).alias("__inv")).agg(F.lit(1).alias("__one"))
    invoices = invoices.groupBy("__wcat").agg(F.count("__inv").alias("unique_transactions"))
    best = best.join(invoices, F.col("category") == F.col("__wcat"))
    return best.select(
        "rank",
        "category",
        F.col("b.product").alias("product"),
        F.col("b.total_quantity").cast("bigint").alias("qty_sold"),
        F.col("b.total_sales").alias("total_sales"),
        money_text("b.total_sales", 0).alias("total_sales_text"),
        F.col("b.avg_price").alias("avg_price"),
        F.format_string("$%.2f", F.col("b.avg_price")).alias("avg_price_text"),
        F.col("unique_transactions").alias("transactions"),
        F.col("category_sales"),
        money_text("category_sales", 0).alias("category_sales_text"),
    )


def highlight_leaders(
    df: DataFrame, n: int = 10, pattern: str = K.BENEFIT_PATTERN, roles: ColumnRoles | None = None
) -> DataFrame:
    """TOP-10: best seller (quantity), top revenue (sales rounded to dollars)
    and most transactions among the highlights; the earlier row wins ties."""
    h = _highlights(df, n, pattern, roles)

    def arg_max(metric):
        return F.min(F.struct((-metric).alias("k"), F.col("rank"), F.col("category"), F.col("product"), metric.alias("v")))

    one = h.agg(
        arg_max(F.col("qty_sold").cast("double")).alias("best_seller"),
        arg_max(F.rint(F.col("total_sales"))).alias("top_revenue"),
        arg_max(F.col("transactions").cast("double")).alias("most_popular"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("leader"),
                F.col(f"{name}.category").alias("category"),
                F.col(f"{name}.product").alias("product"),
                F.col(f"{name}.v").alias("value"),
            )
            for name in ("best_seller", "top_revenue", "most_popular")
        ]
    )
    return one.where(F.col("best_seller").isNotNull()).select(F.inline(rows))
