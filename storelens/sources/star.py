"""The purchases fact derived from the star-schema test tables.

One row per line item: lineitem joined with its order, part, supplier,
customer and the customer's nation.  Every join is an inner equi-join on a
key, declared with the DataFrame API so Catalyst prunes the columns each
operator does not read.

Join strategy: lineitem-orders joins two tables that both grow with the
data, so it is pinned to a sort-merge join (``merge`` hint): neither side is
ever broadcast, whatever the planner's estimate.  The dimension joins
(part, supplier, customer, nation) carry no hint: AQE broadcasts a side only
when its measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and
falls back to a shuffle join above it, and skewed keys (a part on a third
of all lines) are split by AQE's skew-join handling.  Orders is joined to
its customer and nation before meeting lineitem, so the customer join runs
on the four-times-smaller orders side.

``purchases_table`` derives the fact once per input snapshot and writes it to
the session's shared folder (``spark.checkpoint.dir``); dashboard queries
then scan one columnar table instead of repeating the five joins, and the
written table cuts the lineage, so a lost executor re-reads files instead of
recomputing joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from .cache import Inputs, inputs, snapshot


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str, nulls: bool = False) -> DataFrame:
    """Canonical purchases table (see FIXTURES.md §A).

    ``nulls=True`` gives the null-key variant: vendor, subcategory, location
    and price are nulled on invoices divisible by 17, 19, 23 and 29.
    """
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"
    )
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")

    located_orders = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    j = (
        li.join(located_orders.hint("merge"), li.l_orderkey == located_orders.o_orderkey)
        .join(part, li.l_partkey == part.p_partkey)
        .join(supplier, li.l_suppkey == supplier.s_suppkey)
    )

    price = F.round(
        F.col("l_extendedprice").cast("decimal(18,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")), 2
    ).cast("decimal(18,2)")
    cost = (F.col("p_retailprice").cast("decimal(18,2)") * F.col("l_quantity").cast("decimal(18,0)")).cast(
        "decimal(18,2)"
    )
    out = j.select(
        F.timestamp_add("SECOND", (F.col("l_orderkey") * 7919) % 86400, F.col("o_orderdate")).alias("purchase_date"),
        F.col("l_orderkey").alias(K.INVOICE),
        F.col("n_name").alias("store_location"),
        F.col("p_type").alias(K.CATEGORY),
        F.col("p_brand").alias(K.SUBCATEGORY),
        F.col("p_name").alias(K.PRODUCT),
        F.col("s_name").alias(K.VENDOR),
        F.col("l_quantity").alias(K.QUANTITY),
        price.alias(K.PRICE),
        cost.alias(K.COST),
    )
    return with_null_keys(out) if nulls else out


def with_null_keys(df: DataFrame) -> DataFrame:
    """The null-key variant: vendor, subcategory, location and price are
    nulled on invoices divisible by 17, 19, 23 and 29 (one projection)."""
    inv = F.col(K.INVOICE)
    nulled = {K.VENDOR: 17, K.SUBCATEGORY: 19, "store_location": 23, K.PRICE: 29}
    return df.select(
        *[
            (F.when(inv % nulled[c] == 0, F.lit(None)).otherwise(F.col(c)) if c in nulled else F.col(c)).alias(c)
            for c in df.columns
        ]
    )


MATERIALIZE_CONF = "storelens.purchases.materialize"
# Caps file size (~1-2 GB of these rows) however large a write partition is.
MAX_RECORDS_PER_FILE = 20_000_000
# Inputs of this many bytes or more are written in a folder a month.
MONTH_BYTES_CONF = "storelens.purchases.month_bytes"
MONTH_BYTES = 64 << 30
# Writing tasks that share a month, so that a busy month is not one task's work.
MONTH_FILES = 4
# Input bytes behind each partition of a shuffle whose tasks hold all their rows (a few 100,000 lines).
PARTITION_BYTES = 8 << 20
_INPUTS = ("lineitem", "orders", "customer", "nation", "part", "supplier")


def _inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return inputs(spark, [f"{sf_dir.rstrip('/')}/{name}.parquet" for name in _INPUTS])


def _input_key(spark: SparkSession, sf_dir: str) -> str:
    """Identity of the input files as they are now."""
    return _inputs(spark, sf_dir).key


def input_bytes(spark: SparkSession, sf_dir: str) -> int:
    """Size of the input files as they are now."""
    return _inputs(spark, sf_dir).bytes


def partitions(spark: SparkSession, sf_dir: str) -> int | None:
    """Shuffle partitions for operators whose tasks hold every line they read:
    one per ``PARTITION_BYTES`` of input, so that a task's memory stays the same
    as the tables grow.  None while that is no more than the cores: the
    planner's partitions are as small then."""
    n = -(-input_bytes(spark, sf_dir) // PARTITION_BYTES)
    return n if n > spark.sparkContext.defaultParallelism else None


def purchases_table(spark: SparkSession, sf_dir: str, nulls: bool = False, months: bool = False) -> DataFrame:
    """The purchases fact, written once per input snapshot to the shared
    folder and read back (see module doc).  Requires ``spark.checkpoint.dir``.

    The inputs are listed on every call, so a changed table is never missed.
    Large inputs (``MONTH_BYTES_CONF``) are written in a folder a month; with
    ``months=True`` that column is kept, by which date filters skip folders.
    Below that size a month would be a few small files: rows are written by
    date within each file."""
    now = _inputs(spark, sf_dir)
    by_month = now.bytes >= int(spark.conf.get(MONTH_BYTES_CONF, str(MONTH_BYTES)))

    def write(target: str) -> None:
        rows = purchases(spark, sf_dir)
        if by_month:
            rows = rows.withColumn(K.MONTH, F.trunc("purchase_date", "MM"))
            rows = rows.repartition(K.MONTH, F.pmod(F.xxhash64(K.INVOICE), F.lit(MONTH_FILES)))
            w = rows.sortWithinPartitions(K.MONTH, "purchase_date").write.partitionBy(K.MONTH)
        else:
            w = rows.sortWithinPartitions("purchase_date").write
        w.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).parquet(target)

    found = snapshot(spark, "purchases", f"{now.key}-{'months' if by_month else 'files'}", write).df
    found = found if months or not by_month else found.drop(K.MONTH)
    return with_null_keys(found) if nulls else found


def fact(spark: SparkSession, sf_dir: str, nulls: bool = False, months: bool = True) -> DataFrame:
    """The fact the registered queries read: the materialized table when the
    session opts in (``storelens.purchases.materialize=true``), else the
    lazy star-schema view.  ``months=False``: the fact's own columns only."""
    if spark.conf.get(MATERIALIZE_CONF, "false").lower() == "true":
        return purchases_table(spark, sf_dir, nulls, months)
    return purchases(spark, sf_dir, nulls)


def checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table stands in for the reference's check-ins sheet."""
    return _table(spark, sf_dir, "events")


# DuckDB text of the same view, used by the oracle SQL of every query.
PURCHASES_SQL = """
SELECT o_orderdate + to_seconds((l_orderkey*7919)%86400) AS purchase_date,
       l_orderkey AS invoice_id, n_name AS store_location,
       p_type AS disp_category, p_brand AS revenue_subcategory,
       p_name AS product_name, s_name AS vendor_name, l_quantity AS quantity,
       cast(round(cast(l_extendedprice AS decimal(18,2)) * (1 - cast(l_discount AS decimal(4,2))), 2) AS decimal(18,2)) AS purchase_price_w_discount,
       cast(cast(p_retailprice AS decimal(18,2)) * cast(l_quantity AS decimal(18,0)) AS decimal(18,2)) AS unit_cost
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

PURCHASES_NULLS_SQL = """
SELECT purchase_date, invoice_id,
       CASE WHEN invoice_id % 23 = 0 THEN NULL ELSE store_location END AS store_location,
       disp_category,
       CASE WHEN invoice_id % 19 = 0 THEN NULL ELSE revenue_subcategory END AS revenue_subcategory,
       product_name,
       CASE WHEN invoice_id % 17 = 0 THEN NULL ELSE vendor_name END AS vendor_name,
       quantity,
       CASE WHEN invoice_id % 29 = 0 THEN NULL ELSE purchase_price_w_discount END AS purchase_price_w_discount,
       unit_cost
FROM purchases
"""
