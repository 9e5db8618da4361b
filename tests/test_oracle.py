"""Every registered query against its DuckDB oracle.

Runs at sf0.001 by default; set STORELENS_ORACLE_SF=/root/testdata/sf0.01 for
the driver's scale.
"""

import os

import duckdb
import pytest

import __spark_entry__ as E
from oracle_check import TABLES, compare
from storelens.plans.catalog import QUERIES
from storelens.plans.oracles import ORACLES

SF = os.environ.get("STORELENS_ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    yield c
    c.close()


def test_every_query_has_an_oracle_or_is_exempt():
    exempt = set(QUERIES) - set(ORACLES)
    # fingerprint uses xxhash64, which DuckDB does not have; sketched counts are estimates.
    assert exempt == {"fingerprint", "benefit_penetration_sketched"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    status, detail = compare(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description])
    assert status in ("exact", "close"), f"{name}: {status} {detail}"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["revenue_subcategory", "revenue", "cogs", "profit", "profit_margin_pct"]
    assert df.count() > 0


def test_fingerprint_runs(spark):
    r = QUERIES["fingerprint"](spark, SF).first()
    assert r["rows"] == QUERIES["sales_kpis"](spark, SF).first()["transactions"]


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_column_types_match_oracle(spark, con, name):
    spark_types = dict(QUERIES[name](spark, SF).dtypes)
    rel = con.sql(ORACLES[name])
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for col, t in spark_types.items():
        assert duck_types.get(col) == SPARK_TO_DUCK.get(t, t.upper()), (name, col, t, duck_types.get(col))
