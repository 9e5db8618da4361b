"""Queries with a DuckDB twin, on the smallest tables."""

import pytest
from conftest import ROOT  # noqa: F401  (puts the helpers on the path)
from oracle_check import compare

import __spark_entry__ as E
from storelens.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_registered():
    assert set(QUERIES) < set(E.queries()) and "pipeline" in E.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    status, detail = compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [d[0] for d in cur.description])
    assert status == "exact", (status, detail)
