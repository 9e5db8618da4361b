"""The driver's contract: entry file and bench output."""

import json
import os
import subprocess
import sys

import __spark_entry__ as E
from conftest import ROOT, SF_SMALL


def test_entry_file_shape():
    qs, oracles = E.queries(), E.oracle_sql()
    assert set(oracles) <= set(qs)
    assert all(callable(q) for q in qs.values())
    assert all(isinstance(s, str) and s.strip() for s in oracles.values())


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2", BENCH_QUERIES="sales_kpis,peak_time",
               BENCH_WARM="false", BENCH_DRIVER_MEMORY="2g")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=600, check=True).stdout
    lines = [l for l in out.splitlines() if l.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == 0.001 and d["value"] > 0
    assert set(d["queries"]) == {"purchases_table_build", "sales_kpis", "peak_time"}
