"""Every registered query of the engine against DuckDB on the smallest sample data; those without SQL must give rows."""

from __future__ import annotations

import math
import os
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no sample data")

from seriesmill.plans import registry  # noqa: E402

#: Runs over many payloads of one small table; test_whole_run of test_sources.py covers the same plan.
SLOW = {"frame_pipeline_blocks"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) + 0.0 if isinstance(v, float) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, str(DATA))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLES:
        assert got[1]
        return
    rel = con.execute(registry.ORACLES[name])
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    wrong = [(a, b) for a, b in zip(got[1], want[1]) if any(x != y and not (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1.01e-4)) for x, y in zip(a, b))]
    assert not wrong, wrong[:3]
