"""What the driver calls."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no sample data")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 5 and "symbol" in df.columns
