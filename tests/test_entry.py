"""Driver contract: entry() runs on sf0.001; every query has a callable and
oracle keys are a subset of query keys."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"scan_id", "completed", "successful", "failed"} <= set(df.columns)


def test_registry_consistent():
    qs, oracles = E.queries(), E.oracle_sql()
    assert set(oracles) <= set(qs)
    assert all(callable(f) for f in qs.values())
