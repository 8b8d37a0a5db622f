"""Each registered query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest
from compare import TABLES, rows

from vigil.plans.queries import ORACLES, QUERIES

SIZES = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def dbs():
    out = {}
    for sf in SIZES:
        out[sf] = duckdb.connect()
        out[sf].sql("SET TimeZone = 'UTC'")
        for t in TABLES:
            out[sf].sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, dbs, name):
    for sf in SIZES:  # the larger one only where the smaller one has no rows, which shows nothing
        want = dbs[sf].sql(ORACLES[name])
        want = rows(want.columns, want.fetchall())
        if want[1]:
            break
    assert want[1]
    df = QUERIES[name](spark, sf)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
