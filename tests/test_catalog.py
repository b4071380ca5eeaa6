"""Every named query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from echolode.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name not in catalog.oracle_sql():
        assert len(got)
        return
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            db.execute(f"create view {t} as from read_parquet('{SF}/{t}.parquet')")
    want = db.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
