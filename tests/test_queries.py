"""Every registered query with an oracle equals DuckDB over the same tables."""

import os

import duckdb
import pytest
from sessionlake.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def norm(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(ORACLES[name])
    theirs = [d[0] for d in got.description]
    assert sorted(theirs) == cols
    order = [theirs.index(c) for c in cols]
    assert norm([tuple(r[c] for c in cols) for r in df.collect()]) == norm([tuple(r[i] for i in order) for r in got.fetchall()])
