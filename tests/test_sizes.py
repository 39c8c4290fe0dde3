"""Values that only larger tables have."""

import duckdb
import pytest
from sessionlake.operators import experiments
from sessionlake.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_sums_beyond_a_long(spark):
    units = spark.createDataFrame([("e", "after", s, 0.5, e) for s, e in (("success", 2**62), ("success", 2**62), ("failed", 2**62), ("failed", 8))], "experiment string, arm string, state string, tokens double, elapsed_us long")
    (got,) = experiments.rates(units).collect()
    assert (got["n"], got["successes"], got["tokens_per_success"]) == (4, 2, 1.0)
    assert got["us_per_success"] == (3 * 2**62 + 8) / 2


@pytest.fixture(scope="module")
def many_parts(tmp_path_factory):
    """The smallest tables with every other line's part beyond 100,000: their folder and a connection."""
    d, con = tmp_path_factory.mktemp("many_parts"), duckdb.connect()
    for t in ("orders", "customer", "lineitem"):
        what = "* REPLACE (l_partkey + l_linenumber % 2 * 100000 AS l_partkey)" if t == "lineitem" else "*"
        con.execute(f"COPY (SELECT {what} FROM '{SF}/{t}.parquet') TO '{d}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return str(d), con


@pytest.mark.parametrize("name", ["checks_verdict", "attempt_states", "deliverable_states", "cost_per_success"])
def test_parts_beyond_the_places_of_a_supplier(spark, many_parts, name):
    d, con = many_parts
    df, theirs = QUERIES[name](spark, d), con.execute(ORACLES[name])
    got = df.select([c[0] for c in theirs.description]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(theirs.fetchall(), key=repr)
