import math
import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from sessionlake.llm import negatives, queries
from pyspark.sql import functions as F


def brute(rows, positives=5, negatives_=5, low=80, high=100):
    """Plain scores of every anchor with every row."""
    use = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, la, va in use:
        if a % 100:
            continue
        score = lambda v: sum(x * y for x, y in zip(va, v))  # noqa: B023, E731
        same = sorted({(-score(v), i) for i, label, v in use if label == la and i != a})[:positives]
        for s, p in same:
            ps = -s
            fits = sorted({(-score(v), i) for i, label, v in use if label != la and low * ps <= 100 * score(v) <= high * ps})[:negatives_]
            out += [(a, p, k + 1, n, ps, -t) for k, (t, n) in enumerate(fits)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize(("n", "dims", "size"), [(5, 64, 150), (3, 5, 20_000), (4, 17, 2**20), (2, 8, 1)])
def test_scores_equal_products(n, dims, size):
    rng = np.random.default_rng(n)
    a, c = rng.integers(-size, size + 1, (n, dims)), rng.integers(-size, size + 1, (300, dims))
    assert (negatives.scores(negatives.subset_sums(a), negatives.planes(c)) == c @ a.T).all()


def test_whole_numbers():
    v = pa.array([[0.1, -0.1, 3.0], [], [1.0]], pa.list_(pa.float32()))
    assert negatives.whole_numbers(v, 256).tolist() == [[25, -26, 768], [0, 0, 0], [256, 0, 0]]
    assert negatives.whole_numbers(v, 256, 2).tolist() == [[25, -26], [0, 0], [256, 0]]


def test_brute_force_with_ties_repeats_and_rows_that_take_no_part(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROUND", 6)  # several rounds, blocks and batches
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    monkeypatch.setattr(negatives, "ROWS", 16)
    rng = np.random.default_rng(7)
    rows = [(int(i), int(rng.integers(0, 4)), [float(x) for x in rng.integers(-2, 3, 9) / 4]) for i in range(0, 900, 3)]  # few values: many ties
    rows += [(300, 1, [0.5] * 9), (300, 1, [0.5] * 9), (7, 1, [0.5] * 9), (8, 2, [0.5] * 9), (600, 3, [-0.25] * 9)]  # repeated rows and ids
    rows += [(None, 1, [1.0] * 9), (11, None, [1.0] * 9), (13, 1, None), (14, 1, [1.0, None]), (16, 2, [float("nan")] * 9), (17, 2, [float("inf")]), (19, 2, []), (20, 1, [9.0] * 12), (22, 2, [0.5] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("rank", F.lit("x")).withColumn("ID", F.lit(1)).withColumn("Slot", F.lit(2)).repartition(5)
    want = brute(rows)
    assert len(want) > 100 and got(negatives.mine(df, F.col("vec_id") % 100 == 0)) == want
    assert got(negatives.mine(df, F.col("vec_id") % 100 == 0, positives=2, negatives=3, low=50, high=95)) == brute(rows, 2, 3, 50, 95)


def test_few_or_no_rows(spark):
    kind = "vec_id long, label string, embedding array<double>"
    assert got(negatives.mine(spark.createDataFrame([], kind), F.col("vec_id") % 100 == 0)) == []
    assert got(negatives.mine(spark.createDataFrame([(1, "a", [1.0])], kind), F.col("vec_id") % 100 == 0)) == []
    assert got(negatives.mine(spark.createDataFrame([(0, "a", [1.0]), (1, "b", [1.0])], kind), F.col("vec_id") % 100 == 0)) == []
    rows = [(0, "a", [1.0]), (1, "a", [1.0]), (2, "b", [1.0]), (3, "b", [0.9]), (4, "b", [0.5])]
    assert got(negatives.mine(spark.createDataFrame(rows, kind), F.col("vec_id") % 100 == 0)) == [(0, 1, 1, 2, 65536, 65536), (0, 1, 2, 3, 65536, 256 * 230)]


def test_too_large_is_an_error(spark):
    df = spark.createDataFrame([(0, 1, [1e9]), (1, 1, [1e9])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        negatives.mine(df, F.col("vec_id") == 0).collect()


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{os.path.join(sf, 'embeddings.parquet')}'")
    found = con.execute(queries.ORACLES["op11_hard_negatives"])
    want = sorted(found.fetchall())
    assert len(want) > 20 and got(queries.op11_hard_negatives(spark, sf)) == want
