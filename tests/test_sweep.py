"""The sweep of open deliverables against plain loops, also where one project has nearly everything."""

import random

from pyspark.sql import functions as F
from sessionlake.operators import outcomes, timeline


def test_open_deliverables_equal_plain_loops(spark):
    rng = random.Random(8)
    project = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    spans = [(f"d{rng.randrange(60)}", project(), s := rng.choice([None, *range(0, 300, 7)]), None if s is None or rng.random() < 0.1 else s + rng.randrange(-3, 9)) for _ in range(150)]
    events = [(i, project(), rng.choice([None, *range(-5, 320)])) for i in range(1500)]
    want = {}
    for i, p, t in events:
        found = {d for d, q, s, e in spans if p is not None and p == q and None not in (t, s) and s <= t and (e is None or t <= e)}
        want[i] = (min(found) if len(found) == 1 else None, "unallocated" if not found else "linked" if len(found) == 1 else "ambiguous")
    got = outcomes.open_during(spark.createDataFrame(events, "ord long, project string, us long").repartition(7), spark.createDataFrame(spans, "deliverable string, project string, dispatched_us long, closed_us long"))
    assert {r["ord"]: (r["deliverable"], r["bucket"]) for r in got.collect()} == want
    assert len({b for _, b in want.values()}) == 3


def test_running_sums_of_one_key_lie_in_many_parts(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("k"), "id", (F.col("id") % 7).alias("v"))
    got = timeline.running_sums(rows.orderBy(F.desc("id")), "k", ["id"], {"s": F.col("v")}).orderBy("k", "id").collect()
    sums = {"a": 0, "b": 0}
    for r in got:
        sums[r["k"]] += r["v"]
        assert r["s"] == sums[r["k"]]
    assert len(got) == 20_000
    assert timeline.running_sums(rows.limit(0), "k", ["id"], {"s": F.col("v")}).count() == 0


def test_disjoint_spans(spark):
    rows = [("x", 1, 3), ("x", 2, 5), ("x", 5, 6), ("x", 8, 9), ("x", 20, None), ("x", 30, 40), ("y", 1, None)]
    got = timeline.disjoint(spark.createDataFrame(rows, "k string, s long, e long"), ["k"], "s", "e").orderBy("k", "s").collect()
    assert [tuple(r) for r in got] == [("x", 1, 6), ("x", 8, 9), ("x", 20, None), ("y", 1, None)]
