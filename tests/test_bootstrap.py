"""The bootstrap over all units with all resamples, against brute force, and its draws against a sequence of plain ones."""

import hashlib
from collections import defaultdict

import numpy as np
from sessionlake.operators import experiments as x
from sessionlake.plans.catalog import QUERIES
from sessionlake.plans.experiment_queries import armed
from sessionlake.plans.registry import Views

SF = "/root/testdata/sf0.001"


def weights(ids, resamples=5000, seed=1729):
    """(replicate, unit) -> how often it is drawn."""
    y = (np.array(ids)[None, :] % x.PRIME * 48271 + np.arange(resamples)[:, None] * 69621 + seed) % x.PRIME
    for a, c in ((40692, 12211), (40014, 3791)):
        y = (y * y % x.PRIME * y + y * a + c) % x.PRIME
    return sum((y >= t * x.PRIME // 10**12).astype(np.int64) for t in x.POISSON)


def ratios(rows, draw, metric="tokens"):
    arms = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["unit_id"]):
        arms[r["experiment"], r["arm"]].append((r["unit_id"], r[metric], r["state"] == "success"))
    cost = {}
    for key, v in arms.items():
        ids, values, wins = zip(*v, strict=True)
        w = draw(key[1], ids)
        unknown = np.array([t is None for t in values])
        total, won = w @ np.array([t or 0 for t in values]), w @ np.array(wins)
        cost[key] = np.where((won > 0) & (w @ unknown == 0), total / np.maximum(won, 1), np.nan)
    return {e: cost[e, "after"] / cost[e, "before"] for e in {e for e, _ in arms}}


def brute(rows, metric="tokens"):
    out = {}
    for e, r in ratios(rows, lambda _, ids: weights(ids), metric).items():
        bad = int(np.isnan(r).sum())
        out[e] = (bad, *(np.quantile(r, [0.025, 0.975]) if not bad else (None, None)))
    return out


def same(got, want):
    assert set(got) == set(want)
    for e, (bad, low, high) in want.items():
        assert got[e][0] == bad
        assert got[e][1:] == (None, None) if bad else np.allclose(got[e][1:], (low, high), atol=1e-6)


def sample():
    return [{"experiment": e, "arm": arm, "unit_id": 1000 * (arm == "after") + i, "state": "success" if i % 3 else "failed", "tokens": None if e == "b" and i == 5 and arm == "after" else 10 * i + 7} for e, k in (("a", 60), ("b", 61), ("c", 400)) for arm, n in (("before", k), ("after", k - 9)) for i in range(n)]


def test_query_draws_from_all_armed_units(spark):
    rows = [r.asDict() | {"spent": r["tokens"] or 0} for r in armed(Views(spark, SF)).collect()]
    assert any(r["tokens"] is None for r in rows)
    got = QUERIES["bootstrap_ratio"](spark, SF).collect()
    for metric in ("tokens", "spent"):
        same({r["experiment"]: (r["undefined"], r["low"], r["high"]) for r in got if r["metric"] == metric}, brute(rows, metric))
    assert all(r["low"] < r["ratio"] < r["high"] for r in got if r["metric"] == "spent")  # an interval that isn't void
    assert {r["classification"] for r in QUERIES["ratio_classes"](spark, SF).where("metric = 'tokens'").collect()} == {"uncertain"}  # an unknown value voids each interval


def test_intervals_and_ratios(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "experiment string, arm string, unit_id long, state string, tokens long")
    want = brute(rows)
    assert [want[e][0] > 0 for e in "abc"] == [False, True, False]
    got = {r["experiment"]: r for r in x.bootstrap(df, ["tokens"]).collect()}
    same({e: (r["undefined"], r["low"], r["high"]) for e, r in got.items()}, want)
    cost = lambda arm: sum(r["tokens"] for r in rows if r["experiment"] == "a" and r["arm"] == arm) / sum(r["state"] == "success" for r in rows if r["experiment"] == "a" and r["arm"] == arm)
    assert abs(got["a"]["ratio"] - cost("after") / cost("before")) < 1e-12 and got["b"]["ratio"] is None


def test_draws_are_poisson_and_give_the_interval_of_plain_resampling():
    w = weights(range(3000), 2000)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:300])[np.triu_indices(300, 1)]).mean() < 0.03 and abs(np.corrcoef(w[:, :300].T)[np.triu_indices(300, 1)]).mean() < 0.03

    def plain(arm, ids):
        n = len(ids)
        out = np.zeros((5000, n), np.int64)
        for k in range(5000):
            slots = [int(hashlib.md5(f"{arm}|{k}|{s}".encode()).hexdigest()[:8], 16) % n for s in range(n)]
            out[k] = np.bincount(slots, minlength=n)
        return out

    rows = [r for r in sample() if r["experiment"] == "c" and r["unit_id"] % 1000 < 120]
    a, b = (np.quantile(ratios(rows, draw)["c"], [0.025, 0.975]) for draw in (lambda _, ids: weights(ids), plain))
    assert np.abs(a - b).max() < 0.12 * (b[1] - b[0])
