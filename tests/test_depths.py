"""Iterations without a cap: long chains, branches, cycles."""

from pyspark.sql import functions as F
from sessionlake.operators import measures, outcomes

DAY = 86_400_000_000


def brute(own, repairs):
    """The states as the rule says them, decided again and again until nothing changes."""
    done = {p: s for p, s in own.items() if not repairs.get(p) or s == "failed"}
    while True:
        new = {p: own[p] if any(done[r] == "success" for r in rs) else "failed" for p, rs in repairs.items() if p in own and p not in done and all(r in done for r in rs)}
        if not new:
            return {p: done.get(p, "in_progress") for p in own}
        done |= new


def states(spark, own, repairs):
    checks = {"success": "green", "failed": "red", "unverified": "unknown"}
    pulls = spark.createDataFrame([(p, 0, True, checks[s], False) for p, s in own.items()], "pr long, merged_us long, closed boolean, checks string, reverted boolean")
    ups = spark.createDataFrame([(p, r) for p, rs in repairs.items() for r in rs], "pr long, repair long")
    return {r["pr"]: r["state"] for r in outcomes.attempt_states(pulls, ups, 30 * DAY).collect()}


def test_chain_of_a_thousand_repairs(spark):
    for end in ("success", "failed"):
        own = {i: "success" for i in range(1000)} | {999: end}
        assert set(states(spark, own, {i: [i + 1] for i in range(999)}).values()) == ({"success"} if end == "success" else {"failed"})


def test_branches_breaks_and_cycles(spark):
    own = {i: ("success", "success", "success", "unverified", "failed")[i * 7 % 5] for i in range(60)}
    repairs = {i: [j for j in (2 * i + 1, 2 * i + 2) if j < 60] for i in range(30)} | {40: [41], 41: [42], 42: [43], 50: [51], 51: [50], 52: [50, 3], 55: [99]}
    repairs = {p: rs for p, rs in repairs.items() if rs}
    assert states(spark, own, repairs) == brute(own, repairs)


def test_nesting_of_any_depth(spark):
    rows = [("a", f"s{i}", f"s{i - 1}" if i else None, None) for i in range(3000)] + [("a", "x", "y", None), ("a", "y", "x", None), ("a", "z", "x", None), ("a", "orphan", "gone", None), ("a", "self", "self", None), ("b", "s5", None, None), ("b", "told", "gone", 7)]
    df = spark.createDataFrame(rows, "agent string, session_id string, parent_id string, reported int")
    got = {(r["agent"], r["session_id"]): r["depth"] for r in measures.nesting_depth(df).collect()}
    assert all(got["a", f"s{i}"] == i for i in range(3000))
    assert [got["a", x] for x in ("x", "y", "z", "orphan", "self")] == [None] * 5 and got["b", "s5"] == 0 and got["b", "told"] == 7
    plain = measures.nesting_depth(df.where("agent = 'a'").select("session_id", "parent_id"))
    assert plain.columns == ["session_id", "depth"] and plain.where(F.col("depth") == 2999).count() == 1
