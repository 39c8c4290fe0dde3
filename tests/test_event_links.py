"""Links of events to deliverables against plain loops."""

import random

from sessionlake.operators import event_links


def plain(events, places, by_id, by_ref, ledger):
    out = {}
    every = {r for _, _, _, rs in ledger for r in rs}
    of = {d: (a, z, set(rs)) for d, a, z, rs in ledger}
    for e, us, bucket, known in events:
        repos = {r for q, r in places if q == e} & every
        found, evidence = {d for q, d in by_id if q == e}, "deliverable_id"
        if not found:
            found, evidence = {d for q, d in by_ref if q == e}, "tool_reference"
        if len(found) == 1 and not repos and bucket != "other" and not known:
            repos = of[next(iter(found))][2]
        if not found:
            found, evidence = {d for d, (a, z, rs) in of.items() if rs & repos and a <= us and (z is None or us <= z)}, "project_time_weak"
        pick = next(iter(found)) if len(found) == 1 else None
        if pick and (us < of[pick][0] or (repos and not repos & of[pick][2])):
            pick = None
        repository = next(iter(repos)) if len(repos) == 1 else None
        if bucket == "other":
            out[e] = (None, "other", "other", repository)
        elif repository:
            out[e] = (pick, "linked" if pick else "unallocated", evidence if pick else "ambiguous" if found else "unallocated", repository)
        else:
            out[e] = (None, "unassigned", "ambiguous" if found or len(repos) > 1 else "unassigned", None)
    return out


def test_linked_events_equal_plain_rules(spark):
    rng = random.Random(9)
    repos = ["o/a", "o/b", "o/c", "o/none"]
    ledger = [(f"d{i}", a := rng.randrange(100), rng.choice([None, a + rng.randrange(60)]), rng.sample(repos[:3], rng.choice([1, 1, 1, 2]))) for i in range(12)]
    events = [(i, rng.randrange(160), rng.choice(["project"] * 4 + ["other", "unassigned"]), rng.random() < 0.3) for i in range(1500)]
    places = [(i, r) for i in range(1500) for r in rng.sample(repos, rng.choice([0, 0, 1, 1, 1, 1, 2]))]
    name = lambda: f"d{rng.randrange(12)}"
    by_id = [(i, name()) for i in range(1500) for _ in range(rng.choice([0, 0, 0, 1, 2]))]
    by_ref = [(i, name()) for i in range(1500) for _ in range(rng.choice([0, 0, 1, 2]))]
    f = spark.createDataFrame
    got = event_links.linked_events(f(events, "event long, us long, bucket string, origin_known boolean"), f(places, "event long, repo string"), f(by_id, "event long, deliverable string"), f(by_ref, "event long, deliverable string"), f(ledger, "deliverable string, dispatched_us long, closed_us long, repos array<string>"))
    want = plain(events, places, by_id, by_ref, ledger)
    assert {r["event"]: tuple(r)[1:] for r in got.collect()} == want
    assert {w[2] for w in want.values()} == {"deliverable_id", "tool_reference", "project_time_weak", "other", "ambiguous", "unallocated", "unassigned"}


def test_references_hold_until_the_next_context(spark):
    rng = random.Random(10)
    targets = [("d1", "branch", "b1"), ("d2", "pr", "o/r#2"), ("d3", "branch", "b1"), ("d3", "branch", "b3")]
    hints, events = [], []
    for i in range(600):
        s, us = f"s{rng.randrange(5)}", rng.randrange(300)
        what = rng.random()
        if what < 0.15:
            hints.append((s, us, i, "context", None, None))
        elif what < 0.5:
            kind = rng.choice(["branch", "branch_change", "pr", "push"])
            hints.append((s, us, i, "refs", kind, rng.choice(["b1", "b3", "o/r#2", "x"])))
        else:
            events.append((i, s, us, i))
    want = set()
    for e, s, us, o in events:
        mine = sorted(h for h in hints if h[0] == s and (h[1], h[2]) <= (us, o))
        since = max([k for k, h in enumerate(mine) if h[3] == "context"], default=-1)
        for h in mine[since + 1 :]:
            kind = "pr" if h[4] == "pr" else "branch" if h[4] in ("branch", "branch_change") else None
            want |= {(e, d) for d, k, v in targets if k == kind and v == h[5]}
    f = spark.createDataFrame
    got = event_links.references_in_context(f(events, "event long, session_id string, us long, ord long"), f(hints, "session_id string, us long, ord long, source string, kind string, value string"), f(targets, "deliverable string, kind string, value string"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50
