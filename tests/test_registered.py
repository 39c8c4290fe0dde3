"""Registrations and price tables with what is wrong in them; repositories found by a fixpoint."""

import json
import random

import pytest
from pyspark.sql import functions as F
from sessionlake.operators import discovery
from sessionlake.sources import tables


def docs(spark, *values):
    return texts(spark, *values).select("path", F.try_parse_json("text").alias("record"))


def texts(spark, *values):
    return spark.createDataFrame([(str(i), json.dumps(v)) for i, v in enumerate(values)], "path string, text string")


def registration(**more):
    day = lambda n: f"2030-01-{n:02d}T00:00:00Z"
    return {
        "intervention_id": "i1", "applied_at": day(10), "registered_at": day(9), "predictions": [{"metric": "tokens", "direction": "decrease", "rough_size_percent": 10}], "non_inferiority_margin_pp": 5.5, "sample_size_per_arm": 20, "follow_up_days": 7,
        "before": {"since": day(1), "until": day(8)}, "after": {"since": day(10), "until": day(17)}, "confounders": [{"at": day(3), "label": "x"}],
    } | more


@pytest.fixture(scope="module")
def registered(spark):
    day = lambda n: f"2030-01-{n:02d}T00:00:00Z"
    cases = [
        (registration(), None), (registration(outcome_source="worker-github", registered_at=day(11)), None), (registration(more=1), "fields"), ({"intervention_id": "i"}, "fields"), (registration(outcome_source="x"), "outcome_source"), (registration(intervention_id="a b"), "intervention_id"),
        (registration(applied_at="2030-01-10"), "instants"), (registration(before={"since": day(1)}), "instants"), (registration(after={"since": day(9), "until": day(16)}), "windows"), (registration(before={"since": day(2), "until": day(8)}), "windows"), (registration(before={"since": day(8), "until": day(8)}), "windows"),
        (registration(non_inferiority_margin_pp=0), "sizes"), (registration(non_inferiority_margin_pp=True), "sizes"), (registration(sample_size_per_arm=1.5), "sizes"), (registration(follow_up_days=-1), "sizes"), (registration(predictions=[]), "predictions"),
        (registration(predictions=[{"metric": "m", "direction": "up", "rough_size_percent": 1}]), "predictions"), (registration(confounders={}), "confounders"), (registration(confounders=[{"at": "soon", "label": "x"}]), "confounders"), ([1], "fields"),
    ]
    return cases, {r["path"]: r for r in tables.registrations(docs(spark, *[c for c, _ in cases])).collect()}


def test_registrations(registered):
    cases, got = registered
    assert [got[str(i)]["problem"] for i in range(len(cases))] == [p for _, p in cases]
    first = got["0"]
    assert (first["preregistered"], got["1"]["preregistered"], got["1"]["outcome_source"]) == (True, False, "worker-github")
    assert (first["margin"], first["per_arm"], first["follow_up_days"], len(first["confounders"])) == (5.5, 20, 7, 1)
    assert [tuple(p) for p in first["predictions"]] == [("tokens", "decrease", 10)] and first["after_until"] - first["after_since"] == 7 * 86_400_000_000


def test_prices(spark):
    table = texts(spark, {"currency": "EUR", "models": {"Alpha*": {"output": 3, "new_input": 0.5}, "alpha-1": {}, "": {}, "b": {"output": -1}, "c": {"x": 1}, "d": {"output": True}, "e": 5}}, {"models": {}}, [])
    got = {(r["path"], r["pattern"]): (r["new_input"], r["output"], r["currency"], r["problem"]) for r in tables.prices(table).collect()}
    assert got == {
        ("0", "alpha*"): (0.5, 3.0, "EUR", None), ("0", "alpha-1"): (None, None, "EUR", None), ("0", ""): (None, None, "EUR", "pattern"), ("0", "b"): (None, -1.0, "EUR", "prices"), ("0", "c"): (None, None, "EUR", "prices"),
        ("0", "d"): (None, None, "EUR", "prices"), ("0", "e"): (None, None, "EUR", "prices"), ("1", None): (None, None, "USD", "models"), ("2", None): (None, None, "USD", "models"),
    }
    assert tables.price_list(tables.prices(table).where("path = '0'")) == [("alpha*", {"new_input": 0.5, "output": 3.0}), ("alpha-1", {})]


def plain_discovery(sessions, authored, ancestors, touched, owners, observed, repos, until):
    measured, end = set(repos), until
    while True:
        for s, start in sessions.items():
            own = [(t, r) for q, t, r in authored if q == s and start <= t < end]
            if own:
                found = {r for _, r in own if r}
            else:
                found = {r for q, t, r in authored if (s, q) in ancestors and start <= t < end and r and (s, r) in touched}
            measured |= {r for r in found if r.split("/")[0] in owners}
        later = max([end, *(t for r, t in observed.items() if r in measured)])
        if later == end:
            return measured, end
        end = later


def test_discovery_equals_plain_rounds(spark):
    rounds = set()
    for seed in range(8):
        rng = random.Random(seed)
        repos = [f"{o}/r{i}" for o in "abz" for i in range(6)]
        sessions = {f"s{i}": rng.randrange(0, 40) for i in range(12)}
        authored = [(rng.choice(list(sessions)), rng.randrange(0, 200), rng.choice([None, *repos])) for _ in range(30)]
        ancestors = {tuple(rng.sample(list(sessions), 2)) for _ in range(20)}
        touched = {(rng.choice(list(sessions)), rng.choice(repos)) for _ in range(60)}
        observed = {r: rng.randrange(0, 260) for r in repos if rng.random() < 0.8}
        want = plain_discovery(sessions, authored, ancestors, touched, "ab", observed, {"z/r0"}, 30)
        frame = lambda rows, kind: spark.createDataFrame(sorted(rows, key=repr), kind)
        claims = discovery.first_claims(frame(sessions.items(), "session_id string, start_us long"), frame(authored, "session_id string, us long, repo string"), frame(ancestors, "session_id string, ancestor string"), frame(touched, "session_id string, repo string"), ["a", "b"])
        got, end = discovery.discovered(claims, frame(observed.items(), "repo string, until_us long"), frame([("z/r0",)], "repo string"), 30)
        assert ({r["repo"] for r in got.collect()}, end) == want
        rounds.add(len(want[0]))
    assert len(rounds) > 3
