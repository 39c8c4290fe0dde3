"""Published numbers, hand cases and brute-force forms."""

import hashlib
import hmac
import random
from fnmatch import fnmatchcase

from pyspark.sql import functions as F
from sessionlake.functions import scalars as s
from sessionlake.functions import stats
from sessionlake.operators import attribution as a
from sessionlake.operators import fold, outcomes, timing

MINUTE = 60_000_000


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_intervals_and_sample_sizes(spark):
    lit = lambda *x: [F.lit(v) for v in x]
    low, high = one(spark, *stats.wilson(*lit(16, 20)))
    assert abs(low - 0.5839825677481064) < 1e-12 and abs(high - 0.919342337420202) < 1e-12
    low, high = one(spark, *stats.wilson(*lit(3, 6)))
    assert abs(low - 0.18761630648) < 1e-10 and abs(high - 0.81238369352) < 1e-10
    d, low, high = one(spark, *stats.newcombe(*lit(16, 20, 16, 20)))
    assert d == 0 and abs(low + 0.24679166221252044) < 1e-12 and abs(high - 0.24679166221252044) < 1e-12
    d, low, high = one(spark, *stats.newcombe(*lit(48, 80, 56, 70)))
    assert abs(low - 0.0524) < 5e-5 and abs(high - 0.3339) < 5e-5
    assert list(one(spark, stats.sample_size(F.lit(0.8), F.lit(50.0)), stats.sample_size(F.lit(0.8), F.lit(5.0)))) == [11, 1005]
    assert list(one(spark, *stats.wilson(*lit(0, 0)))) == [None, None]


def test_keyed_pseudonyms_are_hmac(spark):
    for key in (b"k", b"x" * 100):
        got = one(spark, s.pseudonym("id", F.lit("päth"), key))[0]
        assert got == "id_" + hmac.new(key, "päth".encode(), hashlib.sha256).hexdigest()[:24]


def test_strict_times_and_numbers(spark):
    rows = [("2024-01-01T00:00:00Z", 0), ("2024-01-01T01:00:00+01:00", 0), ("2024-01-01T00:00:00", None), ("2024-13-01T00:00:00Z", None), ("x", None), (None, None)]
    df = spark.createDataFrame([(t, b) for t, b in rows], "t string, b int")
    got = [r[0] for r in df.select(F.unix_micros(s.strict_timestamp(F.col("t")))).collect()]
    assert got == [1_704_067_200_000_000, 1_704_067_200_000_000, None, None, None, None]
    v = spark.createDataFrame([("1",), ("true",), ('"1"',), ("1.5",), ("-1",), ("null",)], "j string").select(s.strict_integer(F.try_parse_json("j")))
    assert [r[0] for r in v.collect()] == [1, None, None, None, None, None]


def test_globs_are_fnmatch(spark):
    globs = ["*", "a?c", "/r[0-2]/*", "[!a]b", "a.b*", "x[", "[]]", "a[b-d]*e", "(a|b)+", "[^a]b"]
    values = ["", "abc", "/r1/x", "/r3/x", "bb", "ab", "a.bz", "axbz", "x[", "]", "acxxe", "a\nc", "(a|b)+", "^b"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for g in globs:
        assert {r[0] for r in df.where(F.col("v").rlike(s.glob_regex(g))).collect()} == {v for v in values if fnmatchcase(v, g)}, g


def test_origins_and_exit_codes(spark):
    rows = ["git@Host.com:a/B.git", "https://u:p@Host.com:443/a/b/", "ssh://git@h:2222/a.git", "ftp://h/a", "nonsense", "https://h", "h:/x/"]
    df = spark.createDataFrame([(v,) for v in rows], "v string")
    assert [r[0] for r in df.select(s.normalize_origin(F.col("v"))).collect()] == ["host.com/a/B", "host.com/a/b", "h:2222/a", None, None, None, "h/x"]
    assert one(spark, s.exit_code(F.lit(None).cast("int"), F.lit("x\nProcess exited with code -3 \ny")))[0] == -3
    e = lambda *x: s.envelope_exit_code(*[F.lit(v).cast(k) for v, k in zip(x, ("boolean", "string", "int", "boolean", "boolean", "boolean"))])
    got = one(spark, e(True, "Exit code 2\nx", None, False, False, True), e(True, "x Exit code 2\n", None, False, False, True), e(False, "", None, False, False, True), e(False, "", 7, True, False, True), e(None, "", None, False, None, True))
    assert list(got) == [2, None, 0, None, None]


def test_carry_forward_limit(spark):
    """299 s carries, 300 s does not."""
    link = "named_struct('bucket','project','project_key','p','rule','p')"
    for gap, want in ((299, "previous_event"), (300, "unassigned")):
        df = spark.sql(f"SELECT * FROM VALUES ('s','claude',0L,0L,'usage',false,{link}), ('s','claude',{gap * 1_000_000}L,1L,'usage',false,CAST(NULL AS {a.LINK})) t(session_id,agent,us,ord,kind,reset,cwd_link)")
        got = a.event_links(df.withColumns({"path_low": F.lit(None).cast(a.LINK), "path_high": F.lit(None).cast(a.LINK)}), 10**15, 5).orderBy("ord").collect()
        assert [r["evidence"] for r in got] == ["cwd", want]


def carried(events, idle_us):
    """Event by event, as the semantics are told."""
    context = command = previous = previous_us = None
    paths = []
    for e in events:
        if e["kind"] == "context":
            context = e["cwd"]
            if e["agent"] == "open" and context is None:
                previous = previous_us = None
            if e["reset"]:
                command, paths = None, []
        elif e["kind"] == "tool":
            command = e["cwd"] or command
            paths += [e["path"]] if e["path"] else []
        else:
            cwd = {"claude": e["cwd"], "codex": command or context, "open": e["cwd"] or context}[e["agent"]]
            own = paths + ([e["path"]] if e["path"] else [])
            if cwd:
                link, how = cwd, "cwd"
            elif own:
                link, how = (own[0] if len(set(own)) == 1 else None), "tool_path"
            elif previous is not None and e["us"] - previous_us < idle_us:
                link, how = previous, "previous_event"
            else:
                link, how = None, "unassigned"
            previous, previous_us = link, e["us"]
            yield e["ord"], link, how


def test_islands_equal_the_sequential_fold(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for n in range(60):
        agent, us, mine = rng.choice(["claude", "codex", "open"]), 0, []
        for _ in range(rng.randint(1, 25)):
            us += rng.choice([0, 1, 299, 300, 301]) * 1_000_000
            kind = rng.choice(["context", "tool", "usage", "usage"])
            mine.append({"session_id": f"s{n}", "agent": agent, "us": us, "ord": len(rows) + len(mine), "kind": kind, "reset": rng.random() < 0.3, "cwd": rng.choice([None, None, "p", "q"]), "path": rng.choice([None, None, None, "p", "q"]) if kind != "context" else None})
        rows += mine
        want |= {o: (link, how) for o, link, how in carried(mine, 300_000_000)}
    df = spark.createDataFrame(rows, "session_id string, agent string, us long, ord long, kind string, reset boolean, cwd string, path string")
    as_link = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.lit("project").alias("bucket"), F.col(c).alias("project_key"), F.col(c).alias("rule")))
    events = df.withColumns({"cwd_link": as_link("cwd"), "path_low": as_link("path"), "path_high": as_link("path")})
    got = {r["ord"]: (r["link"]["project_key"], r["evidence"]) for r in a.event_links(events, 10**15, 5).collect()}
    assert got == want


def test_reset_and_invalid_deltas(spark):
    df = spark.sql("SELECT * FROM VALUES ('s',1L,1L,100,20),('s',2L,2L,150,90),('s',3L,3L,150,90),('s',4L,4L,30,10) t(session_id,us,ord,i,c)")
    got = [(r["ord"], r["d_i"], r["d_c"], r["reset"], r["invalid"]) for r in fold.counter_deltas(df, ("i", "c"), ("i", "c")).orderBy("ord").collect()]
    assert got == [(1, 100, 20, False, False), (2, 50, 70, False, True), (4, 30, 10, True, False)]


def test_active_time_and_zero_length_pairs(spark):
    df = spark.createDataFrame([("s", t * MINUTE) for t in (0, 2, 2, 4, 10, 31)], "session_id string, us long")
    r = timing.active(df, MINUTE, 20 * MINUTE, (2, 10)).first()
    assert (r["active_2m_us"], r["active_10m_us"]) == (3 * MINUTE, 9 * MINUTE)
    pairs = spark.createDataFrame([("s", 5, 5, True), ("s", 0, 5, True), ("s", 9, 9, True), ("s", 3, 1, False)], "session_id string, start_us long, end_us long, valid boolean")
    r = timing.paired_time(pairs, 5, 9).first()
    assert (r["pairs"], r["paired_us"]) == (1, 0)


def test_follow_up_cycles_stay_in_progress(spark):
    pulls = spark.createDataFrame([(i, 0, False, "green", False) for i in range(5)], "pr long, merged_us long, closed boolean, checks string, reverted boolean")
    follow = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (3, 4)], "pr long, repair long")
    got = {r["pr"]: r["state"] for r in outcomes.attempt_states(pulls, follow, 10**15).collect()}
    assert got == {0: "in_progress", 1: "in_progress", 2: "success", 3: "success", 4: "success"}


def test_human_rejection_waits(spark):
    parts = spark.createDataFrame([("d", 0, "success", 9, False, "n"), ("e", 0, "success", 9, False, "y"), ("e", 0, "unverified", None, True, "y")], "deliverable string, dispatched_us long, state string, closed_us long, retry boolean, human string")
    got = {r["deliverable"]: (r["state"], r["closed_us"], r["first_pass"]) for r in outcomes.judge(parts).collect()}
    assert got == {"d": ("in_progress", None, False), "e": ("unverified", 9, False)}


def test_normalised_reasons(spark):
    want = {
        'Path "x y" outside /tmp/a.b; retry': "path outside", "Too large: config.d/foo 3.txt 12,000 bytes. Then": "too large: bytes", "foo/bar denied!": "foo denied", "see dir/ now": "see now",
        r"C:\\a\\b.txt is Blocked.": "is blocked", "a.5 b": "a. b", "": "", "'a;b' `c` No": "no", "~/x and ../y, z": "and , z",
    }
    df = spark.createDataFrame(list(want.items()), "reason string, want string").union(spark.createDataFrame([(None, None)], "reason string, want string"))
    assert [tuple(r) for r in df.select("reason", s.normalize_reason(F.col("reason")).alias("got"), "want").collect() if r["got"] != r["want"]] == []
