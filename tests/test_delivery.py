"""Local delivery by hand cases."""

from sessionlake.operators import delivery

MINUTE = 60_000_000


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_states_with_gaps_and_starts_outside_the_scan(spark):
    m = MINUTE
    activity = [(s, 10 * m, None, g, e, o) for s, g, e, o in (("clean", 0, 0, False), ("gap", 1, 0, False), ("nochange", 0, 0, False), ("nochange_gap", 2, 0, False), ("nochange_open_gap", 2, 0, True), ("edit_gap", 1, 1, False), ("early", 0, 0, False), ("none", None, None, None))]
    activity += [("busy", 98 * m, None, 0, 0, False), ("done", 98 * m, 99 * m, 0, 0, False)]
    edits = [(s, 5 * m) for s in ("clean", "gap", "early", "busy", "done")] + [("late_edit", 200 * m)]
    checks = [(s, 8 * m, 6 * m, 0, True) for s in ("clean", "gap", "done", "busy")] + [("early", 8 * m, -3 * m, 0, True), ("clean", 150 * m, 149 * m, 1, True)]
    got = delivery.unit_states(spark.createDataFrame(edits, "session_id string, us long"), spark.createDataFrame(checks, "session_id string, us long, start_us long, exit_code int, here boolean"), spark.createDataFrame(activity, "session_id string, last_us long, completed_us long, gaps int, edit_gaps int, open_format boolean"), 0, 100 * m)
    incomplete = ("unverified", "incomplete_edit_or_command_timestamps")
    assert {r["session_id"]: (r["state"], r["reason"]) for r in got.collect()} == {
        "clean": ("success", "last_check_passed"), "gap": incomplete, "nochange": ("no_change", "no_known_edit"), "nochange_gap": ("no_change", "no_known_edit"), "nochange_open_gap": incomplete, "edit_gap": incomplete,
        "early": ("unverified", "check_start_not_after_last_edit"), "none": ("no_change", "no_known_edit"), "busy": ("in_progress", "recent_activity"), "done": ("success", "last_check_passed"),
    }


def test_parts_of_the_report(spark):
    sessions = [("w1", "a", 5, "project", True, True), ("w2", "a", 6, "project", True, True), ("w3", "b", 7, "project", True, True), ("w4", "a", 50, "project", True, True), ("o1", "a", 1, "project", False, True), ("o2", "a", 1, "project", False, False), ("x", "a", 5, "other", True, True), ("y", "a", 5, "unassigned", True, False), ("z", "a", None, "project", True, True), ("q", "a", 5, None, False, True)]
    states = [("w1", "success", "last_check_passed"), ("w2", "success", "last_check_passed"), ("w4", "failed", "last_check_failed")]
    tokens = [("w1", 10), ("w2", None), ("w3", 5), ("o1", 7), ("o2", 8)]
    checks = [("w1", 5, 0), ("w1", 15, 1), ("w2", 5, None), ("o1", 6, 0), ("x", 5, 0), ("w4", 16, 0), ("w4", 99, 0)]
    frames = [spark.createDataFrame(v, k) for v, k in ((sessions, "session_id string, agent string, start_us long, scope string, worker boolean, in_scan boolean"), (states, "session_id string, state string, reason string"), (tokens, "session_id string, tokens long"), (checks, "session_id string, us long, exit_code int"))]
    r = delivery.local_delivery(*frames, 0, 20, [("before", 0, 10), ("after", 10, 20)])
    assert rows(r.units, "session_id", "state", "tokens") == [("w1", "success", 10), ("w2", "success", None), ("w3", "no_change", 5)]
    assert rows(r.overhead, "session_id", "tokens") == [("o1", 7)]
    assert rows(r.excluded, "reason", "n") == [("missing_start_metadata", 2), ("other", 1)]
    assert rows(r.verifier, "arm", "exit_code", "n") == [("after", 0, 1), ("after", 1, 1), ("before", 0, 2)]
    assert rows(r.states, "agent", "state", "n", "tokens") == [("a", "success", 2, None), ("b", "no_change", 1, 5)]
    assert rows(delivery.local_delivery(*frames, 0, 20).verifier, "arm", "exit_code", "n") == [("all", 0, 3), ("all", 1, 1)]
