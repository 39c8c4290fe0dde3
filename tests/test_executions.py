"""Executions against a plain reading in order of arrival."""

import random

from sessionlake.operators import executions
from sessionlake.sources import vendor

KIND = "session_id string, id string, us long, ord long, phase string, pairing string, command string, exit_code long, at_us long, cwd string, cwd_given boolean, deferred boolean, require_pair boolean, error boolean"


def plain(rows):
    launches, out = {}, {}
    for s, i, us, _, phase, pairing, command, code, at, cwd, given, deferred, need, error in sorted(rows, key=lambda r: r[3]):
        given = True if given is None else given
        if phase == "start":
            launches[s, i] = (at, cwd, given, command, bool(deferred))
            continue
        launch, pending, start, where = launches.get((s, i)), False, at, cwd
        if need and not launch:
            continue
        l_at, l_cwd, l_given, l_command, l_deferred = launch or (None, None, False, None, False)
        if pairing == "launch":
            start, where, pending = l_at, l_cwd, not l_given
            command = l_command if command is None or need else command
            code = None if l_deferred else code
        elif pairing == "interval":
            clash = launch is not None and (l_at is None or (at is not None and at != l_at))
            apart = l_given and given and l_cwd != cwd
            start = None if clash else at if at is not None else l_at
            paired = l_given and l_at is not None and not clash
            where = None if clash or apart else cwd if given else l_cwd if paired else None
            pending = clash or apart or (not given and not paired)
        if us is not None:
            out[s, i] = (us, command, code, start, where, None if deferred or l_deferred else error, pending)
    return out


def test_all_modes_equal_a_plain_reading(spark):
    rng = random.Random(12)
    rows = []
    for o in range(4000):
        phase = rng.choice(["start", "start", "end", "complete"])
        pick = lambda *x: rng.choice(x)
        rows.append((f"s{rng.randrange(4)}", f"c{rng.randrange(300)}", pick(None, *range(1, 9)), o, phase, pick(None, "launch", "interval"), pick(None, '"ls"', '"pwd"'), pick(None, 0, 1), pick(None, 5, 6), pick(None, "/a", "/b"), pick(None, True, False), pick(None, False, False, True), pick(None, False, True), pick(None, True, False)))
    got = executions.executions(spark.createDataFrame(rows, KIND).repartition(5))
    want = plain(rows)
    assert {(r["session_id"], r["id"]): tuple(r)[2:] for r in got.collect()} == want and len(want) > 700


def test_of_typed_logs(spark, tmp_path):
    root = tmp_path / "projects/p"
    root.mkdir(parents=True)
    use = '{"type":"assistant","sessionId":"s","timestamp":"2030-01-01T00:00:0%dZ","cwd":"/w","message":{"content":[{"type":"tool_use","id":"%s","name":"Bash","input":{"command":"ls","run_in_background":%s}}]}}\n'
    end = '{"type":"user","sessionId":"s","timestamp":"2030-01-01T00:00:0%dZ","cwd":"/v","toolUseResult":{"stdout":"","stderr":"","interrupted":false},"message":{"content":[{"type":"tool_result","tool_use_id":"%s","is_error":false}]}}\n'
    (root / "s.jsonl").write_text(use % (1, "a", "false") + use % (2, "b", "true") + end % (3, "a") + end % (4, "b") + end % (5, "alone"))
    events = vendor.in_order(vendor.message_events(vendor.message_records(spark, str(tmp_path / "projects")))).where("kind = 'command'")
    got = {r["id"]: r for r in executions.executions(events).collect()}
    assert set(got) == {"a", "b"}
    second = 1_893_456_000_000_000
    assert [got["a"][c] for c in ("end_us", "start_us", "command", "exit_code", "cwd", "error")] == [second + 3_000_000, second + 1_000_000, '"ls"', 0, "/w", False]
    assert (got["b"]["exit_code"], got["b"]["error"]) == (None, None)
