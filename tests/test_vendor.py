"""The two engines' logs, from files that the tests write: typing, identities, and the published totals."""

import json

import pytest
from pyspark.sql import functions as F
from sessionlake.operators import fold
from sessionlake.sources import jsonl, vendor

MINUTE = 60_000_000
SINCE = 1_893_456_000_000_000  # 2030-01-01
UNTIL = SINCE + 10 * MINUTE


def at(minute):
    m = int(minute * 60)
    return f"2030-01-01T00:{m // 60:02d}:{m % 60:02d}Z" if m >= 0 else f"2029-12-31T23:{59 + (m + 1) // 60:02d}:{m % 60:02d}Z"


def save(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))


def said(minute, message, new, written, read, output, *blocks, **more):
    usage = {"input_tokens": new, "cache_creation_input_tokens": written, "cache_read_input_tokens": read, "output_tokens": output}
    return {"type": "assistant", "sessionId": "main", "timestamp": at(minute), "cwd": "/w/one", "message": {"id": message, "model": "m1", "usage": usage, "content": list(blocks)}, **more}


def answer(minute, tool, **more):
    return {"type": "user", "sessionId": "main", "timestamp": at(minute), "cwd": "/w/one", "message": {"content": [{"type": "tool_result", "tool_use_id": tool, **more}]}}


def tool(id_, name="Look", **input_):
    return {"type": "tool_use", "id": id_, "name": name, "input": input_}


@pytest.fixture
def messages(tmp_path):
    """Messages of 65, 10 and 14 tokens in the window, one that ends after it; tools of 120, 60 and 120 seconds; a subagent of 6 tokens."""
    root = tmp_path / "projects"
    twice = said(1, "a", 10, 20, 30, 5)
    save(root / "p/main.jsonl", [
        {"type": "user", "sessionId": "main", "timestamp": at(-1), "cwd": "/w/one", "gitBranch": "b", "version": "2", "message": {"content": "go"}},
        said(-0.5, "before", 10, 20, 30, 4, tool("t0")), answer(0, "t0", is_error=True),
        said(0, "a", 10, 20, 30, 2, tool("t1")), twice, twice, answer(2, "t1", is_error=True, content="Exit code 3\nbad"),
        said(3, "b", 1, 2, 3, 4, tool("q", "AskUserQuestion")), answer(4, "q"),
        {"type": "system", "subtype": "compact_boundary", "sessionId": "main", "timestamp": at(5)}, {"type": "system", "subtype": "odd", "sessionId": "main", "timestamp": at(6)},
        "{broken", "[1]", {"type": "novel", "sessionId": "main", "timestamp": at(7)},
        said(8, "c", 2, 3, 4, 5, tool("t2")), said(9, "late", 10, 20, 30, 1), said(10, "late", 10, 20, 30, 2), answer(10, "t2"),
    ])
    save(root / "p/main/subagents/agent-kid.jsonl", [said(2, "k", 1, 0, 2, 3, agentId="kid", isSidechain=True)])
    (root / "p/main/subagents/agent-kid.meta.json").write_text('{"model": "m2", "spawnDepth": 1}')
    return str(root)


@pytest.fixture
def rollouts(tmp_path):
    """Deltas of 40, 70, 23 (after a reset) and 35 tokens; tools of 60, 60 and 60 seconds, a request of 120."""
    root = tmp_path / "sessions"
    count = lambda minute, i, c, o, r: {"type": "event_msg", "timestamp": at(minute), "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": r}}}}
    say = lambda minute, kind, **p: {"type": kind, "timestamp": at(minute), "payload": p}
    head = say(-10, "session_meta", id="x", cwd="/w/one", cli_version="0.1", source="exec", originator="codex_exec")
    repeated = count(3, 180, 110, 50, 15)
    save(root / "2030/rollout-1.jsonl", [
        head, say(-5, "turn_context", cwd="/w/one", model="m1", effort="low"), count(-1, 100, 60, 20, 5), count(0, 130, 80, 30, 7), count(0, 130, 80, 30, 7),
        say(1, "response_item", type="function_call", call_id="a", name="exec_command", arguments="x"), say(1, "event_msg", type="exec_command_begin", call_id="a", command=["ls"], cwd="/w/one"),
        say(2, "event_msg", type="exec_command_end", call_id="a", exit_code=2), say(2, "response_item", type="function_call_output", call_id="a", output="Process exited with code 2\nx"),
        repeated, say(5, "response_item", type="function_call", call_id="ask", name="f.request_user_input"), say(6, "response_item", type="function_call_output", call_id="ask", output="y"),
        say(6, "compacted"), say(6, "strange"), count(6, 20, 5, 3, 1),
    ])
    start = SINCE // 1000 + 8 * 60_000
    save(root / "2030/rollout-2.jsonl", [
        head, repeated, count(8, 50, 15, 8, 2), say(8, "event_msg", type="task_started", turn_id="t", started_at=start // 1000),
        say(9, "event_msg", type="item_completed", started_at_ms=start, completed_at_ms=start + 60_000, item={"type": "CommandExecution", "id": "b", "cwd": "/w/one", "exit_code": 0, "command": "y"}),
        say(9.5, "event_msg", type="task_complete", turn_id="t", started_at=start // 1000, completed_at=start // 1000 + 120), count(10, 999, 400, 90, 7),
    ])
    return str(root)


def seconds(events, kind):
    pairs = fold.pair_intervals(*vendor.intervals(events, kind)).where("valid")
    clipped = (F.least("end_us", F.lit(UNTIL)) - F.greatest("start_us", F.lit(SINCE))) / 1_000_000
    return {r["session_id"]: r["s"] for r in pairs.groupBy("session_id").agg(F.sum(F.greatest(clipped, F.lit(0))).alias("s")).collect()}


def rows(df, kind, *columns, where="true"):
    return sorted((tuple(r) for r in df.where(F.col("kind") == kind).where(where).select(*columns).collect()), key=repr)


def test_message_totals(spark, messages):
    events = vendor.in_order(vendor.message_events(vendor.message_records(spark, messages))).cache()
    usage = fold.maximal_snapshot(events.where("kind = 'usage'")).where(f"us >= {SINCE} AND us < {UNTIL}")
    total = usage.groupBy("session_id").agg(F.sum(F.col("new_input") + F.col("cache_write") + F.col("cache_read") + F.col("output")).alias("n"))
    assert {r["session_id"]: r["n"] for r in total.collect()} == {"main": 89, "main:subagent:kid": 6}
    assert seconds(events, "tool") == {"main": 300}
    assert rows(events, "counter", "name", "id") == [("compactions", None), ("user_input_requests", "q")]
    assert rows(events, "unknown", "label") == [("novel",), ("system:odd",)]
    assert rows(events, "context", "cwd", "branch") == [("/w/one", "b")]
    assert rows(events, "command", "id", "exit_code", "error", where="phase = 'end'") == [("q", None, None), ("t0", None, True), ("t1", 3, True), ("t2", None, None)]
    start = events.where("kind = 'session_start'").groupBy("session_id").agg(F.min("role").alias("r"), F.max("parent_id").alias("p"), F.max("dispatch").alias("d"))
    assert sorted(map(tuple, start.collect())) == [("main", "orchestrator", None, "interactive"), ("main:subagent:kid", "worker", "main", "subagent")]


def test_broken_lines_are_counted(spark, messages):
    c = jsonl.coverage(jsonl.parsed(jsonl.read_files(vendor.message_files(spark, messages)))).first()
    assert (c["lines"], c["malformed"]) == (19, 2)


def test_rollout_totals(spark, rollouts):
    events = vendor.in_order(vendor.rollout_events(vendor.rollout_records(spark, rollouts))).cache()
    counters = events.where("kind = 'usage'").withColumns({"input": F.col("input_total"), "cached": F.col("cache_read")})
    deltas = fold.counter_deltas(counters, ("input", "cached", "output", "reasoning_output"), ("input", "cached")).where(f"us >= {SINCE} AND us < {UNTIL}")
    got = deltas.orderBy("us", "ord").selectExpr("session_id", "d_fresh + d_cached + d_output AS n", "reset").collect()
    assert [tuple(r) for r in got] == [("x", 40, False), ("x", 70, False), ("x", 23, True), ("x", 35, False)]
    assert seconds(events, "tool") == {"x": 180} and seconds(events, "request") == {"x": 120}
    assert rows(events, "counter", "name", "id") == [("compactions", None), ("user_input_requests", "ask")]
    assert rows(events, "unknown", "label") == [("strange",)]
    assert rows(events, "session_start", "cwd", "dispatch", "role") == [("/w/one", "noninteractive_exec", "orchestrator")]
    assert ("a", '["ls"]', "/w/one", True, "start", "launch") in rows(events, "command", "id", "command", "cwd", "cwd_given", "phase", "pairing")
    assert rows(events, "tool_end", "id", "error", where="counts IS NULL") == [("a", True), ("a", True), ("ask", False), ("b", False)]


def test_the_first_header_names_all_rows_of_split_files(spark, tmp_path):
    early = [{"type": "turn_context", "payload": {"n": i}} for i in range(30)]
    save(tmp_path / "s/rollout-z.jsonl", [*early, {"type": "session_meta", "payload": {"id": "own", "cwd": "/a"}}, *early, {"type": "session_meta", "payload": {"id": "other", "cwd": "/b"}}, {"type": "session_meta", "payload": {"session_id": "own"}}, *early])
    files = vendor.rollout_files(spark, str(tmp_path / "s"))
    whole = jsonl.read_files
    try:
        jsonl.read_files = lambda f: whole(f, 100)  # a header in one of dozens of ranges
        found = vendor.rollout_records(spark, str(tmp_path / "s"), files).cache()
        assert found.rdd.getNumPartitions() > 1
        by = {r["session_id"]: (r["n"], r["i"]) for r in found.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if("inherited").alias("i")).collect()}
    finally:
        jsonl.read_files = whole
    assert by == {"rollout-z": (30, 0), "own": (63, 1)}
    events = vendor.rollout_events(found)
    assert rows(events, "session_start", "cwd") == [("/a",), (None,)]  # none of the inherited header


def test_streams_of_nested_and_workflow_agents(spark, tmp_path):
    root = tmp_path / "projects"
    one = lambda **more: [{"type": "user", **more}]
    save(root / "p/s1.jsonl", one(sessionId="s1"))
    save(root / "p/s1b.jsonl", one(sessionId="s1"))  # a resumed session's second file
    save(root / "p/nameless.jsonl", one())
    save(root / "p/agent-q.jsonl", one(sessionId="s1", isSidechain=True))
    save(root / "p/s1/subagents/agent-a.jsonl", one(sessionId="s1", agentId="a"))
    save(root / "p/s1/subagents/agent-b.jsonl", one(sessionId="s1"))
    save(root / "p/s1/subagents/agent-a/subagents/agent-c.jsonl", one(sessionId="s1"))
    save(root / "p/s1/subagents/workflows/w/agent-d.jsonl", one(sessionId="else"))
    save(root / "p/s1/notes/x.jsonl", one(sessionId="s1"))  # no log
    (root / "p/s1/subagents/agent-b.meta.json").write_text('{"parentAgentId": "a", "spawnDepth": 2, "model": ""}')
    (root / "p/s1/subagents/agent-a.meta.json").write_text("{broken")
    got = {r["path"].removeprefix(f"{root}/p/"): tuple(r)[1:] for r in vendor.message_records(spark, str(root)).select("path", "session_id", "stream_parent", "worker", "request", "depth").distinct().collect()}
    assert got == {
        "s1.jsonl": ("s1", None, False, "unknown", None), "s1b.jsonl": ("s1", None, False, "unknown", None), "nameless.jsonl": ("nameless", None, False, "unknown", None),
        "agent-q.jsonl": ("s1:subagent:q", "s1", True, "unknown", None),
        "s1/subagents/agent-a.jsonl": ("s1:subagent:a", "s1", True, "unknown", None),
        "s1/subagents/agent-b.jsonl": ("s1:subagent:b", "s1:subagent:a", True, "unknown", 2),
        "s1/subagents/agent-a/subagents/agent-c.jsonl": ("s1:subagent:a:subagent:c", "s1:subagent:a", True, "unknown", None),
        "s1/subagents/workflows/w/agent-d.jsonl": ("s1:subagent:d", "s1", True, "unknown", None),
    }


def test_edits_commands_and_denied_shapes_of_messages(spark, tmp_path):
    root = tmp_path / "projects"
    result = {"stdout": "", "stderr": "", "interrupted": False}
    save(root / "p/s.jsonl", [
        said(0, "m", 1, 1, 1, 1, tool("e", "Edit", file_path="/w/f"), tool("n", "NotebookEdit", notebook_path="/w/n"), tool("w", "Write"), tool("b", "Bash", command="ls", cwd="/x", run_in_background=True), "text", {"type": "text"}),
        answer(1, "b") | {"toolUseResult": result}, answer(1.5, "c") | {"toolUseResult": result | {"backgroundTaskId": "7"}}, answer(2, "d") | {"toolUseResult": result | {"exitCode": -1}},
        {"type": "assistant", "sessionId": "main", "message": {"usage": {"output_tokens": 1}}}, {"type": "assistant", "sessionId": "main", "timestamp": at(3), "message": {"usage": {"output_tokens": "1"}}}, {"type": "assistant", "message": "odd"}, {"type": 5},
    ])
    events = vendor.message_events(vendor.message_records(spark, str(root))).cache()
    assert rows(events, "file_edit", "id", "targets") == [("e", ["/w/f"]), ("n", ["/w/n"]), ("w", [None])]
    assert rows(events, "command", "id", "command", "cwd", "deferred", where="phase = 'start'") == [("b", '"ls"', "/x", True)]
    assert rows(events, "command", "id", "exit_code", "deferred", where="phase = 'end'") == [("b", 0, False), ("c", None, True), ("d", -1, False)]
    assert rows(events, "invalid", "label") == [("invalid_token_records",)] * 2
    assert rows(events, "unknown", "label") == [("5",)]


def test_items_and_patches_of_rollouts(spark, tmp_path):
    item = lambda kind, sub="item_completed", **more: {"type": "event_msg", "timestamp": at(1), "payload": {"type": sub, "item": {"type": kind, "id": "i", **more}}}
    patch = "*** Begin Patch\n*** Update File: a\n*** Move to: b\n@@\n-x\n+y\n*** Add File: c\n+1\n*** End Patch"
    call = lambda arguments, **more: {"type": "response_item", "payload": {"type": "custom_tool_call", "call_id": "p", "name": "x.apply_patch", "input": arguments, **more}}
    save(tmp_path / "rollout-a.jsonl", [
        item("FileChange", changes={"/f": {"move_path": "/g"}, "/h": {"move_path": None}, "/k": 1}), item("FileChange"), item("Novel"), item("FileChange", sub="item_started", changes={"/no": {}}),
        item("ContextCompaction"), call(patch), call(json.dumps({"patch": patch, "workdir": "/d"})), call({"input": "no patch", "cwd": "/e"}), call(patch, cwd="/own"),
        {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 1, "cached_input_tokens": 2, "output_tokens": 1}}}},
        {"type": "event_msg", "timestamp": at(1), "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 5, "cached_input_tokens": 2, "output_tokens": 1}}}},
        {"type": "session_meta", "payload": {"id": "s", "source": {"subagent": {"thread_spawn": {"parent_thread_id": "up"}}}, "git": {"branch": "g"}}},
    ])
    events = vendor.rollout_events(vendor.rollout_records(spark, str(tmp_path))).cache()
    assert rows(events, "file_edit", "targets", "cwd") == sorted([(["/f", "/g", "/h", "/k"], None), ([None], None), (["a", "b", "c"], None), (["a", "b", "c"], "/d"), ([None], "/e"), (["a", "b", "c"], "/own")], key=repr)
    assert rows(events, "unknown", "label") == [("item:Novel",)]
    assert rows(events, "request_usage", "new_input", "cache_read", "counters") == [(3, 2, None)]
    assert rows(events, "invalid", "label") == [("invalid_token_records",)]
    assert rows(events, "session_start", "role", "parent_id", "dispatch") == [("worker", "up", "subagent")]
    assert len(rows(events, "compaction", "id")) == 1
