import json


from sessionlake.sources import jsonl, open_events, tables
from sessionlake.streaming import windows


def test_lines_in_ranges_keep_bytes_and_order(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    bodies = {"a.jsonl": b'{"x":1}\n\n\xff\xfe broken\n{"y":"\xc3\xa9"}', "sub/b.jsonl": b"[1]\n" * 50 + b"x" * 300 + b"\n", "c.jsonl": b"", "d.txt": b"no\n"}
    for n, b in bodies.items():
        (tmp_path / n).write_bytes(b)
    want = []
    for n in ("a.jsonl", "sub/b.jsonl"):
        at = 0
        for line in bodies[n].removesuffix(b"\n").split(b"\n"):
            want.append((str(tmp_path / n), at, line))
            at += len(line) + 1
    for size in ("7", "64", "100000"):
        got = [(r["path"], r["byte_offset"], bytes(r["line"])) for r in jsonl.read(spark, str(tmp_path), partitionBytes=size).collect()]
        assert sorted(got) == sorted(want)
    c = jsonl.coverage(jsonl.parsed(jsonl.read(spark, str(tmp_path))), blank_ok=True).first()
    assert (c["lines"], c["malformed"], c["undecodable"]) == (55, 52, 1)
    assert jsonl.read(spark, str(tmp_path / "none")).count() == 0


def test_open_events_are_typed_and_problems_kept(spark, tmp_path):
    base = {"schema_version": 1, "event_id": "e", "session_id": "s", "timestamp": "2024-01-01T00:00:00Z"}
    rows = [
        base | {"type": "session_start", "agent": "x", "role": "worker"}, base | {"type": "token_usage", "tokens": {"new_input": 5, "output": 3, "reasoning_output": 2, "cache_read": None}},
        base | {"type": "token_usage", "tokens": {"new_input": True}}, base | {"type": "token_usage", "tokens": {"output": 1, "reasoning_output": 2}}, base | {"type": "token_usage", "tokens": {}, "timestamp": "2024-01-01T00:00:00"},
        base | {"type": "command_execution", "command": ["a", "b"], "exit_code": 0, "cwd": "/x", "started_at": None}, base | {"type": "command_execution", "command": 5}, base | {"type": "command_execution", "command": "a", "cwd": "rel"},
        base | {"type": "dance"}, base | {"type": "file_edit", "schema_version": "1"}, base | {"type": "file_edit", "event_id": ""}, base | {"type": "session_start", "role": "boss"},
    ]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    got = open_events.typed(jsonl.parsed(jsonl.read(spark, str(tmp_path)))).orderBy("byte_offset").collect()
    assert [r["problem"] for r in got] == [None, None, "token_usage", "token_usage", "token_usage", None, "command_execution", "command_execution", "unknown_type", "schema_version", "event_id", "role"]
    assert (got[1]["new_input"], got[1]["cache_read"], got[1]["us"], got[5]["exit_code"]) == (5, None, 1_704_067_200_000_000, 0)


def test_open_usage_and_command_rules(spark, tmp_path):
    base = {"schema_version": 1, "event_id": "e", "session_id": "s", "timestamp": "2024-01-01T00:00:00Z"}
    use, run = base | {"type": "token_usage", "tokens": {"output": 1}}, base | {"type": "command_execution", "command": "a", "exit_code": 3, "cwd": "/x", "started_at": "2024-01-01T00:00:00Z"}
    good = [use, use | {"cwd": None}, use | {"cwd": "/x"}, use | {"cwd": "C:\\x"}, run, run | {"command": []}, run | {"command": None, "exit_code": None, "cwd": None, "started_at": None}]
    bad = [use | {"cwd": "rel"}, use | {"cwd": 5}, use | {"cwd": "//host/x"}, run | {"started_at": "yesterday"}, run | {"started_at": 5}, run | {"command": ["a", 1]}, run | {"command": ["a", None]}, run | {"exit_code": "1"}, run | {"exit_code": True}, run | {"exit_code": 1.5}, run | {"cwd": ""}]
    bad += [{k: v for k, v in run.items() if k != name} for name in ("command", "exit_code", "cwd", "started_at")]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, good + bad)) + "\n")
    got = open_events.typed(jsonl.parsed(jsonl.read(spark, str(tmp_path)))).orderBy("byte_offset").collect()
    assert [r["problem"] for r in got] == [None] * len(good) + [r["type"] for r in bad]
    assert (got[4]["exit_code"], got[4]["cwd"]) == (3, "/x")
    assert all(r["exit_code"] is None and r["cwd"] is None for r in got[len(good) :] if r["kind"] == "command_execution")


def test_ledger_problems(spark, tmp_path):
    (tmp_path / "l.csv").write_text("id,dispatched_at,acceptance,repos,prs,branches,state_override,accepted_by_human,notes,task_type\na,2024-01-01T00:00:00Z,x,o/n;o/m,o/n#1;o/n#2:retry,b,,y,,t\nb,2024-01-01,x,,,,,,,\nc,2024-01-01T00:00:00Z,,,o/n#1,,,,,\nd,2024-01-01T00:00:00Z,,,bad,,,,,\nd,2024-01-01T00:00:00Z,,,,,,,,\n")
    got = tables.ledger(spark, str(tmp_path / "l.csv"))
    assert sorted((r["id"], r["problem"]) for r in got.collect()) == [("a", None), ("b", "dispatched_at"), ("c", None), ("d", "duplicate_id"), ("d", "duplicate_id")]
    assert [tuple(r) for r in tables.shared_pulls(got).collect()] == [("o/n#1", 2)]


def test_append_stream_holds_back_partial_lines(spark, tmp_path):
    src, out, log = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()

    def run():
        q = jsonl.stream(spark, str(src)).writeStream.format("parquet").option("checkpointLocation", str(log)).trigger(availableNow=True).start(str(out))
        q.awaitTermination()
        return sorted(bytes(r["line"]) for r in spark.read.parquet(str(out)).collect())

    (src / "a.jsonl").write_bytes(b"1\n2\n3")
    assert run() == [b"1", b"2"]
    (src / "a.jsonl").write_bytes(b"1\n2\n3\n4\n")
    (src / "b.jsonl").write_bytes(b"5\n")
    assert run() == [b"1", b"2", b"3", b"4", b"5"]


def test_stream_windows_equal_batch(spark, tmp_path):
    import random

    from sessionlake.operators import live

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, now = random.Random(5), 10 * live.HOUR
    rows = [(f"s{rng.randint(0, 3)}", f"r{rng.randint(0, 9)}", now - rng.randint(0, 3 * live.HOUR), i, rng.randint(0, 2), rng.randint(1, 99), "m", now) for i in range(80)]
    schema = "session_id string, id string, us long, ord long, rank long, context long, model string, now_us long"
    src = tmp_path / "src"
    for k in range(2):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(str(src))
    q = windows.trailing_hours(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(windows.snapshot_writer(str(tmp_path / "snap"))).trigger(availableNow=True).start()
    q.awaitTermination()
    snaps = spark.read.parquet(str(tmp_path / "snap"))
    last = {r["session_id"]: r for r in snaps.orderBy("generation").collect()}
    batch = live.trailing_hours(live.merged_updates(spark.createDataFrame(rows, schema)), now).collect()
    assert windows.latest_snapshot(spark, str(tmp_path / "snap")).count() >= 1
    for r in batch:
        assert [last[r["session_id"]][c] for c in ("current_calls", "current_tokens", "previous_calls", "previous_tokens")] == [r[c] for c in ("current_calls", "current_tokens", "previous_calls", "previous_tokens")]


def test_signals_and_labels(spark):
    w = spark.createDataFrame([("before", 0, 10_000_000), ("after", 20_000_000, 30_000_000)], "arm string, since long, until long")
    r = spark.createDataFrame([("5", "x"), ("25.5", "x"), ("15", "y"), ("bad", "x"), ("1970-01-01T00:00:06Z", "x")], "ts string, event string")
    got = {(x["arm"], x["label"]): x["n"] for x in tables.signals(r, w).collect()}
    assert got == {("before", "x"): 2, ("after", "x"): 1, ("outside", "y"): 1, ("unreadable", "x"): 1}
    lab = spark.createDataFrame([("12345678", None, "l", None, None, None), ("short", None, "l", None, None, None), ("12345678", None, None, None, None, None), ("12345678", "x", "l", None, None, None)], "session string, at string, lane string, account string, start_kind string, host string")
    assert [x["problem"] for x in tables.labels(lab).collect()] == [None, "session", "dimensions", "at"]
    i = spark.createDataFrame([("apply", "a", None, "2024-01-01T00:00:00Z"), ("apply", "b", None, "2024-01-01T00:00:00Z"), ("apply", None, "b", "2024-01-02T00:00:00Z"), ("revert", "a", None, "2025-01-01T00:00:00Z")], "action string, intervention_id string, practice_id string, utc_time string")
    assert [x["id"] for x in tables.interventions(i).select("id").collect()] == ["a"]
