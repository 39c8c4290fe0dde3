"""The file index and the files of a window: the same sessions as without pruning, from fewer bytes."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from sessionlake.operators import pruning
from sessionlake.sources import file_index, jsonl, vendor

SINCE = 1_893_456_000_000_000  # 2030-01-01
OLD, NEW = "2029-06-01T00:00:00Z", "2030-01-01T00:00:05Z"


def save(path, *records, age=10):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records), encoding="utf-8")
    os.utime(path, (SINCE / 1e6 - age, SINCE / 1e6 - age))


def header(id_, when=OLD, parent=None):
    source = {"subagent": {"thread_spawn": {"parent_thread_id": parent}}} if parent else "cli"
    return {"type": "session_meta", "timestamp": when, "payload": {"id": id_, "cwd": f"/w/{id_}", "source": source}}


def turn(when, **more):
    return {"type": "turn_context", "timestamp": when, "payload": {"cwd": "/w", **more}}


@pytest.mark.parametrize(
    ("line", "latest", "provable"),
    [
        ('{"timestamp": "2030-01-01T00:00:05Z"}', SINCE + 5_000_000, True),
        ('{"a": {"timestamp" :"2030-01-01T00:00:05Z"}, "timestamp": "2029-01-01T00:00:00Z"}', SINCE + 5_000_000, True),
        ('{"timestamp": 5, "started_at": 1893456000, "completed_at_ms": 1893456007000}', SINCE + 7_000_000, True),
        ('{"started_at": "2030-01-01T00:00:01Z", "completed_at": null}', SINCE + 1_000_000, True),
        ('{"timestamp": "2030-01-01T00:00:05"}', None, True),  # no offset: no instant
        ('{"timestamp": {"x": 1}}', None, True),
        ('{"timestamp": "2030\\u002d01-01T00:00:05Z"}', SINCE + 5_000_000, True),
        ('{"timestamp": bad}', None, False),
        ('{"time\\u0073tamp": "2031-01-01T00:00:00Z"}', None, False),
        ('{"n\\u006f": "x"}', None, True),
        (b'{"timestamp": "\xff"}', None, False),
        ("broken", None, True),
    ],
)
def test_latest_instant_of_a_line(spark, line, latest, provable):
    raw = line if isinstance(line, bytes) else line.encode()
    r = file_index.latest(spark.createDataFrame([("p", bytearray(raw))], "path string, line binary"), file_index.ROLLOUT_FIELDS).first()
    assert (r["latest"], r["provable"]) == (latest, provable)


def test_only_changed_files_are_opened_again(spark, tmp_path):
    root = tmp_path / "s"
    for i in range(5):
        save(root / f"rollout-{i}.jsonl", header(f"s{i}"), turn(OLD))
    index, opened = file_index.rollout_index(spark, str(root))
    assert opened.count() == 5
    index.write.parquet(str(tmp_path / "i1"))
    old = spark.read.parquet(str(tmp_path / "i1"))
    save(root / "rollout-1.jsonl", header("s1"), turn(NEW), turn(OLD), age=5)  # changed
    save(root / "rollout-2.jsonl", header("s2"), turn(OLD).copy() | {"timestamp": "2029-06-01T00:00:01Z"}, age=4)  # another of the same size
    save(root / "rollout-9.jsonl", turn(OLD), header("s9", parent="s1"))  # new, with a record before its header
    (root / "rollout-3.jsonl").unlink()
    index, opened = file_index.rollout_index(spark, str(root), old)
    assert sorted(r["path"][-7:-6] for r in opened.collect()) == ["1", "2", "9"]
    rows = {r["path"][-7:-6]: r for r in index.collect()}
    assert sorted(rows) == ["0", "1", "2", "4", "9"]
    assert rows["1"]["latest"] == SINCE + 5_000_000 and rows["0"]["latest"] < SINCE
    assert sorted(rows["9"]["ids"]) == ["rollout-9", "s9"] and rows["9"]["parents"] == ["s1"] and rows["0"]["ids"] == ["s0"]


def test_pruned_window_equals_the_unpruned_one(spark, tmp_path):
    root = tmp_path / "s"
    filler = [turn(OLD, note="x" * 200)] * 20
    save(root / "rollout-now.jsonl", header("kid", parent="mid"), turn(NEW))
    save(root / "rollout-kid.jsonl", header("kid"), *filler)  # an earlier file of the same session
    save(root / "rollout-mid.jsonl", header("mid", parent="top"), *filler)  # parents lie before the window
    save(root / "rollout-top.jsonl", header("top", parent="mid"), *filler)  # in a cycle
    save(root / "rollout-late.jsonl", header("own"), turn(NEW), header("own", parent="hidden"))  # a parent that only a later header names
    save(root / "rollout-hidden.jsonl", header("hidden", parent="deep"), *filler)
    save(root / "rollout-deep.jsonl", header("deep"), *filler)
    save(root / "rollout-odd.jsonl", header("odd"), '{"timestamp": bad}')  # can't be judged
    for i in range(30):
        save(root / f"rollout-old{i}.jsonl", header(f"old{i}"), *filler)
    save(root / "rollout-touched.jsonl", header("touched"), *filler, age=-100)  # a young file with old instants
    index, _ = file_index.rollout_index(spark, str(root))
    index.write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    events = lambda files: vendor.rollout_events(vendor.rollout_records(spark, str(root), files))
    found, chosen = pruning.collect_window(index, SINCE, events)
    names = {r["path"].split("rollout-")[1][:-6] for r in chosen.collect()}
    assert names == {"now", "kid", "mid", "top", "late", "hidden", "deep", "odd", "touched"}

    def sessions(rows):
        live = rows.where(F.col("us") >= SINCE).select("session_id").distinct()
        some = rows.join(live, "session_id", "left_semi")
        return sorted(map(tuple, some.groupBy("session_id").agg(F.count("*"), F.min("us"), F.max("us"), F.array_sort(F.collect_set("parent_id"))).collect()))

    assert sessions(found) == sessions(events(vendor.rollout_files(spark, str(root)))) != []
    read, every = (df.agg(F.sum("size")).first()[0] for df in (chosen, index))
    assert read < every / 3
    assert jsonl.read_files(chosen).count() < jsonl.read_files(index).count() / 3


def test_closure_of_random_graphs(spark):
    rng = random.Random(2)
    rows, start, want = [], [], set()
    for g in range(60):  # many small ones at once, and a chain of 14
        n = 14 if g == 0 else rng.randrange(1, 9)
        files = [(f"{g}/{i}", [f"{g}s{i}"] if g == 0 else [f"{g}s{rng.randrange(n)}" for _ in range(rng.randrange(0, 3))], [f"{g}s{i + 1}"] if g == 0 else [f"{g}s{rng.randrange(n)}" for _ in range(rng.randrange(0, 2))]) for i in range(n)]
        first = {files[0][0]} if rng.random() < 0.8 or g == 0 else set()
        rows, start = rows + files, start + [(p,) for p in first]
        while True:
            keys = {k for p, i, q in files if p in first for k in i + q}
            more = {p for p, i, _ in files if set(i) & keys} | first
            if more == first:
                break
            first = more
        want |= first
    table = spark.createDataFrame(rows, "path string, ids array<string>, parents array<string>")
    got, rounds = pruning.closure(table, spark.createDataFrame(start, "path string"))
    assert {r["path"] for r in got.collect()} == want and 12 <= rounds <= 15
    only = pruning.closure(table, spark.createDataFrame([], "path string"), spark.createDataFrame([("0s12",)], "key string"))[0]
    assert {r["path"] for r in only.collect()} == {"0/12", "0/13"}
