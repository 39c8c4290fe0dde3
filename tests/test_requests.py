"""Requests of raw records: odd types, missing parts, other records."""

import json

from sessionlake.operators import live
from sessionlake.sources import requests as r

AT = "2024-01-01T00:00:00Z"


def read(spark, f, *values):
    rows = [("s", i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return [(x["ord"], x["id"], x["context"], x["invalid"]) for x in f(spark.createDataFrame(rows, "session_id string, ord long, value string")).orderBy("ord").collect()]


def test_messages(spark):
    def m(id_="a", at=AT, **usage):
        full = {"input_tokens": 1, "cache_creation_input_tokens": 2, "cache_read_input_tokens": 3, "output_tokens": 4} | usage
        return {"type": "assistant", "timestamp": at, "message": {"id": id_, "usage": full}}

    got = read(spark, r.message_requests, m(), {"type": "user"}, "{broken", m(id_=""), m(id_=7), m(at="2024-01-01"), m(output_tokens=True), m(input_tokens=-1), m(cache_read_input_tokens=None), m(at=1704067200000), {"type": "assistant", "timestamp": AT})
    assert got == [(0, "a", 6, False), *[(i, None, None, True) for i in range(2, 9)], (9, "a", 6, False), (10, None, None, True)]


def test_counters(spark):
    def c(last, total):
        names = r.COUNTER_TOKENS
        return {"type": "event_msg", "timestamp": AT, "payload": {"type": "token_count", "info": {"last_token_usage": dict(zip(names, last)), "total_token_usage": dict(zip(names, total))}}}

    got = read(spark, r.counter_requests, c((9, 4, 2, 0), (9, 4, 2, 0)), c((3, 4, 2, 0), (9, 4, 2, 0)), c((9, 4, 2), (9, 4, 2)), c((9, 4, 2, 0), ()), {"type": "event_msg", "payload": {"type": "other"}})
    assert got == [(0, "9,4,2,0", 9, False), *[(i, None, None, True) for i in (1, 2, 3)]]


def test_stored(spark):
    def d(**more):
        return {"role": "assistant", "time": {"created": 1704067200000, "completed": 1704067201000}, "tokens": {"input": 5, "output": 1, "cache": {"read": 2, "write": 0}}} | more

    values = [{"id": "x", "data": d()}, {"id": "x", "data": json.dumps(d())}, d(id="y"), {"id": "x", "data": d(role="user")}, {"id": "x", "data": d(time={"created": 1})}, {"id": "x", "data": "{broken"}, d(), {"id": "x", "data": d(tokens=[])}]
    assert read(spark, r.stored_requests, *values) == [(0, "x", 7, False), (1, "x", 7, False), (2, "y", 7, False), (5, None, None, True), (6, None, None, True), (7, None, None, True)]


def test_snapshots_merge_by_rank_and_empty_tables(spark):
    def m(out, context):
        return {"type": "assistant", "timestamp": AT, "message": {"id": "a", "usage": {"input_tokens": context, "cache_creation_input_tokens": 0, "cache_read_input_tokens": 0, "output_tokens": out}}}

    df = spark.createDataFrame([("s", i, json.dumps(m(*v))) for i, v in enumerate([(5, 10), (9, 30), (7, 20)])], "session_id string, ord long, value string")
    assert [x["context"] for x in live.merged_updates(r.message_requests(df).where("NOT invalid")).collect()] == [30]
    for f in (r.message_requests, r.counter_requests, r.stored_requests):
        assert f(df.limit(0)).count() == 0
