import base64
import gzip
import hashlib
import io
import os
import random

import pytest
from pyspark.sql import functions as F
from sessionlake.llm import queries, warc


def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Bytes(io.BytesIO):
    whole = None

    def skip(self, n):
        self.seek(n, 1)


def brute(pages):
    first = {}
    for i, h in pages:
        p = (h or "").encode()
        first[p] = i if p not in first or first[p] is None else first[p] if i is None else min(i, first[p])
    for i, h in pages:
        p = (h or "").encode()
        again = first[p] is not None and first[p] != i
        yield i, len(p), sha1(p), "revisit" if again else "response", first[p] if again else None


def test_query_equals_brute_force(spark, sf):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = queries.op2_warc(spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(pages), key=repr)


PAGES = [(5, "u\r\nWARC-Type: evil", "same"), (3, None, "same"), (9, "http://é/x y", "same"), (1, "a", None), (2, "b", ""), (4, "c", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n"), (6, "d", "é😀" * 50_000), (7, "e", "x\r\n\r\n"), (7, "e", "x\r\n\r\n"), (None, "f", "same"), (None, "g", "alone")]


def test_round_trip_of_odd_pages(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    path = str(tmp_path / "w")
    warc.store(df, path)
    back = warc.read(spark, path).withColumn("id", warc.page_number("record_id")).collect()
    got = sorted(((r["id"], r["payload_bytes"], r["payload_digest"].removeprefix("sha1:"), r["record_type"]) for r in back), key=repr)
    assert got == sorted((x[:4] for x in brute([(p[0], p[2]) for p in PAGES])), key=repr)
    for r in back:
        if r["record_type"] == "response":
            assert sha1(bytes(r["payload"])) == r["payload_digest"].removeprefix("sha1:") and len(r["payload"]) == r["payload_bytes"]
        else:
            assert r["payload"] is None
    empty = str(tmp_path / "none")
    warc.store(df.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_pushed_filters_and_undecoded_payloads(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.store(df, path)
    some = warc.read(spark, path, payload=False).where("record_type = 'revisit' AND refers_to = '<urn:page:3>'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan or "record_type" not in plan.split("Filter (")[1].split("\n")[0]
    assert {warc_id for (warc_id,) in some.select(warc.page_number("record_id")).collect()} == {5, 9, None}
    assert warc.read(spark, path, payload=False).where("payload is not null").count() == 0
    assert warc.read(spark, path).where(F.col("record_type").isin("none")).count() == 0
    assert warc.read(spark, path).where("record_type = 'response' AND record_type = 'revisit'").count() == 0


def test_only_the_headers_of_unwanted_members_are_read(spark, tmp_path):
    """One archive with a large payload that doesn't compress: its bytes are skipped, and byte_offset is a member's place in the file."""
    noise = random.Random(1).randbytes(3_000_000).hex()
    df = spark.createDataFrame([(1, "a", noise), (2, "b", "small"), (3, "c", noise)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write(warc.records(df).coalesce(1).orderBy("page_id"), path)
    (name,) = os.listdir(path)
    data = open(f"{path}/{name}", "rb").read()

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            got = super().read(n)
            Counting.taken += len(got)
            return got

        def size(self):
            return len(data)

    for wanted, decode, n in (({"record_id": {"<urn:page:2>"}}, True, 1), ({}, False, 3)):
        Counting.taken = 0
        rows = list(warc.in_members(Counting(data), 0, len(data), wanted, decode))
        assert len(rows) == n and Counting.taken < 200_000 < len(data)
        assert all(r["payload_bytes"] in (5, 6_000_000) for r in rows)
        for r in rows:
            assert gzip.GzipFile(fileobj=io.BytesIO(data[r["byte_offset"] :])).read(1 << 10).startswith(b"WARC/1.1\r\n")
    assert gzip.decompress(data).count(b"WARC-Record-ID") == 3


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(2)
    pages = [(i, f"u{i}", rng.randbytes(rng.randint(0, 900)).hex()) for i in range(2000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write(warc.records(df).coalesce(1), path)
    (name,) = os.listdir(path)
    want = {p[0]: len(p[2]) for p in pages}
    for size in (1 << 16, 997, 1 << 30):
        back = spark.read.format("warc").option("partitionBytes", size).load(path)
        n = back.rdd.getNumPartitions()
        assert n == -(-os.path.getsize(f"{path}/{name}") // size) or size == 1 << 30 and n == 1
        if size > 1000:
            assert {r[0]: r[1] for r in back.select(warc.page_number("record_id"), "payload_bytes").collect()} == want and back.count() == 2000
    # Members of other writers, without lengths, are found too.
    raw = b"".join(gzip.compress(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {2 * len(x)}\r\n\r\n".encode() + x + x + b"\r\n\r\n") for i, x in ((i, rng.randbytes(400)) for i in range(300)))
    os.mkdir(tmp_path / "f")
    (tmp_path / "f" / "a.warc.gz").write_bytes(raw)
    back = spark.read.format("warc").option("partitionBytes", 5000).load(str(tmp_path / "f"))
    assert back.rdd.getNumPartitions() > 10 and sorted(r[0] for r in back.select(warc.page_number("record_id")).collect()) == list(range(300))


def test_uncompressed_archives_and_lost_tasks(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write(warc.records(df), path, "none")
    (tmp_path / "w" / "_lost.warc").write_bytes(b"WARC/1.1 half a rec")
    back = warc.read(spark, path).collect()
    assert sorted(((r["payload_bytes"], r["record_type"]) for r in back), key=repr) == sorted(((x[1], x[3]) for x in brute([(p[0], p[2]) for p in PAGES])), key=repr)
    assert all(sha1(bytes(r["payload"])) == r["payload_digest"].removeprefix("sha1:") for r in back if r["payload"] is not None)
    assert warc.read(spark, path, payload=False).count() == len(PAGES)


def test_parse_foreign_archives(tmp_path, spark):
    def rec(kind, body, more=""):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:1>\r\n{more}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    data = rec("warcinfo", b"software: x\r\n") + rec("resource", b"\x00\xff bytes") + rec("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request\r\n")
    rows = list(warc.parse(Bytes(data), {}, True))
    assert [r["payload"] for r in rows] == [b"software: x\r\n", b"\x00\xff bytes", b""]
    assert [r["record_type"] for r in warc.parse(Bytes(data), {"record_type": {"resource"}}, False)] == ["resource"]
    os.mkdir(tmp_path / "g")
    with gzip.open(tmp_path / "g" / "a.warc.gz", "wb") as f:
        f.write(data)
    assert warc.read(spark, str(tmp_path / "g")).count() == 3
    with pytest.raises(ValueError):
        list(warc.parse(Bytes(b"junk\r\n\r\n"), {}, True))
    assert list(warc.parse(Bytes(b""), {}, True)) == []
