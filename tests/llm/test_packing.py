import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from sessionlake.llm import packing, queries
from tokenizers import Tokenizer
from pyspark.sql import functions as F

T = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, texts, capacity=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for d, t in texts.items():
        ids = [*T.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, len(by_seq)


def test_query_is_a_packing(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_packing(spark, sf).collect()
    padding, n = check(rows, texts)
    assert padding < 0.03 * 2048 * n
    assert len(rows) < 3 * len(texts)


def test_cuts():
    for n in (*range(1, 5000), 100_000):
        pieces = packing.cuts(n, 2048, 32)
        assert [a for a, _ in pieces] == [sum(m for _, m in pieces[:i]) for i in range(len(pieces))] and sum(m for _, m in pieces) == n
        for _, m in pieces:  # a bin of its class is filled but for 1/32 and rounding
            assert 0 < m <= 2048 and (m <= 64 or 2048 // m * m >= 2048 * 31 / 32 - 2048 // m)


def test_lots_and_small_capacity(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, F.col("id") % 61 + 1).otherwise(64).alias("length"), F.lit(1).alias("__k"))
    for lots in (1, 7):
        got = packing.assign(rows, "doc_id", 64, lots).collect()
        assert len(got) == 4000
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for v in by.values():
            at = 0
            for o, n in sorted(v):
                assert o == at
                at += n
            assert at <= 64
    assert packing.assign(rows.limit(0), "doc_id", 64).count() == 0


def test_equal_rows_spread_over_lots(spark):
    """Equal documents, and null ids, lie in many lots: none holds more than twice its share."""
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words").alias("text"))
    pieces = packing.stored(docs.withColumn("row", F.monotonically_increasing_id()))
    lots = [r["count"] for r in pieces.groupBy(F.pmod(F.xxhash64("row"), F.lit(40))).count().collect()]
    assert len(lots) == 40 and max(lots) < 2 * 500
    got = packing.pack(docs.limit(3000)).groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).collect()
    assert sum(r["n"] for r in got) == 3000 and max(r["tokens"] for r in got) <= 2048


def test_blocks_equal_whole_text():
    one = packing.tokenizer("word_bpe_49k.json")
    for t in ("", " ", "It's  a b c\x85d\x1ce\x1ff", "Å é ́x", "<|endoftext|> a<|startoftext|>b", "Straße ΑΣ ΑΣ. 1234 don't", "﻿a​b᠎c", "x" * 5000, "(word) \"word\" word's 'tis dogs' <word> |a| #a$ a_b _a_ ÀÉ. ΣΑΣ! Σ İstanbul ǅ. ½a ①", "ÀÉ. ́a", "'s 'S d'accord '", "<|endoftext|>. (<|endoftext|>)"):
        assert one(t.encode()).tolist() == T.encode(t, add_special_tokens=False).ids, repr(t)


def test_odd_rows(spark, docs):
    got = packing.pack(docs.limit(10), id_bytes=4).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    assert all(zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) == r["ids_crc32"] for r in packing.pack(docs.limit(10), id_bytes=2).collect())
    assert sum(r["length"] for r in got if r["doc_id"] == 2) == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 2)
    assert [r["doc_tokens"] for r in got if r["doc_id"] in (3, 4, 5)] == [1, 1, 1]
    assert any(r["doc_id"] is None for r in got)
    assert packing.pack(docs.limit(0)).count() == 0
