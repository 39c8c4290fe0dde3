import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from sessionlake.llm import langid, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op8_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {r["doc_id"] for r in held} == {d for d, r in got.items() if r["held_out"]}
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held if r["lang"]]
    assert np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def brute_bits(counts, data, order):
    """Method C without exclusion, straight from the counts of one language."""
    total = 0.0
    data = langid.PAD * order + data
    for i in range(order, len(data)):
        for k in range(order, -2, -1):
            if k < 0:
                total += 8
                break
            followers = counts[k].get(data[i - k : i])
            if followers is None:
                continue
            n, d = sum(followers.values()), len(followers)
            if data[i] in followers:
                total -= np.log2(followers[data[i]] / (n + d))
                break
            total -= np.log2(d / (n + d))
    return total


def test_code_lengths_equal_brute_force(spark):
    texts = {"a": ["banana bandana", "ananas"], "b": ["cocoa coco", "cacao na"]}
    rows = [(i, t, l) for i, (l, t) in enumerate((l, t) for l, ts in texts.items() for t in ts)]
    ids = iter(i for i in range(99) if zlib.crc32(str(i).encode()) % 4 != 2)
    df = spark.createDataFrame([(next(ids), t, l) for _, t, l in rows], "doc_id long, text string, lang string")
    for order in (1, 3):
        m = langid.fit(df, order=order)
        probes = [b"banana cocoa", b"xyz", b"n", "é banana".encode() * 50]
        got = langid.totals(m, probes)
        for j, name in enumerate(m.languages):
            counts = [{} for _ in range(order + 1)]
            for t in texts[name]:
                data = langid.PAD * order + t.encode()
                for i in range(order, len(data)):
                    for k in range(order + 1):
                        f = counts[k].setdefault(data[i - k : i], {})
                        f[data[i]] = f.get(data[i], 0) + 1
            assert np.allclose(got[:, j], [brute_bits(counts, p, order) for p in probes], rtol=1e-4)


def test_segments(spark, monkeypatch, docs):
    m = langid.fit(docs, order=3)
    texts = [b"the cat " * 50, b"z", b"dog" * 100]
    whole = langid.totals(m, texts)
    monkeypatch.setattr(langid, "SEGMENT", 37)
    assert np.allclose(whole, langid.totals(m, texts), rtol=1e-5)


def test_many_languages_and_long_training_texts(spark):
    """300 labels are all learnt; so are labels whose texts are all long, and rows that share an id."""
    ids = iter(i for i in range(9999) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(next(ids), f"{chr(0x4E00 + 3 * k)}{chr(0x4E01 + 3 * k)} {chr(0x4E02 + 3 * k)} " * 4, f"l{k:03}") for k in range(300)]
    rows += [(next(ids), "lorem ipsum dolor " * 3000, "long") for _ in range(3)] + [(1, f"quid pro quo {i}", "shared") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(df, order=2)
    assert set(m.languages) == {r[2] for r in rows}
    got = {(r["lang"], r["lang_pred"]) for r in langid.identify(df, m).collect()}
    assert all(a == b for a, b in got)


def test_score_tells_unlearnt_languages_and_gibberish(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(1)
    bad = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz      ", k=k)) for k in (100, 300, 3000)] + ["Η γλώσσα αυτή δεν είναι γνωστή σε κανέναν από εδώ. " * 5, "Ten język jest tutaj nieznany nikomu, więc powinien zostać odrzucony. " * 6]
    m = langid.fit(docs)
    planted = langid.identify(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(bad)], "doc_id long, text string"), m).collect()
    assert all(r["score"] < 0.5 for r in planted)
    clean = langid.identify(docs.where("lang is not null and text is not null"), m)
    low = clean.where("score < 0.5 and lang_pred <> 'und'").count()
    assert low <= 0.002 * docs.count()


def test_odd_rows(spark, docs):
    df = docs.withColumn("Score", F.lit("clash"))
    out = langid.identify(df, langid.fit(df))
    assert out.count() == docs.count()
    und = {r["doc_id"] for r in out.collect() if r["lang_pred"] == "und" and r["score"] == 0}
    assert und == {3, 4, 5, 7}
    assert {r["lang_pred"] for r in langid.identify(df, langid.fit(df.limit(0))).collect()} == {"und"}
