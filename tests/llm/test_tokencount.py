import random

import pytest
from pyspark.sql import functions as F
from sessionlake.llm import queries, tokencount

ENCODE, LENGTHS = tokencount.vocabulary("byte_bpe_50k.tiktoken")


def brute(text, sections, rule):
    """Each token to a section, one by one."""
    data = (text or "").encode()
    at, counts = 0, [0] * len(sections)
    places = [len((text or "")[:i].encode()) for i in range(len(text or "") + 1)]
    bounds = [(places[min(max(a, 0), len(places) - 1)], places[min(max(b, 0), len(places) - 1)]) for a, b in sections]
    ids = ENCODE(text or "")
    for i in ids:
        n = int(LENGTHS[i])
        if rule == "start":
            for k, (a, b) in enumerate(bounds):
                counts[k] += a <= at < b
        else:
            shares = [max(0, min(at + n, b) - max(at, a)) for a, b in bounds]
            best = max(range(len(bounds)), key=lambda k: (shares[k], -bounds[k][0]), default=None)
            if best is not None and shares[best] and shares[best] >= n - sum(shares):
                counts[best] += 1
        at += n
    assert at == len(data)
    return len(ids), counts


def test_query_totals(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by = {}
    for r in queries.op7_token_counts(spark, sf).collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(texts)
    for d, rows in by.items():
        sections = [(r["start"], r["end"]) for r in sorted(rows, key=lambda r: r["line"])]
        assert "".join(texts[d][a:b] for a, b in sections) == texts[d]
        n, counts = brute(texts[d], sections, "start")
        assert [r["n_tokens"] for r in sorted(rows, key=lambda r: r["line"])] == counts and rows[0]["doc_tokens"] == n == sum(counts)


def test_rules_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(40):
        text = "".join(rng.choices(["a", "b", "é", "😀", " ", "\n", "the ", "token"], k=rng.randint(0, 60)))
        cuts = sorted(rng.sample(range(len(text) + 1), k=min(len(text) + 1, 6)))
        sections = list(zip(cuts[::2], cuts[1::2]))
        rng.shuffle(sections)
        rows.append((i, text, sections))
    rows += [(90, None, [(0, 5)]), (91, "", [(0, 0)]), (92, "abc", None), (93, "abc def", [(0, 99), (100, 120)]), (93, "abc def", [(0, 99), (100, 120)])]
    df = spark.createDataFrame([(i, t, None if s is None else [{"start": a, "end": b} for a, b in s]) for i, t, s in rows], "doc_id long, text string, s array<struct<start:long,end:long>>").withColumn("tokens", F.lit(1))
    for rule in tokencount.RULES:
        got = {r["doc_id"]: r["tokens"] for r in tokencount.attribute(df, F.col("s"), rule=rule).collect()}
        for i, t, s in rows:
            n, counts = brute(t, s or [], rule)
            assert (got[i]["doc_tokens"], got[i]["counts"], got[i]["outside"]) == (n, counts, n - sum(counts)), (rule, i, t, s)
    with pytest.raises(ValueError):
        tokencount.attribute(df, F.col("s"), rule="other")


def test_segments_change_nothing(monkeypatch):
    text = "".join(random.Random(3).choices(["word", " ", "\n", "\n\n", "Some text. ", "  x", "1", "é"], k=4000))
    whole = tokencount.spans(text, ENCODE, LENGTHS)
    monkeypatch.setattr(tokencount, "SEGMENT", 50)
    assert (tokencount.spans(text, ENCODE, LENGTHS) == whole).all()


def test_odd_rows(spark, docs):
    got = tokencount.attribute(docs.withColumn("lines", tokencount.lines("text")), F.col("lines"))
    assert got.count() == docs.count()
    assert tokencount.attribute(docs.limit(0), F.lit(None).cast("array<struct<start:long,end:long>>")).count() == 0
