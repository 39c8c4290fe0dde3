import hashlib
import random
import re
import time
import tracemalloc

import numpy as np
from sessionlake.llm import decontam, queries
from pyspark.sql import functions as F


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    widths = {len(w) for w in windows}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in widths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        yield d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {tuple(r)[:6] for r in queries.op6_decontamination(spark, sf).collect()}
    assert got == set(brute(docs, items))


def longest_brute(text, items):
    """Words of the longest common run of a document and an item that holds a window."""
    a, best = words(text), 0
    for t in items:
        b = words(t)
        least = min(13, len(b))
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, n if least and n >= least else 0)
    return best


def test_a_benchmark_of_a_hundred_blocks(spark, sf):
    """Beyond block_bytes the benchmark is joined by key; the result is the same."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").withColumn("row", F.lit(1))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").cast("string").alias("item_id"), "text").union(docs.where("doc_id % 3 = 0").select(F.concat(F.lit("d"), "doc_id"), "text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0]
    rows = lambda m: sorted((r["doc_id"], r["match"]["n_words"], tuple(map(tuple, r["match"]["spans"])), tuple(r["match"]["items"]), r["match"]["longest"]) for r in m.collect())
    a, b = decontam.matches(docs, bench), decontam.matches(docs, bench, block_bytes=size // 100)
    assert rows(a) == rows(b) and b.columns == ["doc_id", "text", "row", "match"]


def test_many_places_of_one_window():
    """A window that is in many items and often in the document takes time in proportion to both, not to their product."""
    items = [([f"i{k}"], (b"a " * 13) + b"x%d " % k * 3) for k in range(3000)]
    s = decontam.Suffixes(items, 13)
    doc = s.words(b"a " * 20_000 + b"x7 x7 x7 q")
    at, which = s.occurrences(doc)
    began = time.perf_counter()
    assert decontam.longest(at, which, s, doc) == (16, "i7", 19_987, 0)
    assert time.perf_counter() - began < 20


def test_small_alphabet_blocks_and_shards(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices("abC", k=rng.choice([0, 1, 3, 13, 14, 20])))) for i in range(8)] + [(2, "a b c a b c"), (9, None), (None, "a b")]
    docs = [(i, "-".join(rng.choices("abcd", k=rng.choice([0, 2, 40, 300])))) for i in range(30)] + [(30, None), (31, "é a É"), (3, "dup"), (3, "dup")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("match", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, [(i, t) for i, t in items if i is not None]))
    longest = {}
    for size in (1 << 20, 30):
        m = decontam.matches(d, b, block_bytes=size)
        longest[size] = sorted((r["doc_id"], r["n"]) for r in m.select("doc_id", F.col("match.longest").alias("n")).collect())
        got = m.select("doc_id", "match.n_words", decontam.n_hit(), F.size("match.items"), decontam.items_digest(), decontam.contaminated()).collect()
        assert sorted(map(tuple, got)) == want
    assert longest[30] == longest[1 << 20] == sorted((i, longest_brute(t, [x for k, x in items if k is not None])) for i, t in docs)
    assert decontam.clean(d, b).columns == d.columns
    assert decontam.matches(d, b.limit(0)).where(decontam.contaminated()).count() == 0
    assert decontam.matches(d.limit(0), b).count() == 0


def test_longest_match_and_shards(monkeypatch):
    monkeypatch.setattr(decontam, "SHARD", 7)
    monkeypatch.setattr(decontam, "SEGMENT", 40)
    item = " ".join(f"w{i}" for i in range(40))
    s = decontam.Suffixes([(["x"], item.encode())], 13)
    text = "pre " + " ".join(f"w{i}" for i in range(5, 35)) + " post w0 w1"
    words_ = s.words(text.encode())
    at, which = s.occurrences(words_)
    assert decontam.longest(at, which, s, words_) == (30, "x", 1, 5)


def test_odd_rows(spark, docs):
    b = spark.createDataFrame([("i", "the cat sat on the mat and then it ran away from the big dog")], "item_id string, text string")
    kept = decontam.clean(docs, b)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 3, 4, 5, 6, 7, 8]


def test_suffix_ranks_order_all_suffixes():
    rng = np.random.default_rng(3)
    for n, kinds in ((0, 2), (1, 2), (50, 2), (200, 1), (300, 40)):
        words = rng.integers(0, kinds, n)
        rank = decontam.suffix_ranks(words)
        assert [tuple(words[i:]) for i in np.argsort(rank)] == sorted(tuple(words[i:]) for i in range(n))


def test_longest_matches_of_repetitive_items_equal_brute_force():
    rng = random.Random(6)
    some = lambda n: [rng.choice("ab") if rng.random() < 0.1 else "a" for _ in range(n)]
    items = [some(rng.randrange(3, 120)) for _ in range(30)]
    s = decontam.Suffixes([([f"i{k}"], " ".join(x).encode()) for k, x in enumerate(items)], 4)
    for _ in range(60):
        doc = some(rng.randrange(4, 90)) + [rng.choice("xab")]
        words = s.words(" ".join(doc).encode())
        at, which = s.occurrences(words)
        got = decontam.longest(at, which, s, words)
        best = (0, None, -1, -1)
        for i in range(len(doc)):
            for k, x in enumerate(items):
                for p in range(len(x)):
                    n = 0
                    while i + n < len(doc) and p + n < len(x) and doc[i + n] == x[p + n]:
                        n += 1
                    if n >= min(4, len(x)) and n > best[0]:
                        best = (n, f"i{k}", i, p)
        assert got == best


def test_an_item_of_a_million_equal_words_takes_memory_in_proportion():
    s = decontam.Suffixes([(["x"], b"no " * 1_000_000), (["y"], b"no " * 12 + b"end")], 13)
    tracemalloc.start()
    words = s.words(b"see " + b"no " * 5000 + b"yes " + b"no " * 12 + b"end")
    at, which = s.occurrences(words)
    assert decontam.longest(at, which, s, words) == (5000, "x", 1, 0)
    assert decontam.match_all([b"no " * 20_000], s)[0]["longest"] == 20_000
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
