import random
import re
from collections import Counter

import numpy as np
import xxhash
from sessionlake.llm import queries, simhash


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, f) in enumerate(rows):
        for b, g in rows[:i]:
            if (f ^ g).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d, _ in rows}


def test_query_equals_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {d: brute_fp(t) for d, t in texts.items()}
    want = brute_components(sorted(fps.items()))
    got = queries.op4_simhash(spark, sf).collect()
    assert {(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got} == {(d, f, want[d]) for d, f in fps.items()}


def test_dense_groups_and_chains(spark):
    rng = random.Random(3)
    rows = []
    for base in (rng.getrandbits(64) for _ in range(3)):
        rows += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(400)]
    chain = rng.getrandbits(64)
    for _ in range(60):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        rows.append(chain)
    rows += [rng.getrandbits(64) for _ in range(300)]
    rows = sorted(set(rows))
    rng.shuffle(rows)
    fps = spark.createDataFrame([(signed(f),) for f in rows], "fp long").repartition(5)
    want = brute_components([(signed(f), f) for f in sorted(rows, key=signed)])
    for bits, leaf in ((2, 4096), (2, 64), (1, 16), (3, 8)):
        nodes = simhash.components(simhash.near_pairs(fps, 4, bits, leaf)).collect()
        got = {r["node"]: r["component"] for r in nodes}
        assert {i: got.get(i, i) for i in want} == want


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_trees_lose_no_pair_and_follow_the_size():
    """Pairs within 4 bits meet at the home of one of them, whatever the trees; comparisons a fingerprint stay level."""
    rng = np.random.default_rng(4)
    costs = []
    for n in (20_000, 80_000):
        f = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        for i in range(0, n, 10):  # planted neighbours at distance 0 to 4
            flip = rng.choice(64, i // 10 % 5, replace=False)
            f[i + 1] = f[i] ^ np.uint64(sum(1 << int(b) for b in flip))
        trees = simhash.forest(f[::8], 8, 4, 128, 2)
        homes, meet = [set() for _ in range(n)], [set() for _ in range(n)]
        sizes, visitors = Counter(), Counter()
        for leaf, row, home in simhash.visits(f, trees, 4):
            for a, r in zip(leaf.tolist(), row.tolist(), strict=True):
                (homes if home else meet)[r].add(a)
            (sizes if home else visitors).update(leaf.tolist())
        assert all(len(h) == 3 for h in homes)
        for i in range(0, n, 10):
            a, b = i, i + 1
            assert homes[a] & homes[b] or homes[a] & meet[b] or meet[a] & homes[b]
        costs.append(sum(sizes[c] * (sizes[c] + visitors[c]) for c in sizes) / n)
    assert costs[1] < 1.7 * costs[0]


def test_unlike_texts_with_one_id_stay(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta", {"k": "v"}), (1, "one two three four five six seven eight nine ten", None), (2, "alpha beta gamma delta epsilon zeta eta theta", None), (2, "uno dos tres cuatro cinco seis siete", None), (None, "nobody owns this sentence at all here", None), (None, "nobody owns this sentence at all here", None), (3, "alpha beta gamma delta epsilon zeta eta theta", None), (3, "alpha beta gamma delta epsilon zeta eta theta", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __h map<string,string>")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()), key=repr)
    assert got == sorted([rows[0][:2], rows[1][:2], rows[3][:2], rows[4][:2]], key=repr)
    assert {(r["doc_id"], r["component_id"]) for r in simhash.groups(df).collect()} == {(1, 1), (2, 1), (2, 2), (None, None), (3, 1)}


def test_odd_rows(spark, docs):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.groups(docs).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (None, None)} <= got
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect())[:4] == [-1, 1, 3, 6]
    assert simhash.groups(docs.limit(0)).count() == 0


def test_long_text():
    text = " ".join(random.Random(1).choices(["a", "b", "cc", "É"], k=100_000))
    assert simhash.simhash(text.encode()) % (1 << 64) == brute_fp(text)
