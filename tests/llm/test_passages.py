import zlib

import numpy as np
import pytest
from sessionlake.llm import passages, queries
from pyspark.sql import functions as F


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_score(model, text):
    """One document by the formulas, passage by passage."""
    p = {k: v.astype(np.float64) for k, v in model.weights.items()}
    words = text.split()
    n = max(1, -(-len(words) // passages.PASSAGE))
    hs, gates = [], []
    for k in range(n):
        part = words[k * len(words) // n : (k + 1) * len(words) // n]
        x = np.zeros(passages.WIDTH)
        for w in part:
            f = passages.features(w)
            x[f[0]] += 1
            x[f[1]] += 1
            x[2 * passages.BUCKETS : 2 * passages.BUCKETS + passages.COUNTS] += f[2:]
        x[-2] = sum(a == b for a, b in zip(part, part[1:], strict=False))
        x[-1] = len(part) - len(set(part))
        h = np.tanh(x / max(1, len(part)) @ p["W"] + p["b"])
        hs.append(h)
        gates.append(float((np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["w"]))
    a = np.exp(np.array(gates) - max(gates))
    z = (a / a.sum()) @ np.array(hs)
    return float(sigmoid(z @ p["c"] + p["c0"][0]))


@pytest.fixture(scope="module")
def learnt(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, passages.fit(docs, labels)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    x, first, y = rng.standard_normal((9, passages.WIDTH)), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])
    shapes = {"W": (passages.WIDTH, passages.HIDDEN), "b": (passages.HIDDEN,), "V": (passages.HIDDEN, passages.GATE), "U": (passages.HIDDEN, passages.GATE), "w": (passages.GATE,), "c": (passages.HIDDEN,), "c0": (1,)}
    model = passages.Model({k: rng.standard_normal(v) * 0.2 for k, v in shapes.items()})
    _, gradient = model.gradient(x, first, y)
    for k, w in model.weights.items():
        for _ in range(5):
            i = tuple(int(rng.integers(0, n)) for n in w.shape)
            before, e = w[i], 1e-5
            w[i] = before + e
            up = model.gradient(x, first, y)[0]
            w[i] = before - e
            down = model.gradient(x, first, y)[0]
            w[i] = before
            assert abs((up - down) / (2 * e) - gradient[k][i]) < 1e-6


def test_borders_and_repeats():
    for n in (0, 1, 63, 64, 65, 128, 129, 10_000):
        b = passages.borders(n).tolist()
        sizes = [y - x for x, y in zip(b, [*b[1:], n], strict=True)]
        assert b[0] == 0 and sum(sizes) == n and max(sizes) <= 64 and (n == 0 or min(sizes) >= min(n, 32))
    got = passages.repeats(np.array([5, 5, 7, 5, 1, 2, 3]), np.array([0, 4, 7]), np.array([4, 3, 0]))
    assert np.allclose(got, [[1 / 4, 2 / 4], [0, 0], [0, 0]])


def test_scores_equal_the_formulas(spark, learnt, docs, monkeypatch):
    model = learnt[2]
    texts = [r["text"] for r in learnt[0].limit(120).collect()]
    want = [plain_score(model, t) for t in texts]
    for words in (passages.WORDS, 50):  # also where the memory of words is cleared again and again
        monkeypatch.setattr(passages, "WORDS", words)
        got = [model.scores(passages.Words(model.of_words, passages.HIDDEN), [t.split()])[0] for t in texts]
        assert np.allclose(got, want, atol=1e-4)
    monkeypatch.undo()
    df = docs.withColumn("Score", F.lit("old")).withColumn("label", F.lit(1))
    rows = passages.classify(df, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert abs(r["score"] - plain_score(model, r["text"] or "")) < 1e-4


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in queries.op13_quality_classifier(spark, folder).collect()}
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    assert len(rows) == docs.count()
    right = {0: [0, 0], 1: [0, 0]}
    for r in labels.where("quality is not null").collect():
        held = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert rows[r["doc_id"]]["held_out"] == held and rows[r["doc_id"]]["predicted"] == (rows[r["doc_id"]]["score"] >= 0.3)
        if held:
            right[r["quality"]][rows[r["doc_id"]]["predicted"]] += 1
    assert right[0][0] >= 0.97 * sum(right[0]) and right[1][1] >= 0.99 * sum(right[1])


def test_one_bad_passage_of_a_long_document_decides(learnt):
    """Learnt from document labels alone, the gate finds the passage, wherever it lies."""
    docs, labels, _ = learnt
    good = [r["text"].split() for r in docs.join(labels, "doc_id").where("quality = 1 and n_chars > 500").orderBy("doc_id").collect()]
    rng = np.random.default_rng(5)
    texts, y = [], []
    for i in range(300):
        clean = [w for k in rng.integers(0, len(good), 6) for w in good[k]][:1500]
        at, junk = int(rng.integers(0, len(clean))), [w + "###" for w in good[int(rng.integers(0, len(good)))][:100]]
        texts.append(" ".join(clean[:at] + junk + clean[at:] if i % 2 else clean))
        y.append(1 - i % 2)
    model = passages.learn([passages.encode([t])[0] for t in texts[:240]], np.array(y[:240]))
    words = passages.Words(model.of_words, passages.HIDDEN)
    got = model.scores(words, [t.split() for t in texts[240:]])
    assert ((got >= 0.5) == np.array(y[240:])).mean() >= 0.95


def test_what_teaches_nothing(spark):
    kind, of = "doc_id long, text string", "doc_id long, quality int"
    docs = spark.createDataFrame([(1, "good text"), (2, None), (3, ""), (None, "x")], kind)
    none = passages.fit(docs, spark.createDataFrame([], of))
    assert [r["score"] for r in passages.classify(docs, none).collect()] == [0.5] * 4
    one = passages.fit(docs, spark.createDataFrame([(i, 1) for i in range(1, 4)] + [(None, 0), (4, None)], of))
    assert {r["score"] for r in passages.classify(docs, one).collect()} == {1.0}
    assert passages.classify(spark.createDataFrame([], kind), one).collect() == []
    assert passages.fit(spark.createDataFrame([], kind), spark.createDataFrame([(1, 1)], of)).weights["constant"] == 0.5


def test_bounds_of_the_sample(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 50) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(i, i % 2) for i in range(100)], "doc_id long, quality int")
    passages.fit(docs, labels, max_rows=10)
    seen = []
    learn, passages.learn = passages.learn, lambda bags, y: seen.append((len(bags), sum(map(len, bags)))) or learn(bags, y)
    try:
        passages.fit(docs, labels, max_rows=30)
        passages.fit(docs, labels, max_chars=4000)
    finally:
        passages.learn = learn
    assert seen[0] == (30, 30) and 5 <= seen[1][0] <= 11


def test_query_ignores_labels_and_columns_of_held_out_rows(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    for i, change in enumerate((lambda d, b: (d, b), lambda d, b: (d.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")}), b.withColumn("quality", F.when(passages.train_rows(), F.col("quality")).otherwise(1 - F.col("quality")))))):
        d, b = change(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")))
        d.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        b.write.parquet(f"{tmp_path}/{i}/labels.parquet")
    got = [sorted(map(tuple, queries.op13_quality_classifier(spark, f"{tmp_path}/{i}").collect())) for i in (0, 1)]
    assert got[0] == got[1] and len(got[0]) == 200
