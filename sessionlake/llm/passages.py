"""Operator 13. A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of about ``PASSAGE`` words; only the document has a label. Every passage is encoded: the means over its words
of hashed words, hashed shapes (letters, capitals and digits as one sign each, runs cut short) and counts of kinds of characters, and how much it repeats, go
through a learnt layer, h = tanh(x W + b). A gate weighs passages, a = softmax(w (tanh(h V) * sigmoid(h U))) within the document, and the
document's score is that of the weighted sum of h. All of it is learnt together from document labels, so that a
bad passage of a long document can decide without being marked.

The fit reads a bounded sample of labelled rows: ``max_rows`` at most, the first by a hash, and of these as many as have ``max_chars``
characters in total. Scoring is row by row; the layer is linear in the words, so that a word's share of it is looked up.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, put, stored

PASSAGE, BUCKETS, HIDDEN, GATE = 64, 256, 32, 16
#: Kinds of characters that are counted: letters, capitals, digits, others; then shares of words that repeat the one before or any of the passage.
COUNTS, REPEATS = 4, 2
WIDTH = 2 * BUCKETS + COUNTS + REPEATS
#: Words that a Python worker remembers at most. Characters whose documents are scored together.
WORDS, TEXTS = 200_000, 1 << 19
EPOCHS, STEPS, BATCH, RATE, DECAY = 14, 1200, 32, 0.004, 1e-3


class Shapes(dict):
    """For str.translate: a for small and caseless letters, A for capitals, 9 for digits; other characters stay."""

    def __missing__(self, c: int) -> str:
        x = chr(c)
        self[c] = "A" if x.isupper() else "a" if x.isalpha() else "9" if x.isdigit() else x
        return self[c]


SHAPES, RUN = Shapes(), re.compile(r"(.)\1+", re.S)


def features(word: str) -> tuple[int, int, int, int, int, int]:
    """Buckets of the word and of its shape, and its counts."""
    shape = word.translate(SHAPES)
    small, capital, digit = shape.count("a"), shape.count("A"), shape.count("9")
    return zlib.crc32(word.encode()) % BUCKETS, BUCKETS + zlib.crc32(RUN.sub(r"\1", shape).encode()) % BUCKETS, small, capital, digit, len(shape) - small - capital - digit


class Words:
    """Numbers of words, and a row of values for each: what ``of`` makes of their features (a row of six numbers each)."""

    def __init__(self, of: Callable[[np.ndarray], np.ndarray], width: int, dtype: type = np.float32) -> None:
        self.of, self.rows, self.number = of, np.zeros((1024, width), dtype), {}

    def look_up(self, words: list[list[str]]) -> list[np.ndarray]:
        get = self.number.get
        out = [np.fromiter(map(get, ws, repeat(-1)), np.int64, len(ws)) for ws in words]
        missing = [np.flatnonzero(x < 0) for x in out]
        new = list({ws[i] for ws, at in zip(words, missing, strict=True) for i in at.tolist()})
        if len(self.number) + len(new) > WORDS and self.number:
            self.number = {}
            return self.look_up(words)
        if new:
            at = len(self.number)
            if at + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((at + 2 * len(new), self.rows.shape[1]), self.rows.dtype)])
            self.rows[at : at + len(new)] = self.of(np.array(list(map(features, new)), np.int64))
            self.number.update(zip(new, range(at, at + len(new)), strict=True))
            for x, ws, at in zip(out, words, missing, strict=True):
                x[at] = [self.number[ws[i]] for i in at.tolist()]
        return out


def borders(n: int) -> np.ndarray:
    """Where the passages of n words begin: about PASSAGE words each, one at least."""
    passages = max(1, -(-n // PASSAGE))
    return np.arange(passages) * n // passages


def repeats(numbers: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each passage: the shares of words that equal the one before, and that came before in the passage."""
    out = np.zeros((len(starts), REPEATS), np.float32)
    if len(numbers):
        at = np.arange(PASSAGE)
        words = numbers[np.minimum(starts[:, None] + at, len(numbers) - 1)]
        words[at >= sizes[:, None]] = -1
        least = np.maximum(sizes, 1)
        for k in range(REPEATS):  # in order, then sorted
            out[:, k] = ((words[:, 1:] == words[:, :-1]) & (words[:, 1:] >= 0)).sum(axis=1) / least
            words = np.sort(words, axis=1)
    return out


def bags(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of some documents, starts and sizes of their passages, and each document's first passage."""
    starts, first, at, n = [], [], 0, 0
    for x in numbers:
        starts.append(borders(len(x)) + at)
        first.append(n)
        at, n = at + len(x), n + len(starts[-1])
    begins = np.concatenate(starts)
    return np.concatenate(numbers), begins, np.diff(np.append(begins, at)), np.array(first)


def sums(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of the rows of each part; an empty part has zeros."""
    out = np.zeros((len(starts), *rows.shape[1:]), np.float32)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(rows, starts[some], axis=0)
    return out


@dataclass
class Model:
    """Weights: layer (WIDTH x HIDDEN) and its shift, gates V and U (HIDDEN x GATE), w (GATE), class (HIDDEN) and its shift. Without layer: a constant."""

    weights: dict[str, np.ndarray]

    def logits(self, pre: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict]:
        """Of documents, from their passages' layer sums; with what the gradient needs."""
        p = self.weights
        h = np.tanh(pre)
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        g = (t * s) @ p["w"]
        sizes = np.diff(np.append(first, len(h)))
        doc = np.repeat(np.arange(len(first)), sizes)
        e = np.exp(g - np.maximum.reduceat(g, first)[doc])
        a = e / np.add.reduceat(e, first)[doc]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return z @ p["c"] + p["c0"], {"h": h, "t": t, "s": s, "a": a, "z": z, "doc": doc}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and its gradient for documents of passages x."""
        p = self.weights
        logit, k = self.logits(x @ p["W"] + p["b"], first)
        score = 1 / (1 + np.exp(-logit))
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        d = (score - y) / len(y)
        dz = d[:, None] * p["c"]
        da = (k["h"] * dz[k["doc"]]).sum(axis=1)
        dg = k["a"] * (da - np.add.reduceat(k["a"] * da, first)[k["doc"]])
        dts = dg[:, None] * p["w"]
        dt, ds = dts * k["s"] * (1 - k["t"] ** 2), dts * k["t"] * k["s"] * (1 - k["s"])
        dh = k["a"][:, None] * dz[k["doc"]] + dt @ p["V"].T + ds @ p["U"].T
        dpre = dh * (1 - k["h"] ** 2)
        return loss, {"W": x.T @ dpre, "b": dpre.sum(axis=0), "V": k["h"].T @ dt, "U": k["h"].T @ ds, "w": (k["t"] * k["s"]).T @ dg, "c": k["z"].T @ d, "c0": d.sum(keepdims=True)}

    def of_words(self, f: np.ndarray) -> np.ndarray:
        """Shares of words in the layer, from their features."""
        w = self.weights["W"]
        return w[f[:, 0]] + w[f[:, 1]] + f[:, 2:].astype(np.float32) @ w[2 * BUCKETS : 2 * BUCKETS + COUNTS]

    def scores(self, words: Words, texts: list[list[str]]) -> np.ndarray:
        numbers, starts, sizes, first = bags(words.look_up(texts))
        means = sums(words.rows[numbers], starts, sizes) / np.maximum(sizes, 1)[:, None]
        pre = means + repeats(numbers, starts, sizes) @ self.weights["W"][-REPEATS:] + self.weights["b"]
        return 1 / (1 + np.exp(-self.logits(pre, first)[0].astype(np.float64)))


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Plain encodings of all passages of documents, a row each, and each document's first passage."""
    words = Words(lambda f: f, 2 + COUNTS, np.int64)
    numbers, starts, sizes, first = bags(words.look_up([t.split() for t in texts]))
    f, passage = words.rows[numbers], np.repeat(np.arange(len(starts)), sizes)
    x = np.zeros((len(starts), WIDTH), np.float32)
    for k in (0, 1):
        np.add.at(x, (passage, f[:, k]), 1)
    x[:, 2 * BUCKETS : 2 * BUCKETS + COUNTS] = sums(f[:, 2:], starts, sizes)
    x /= np.maximum(sizes, 1)[:, None]
    x[:, -REPEATS:] = repeats(numbers, starts, sizes)
    return x, first


def learn(bags_: list[np.ndarray], labels: np.ndarray, seed: int = 13) -> Model:
    """Adam over minibatches of documents, with decay; inputs are centred and scaled, which is then folded into the layer."""
    rng = np.random.default_rng(seed)
    x = np.concatenate(bags_)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.02)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    p = {"W": draw(WIDTH, HIDDEN) * 0.3, "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "c0": np.array([np.log(share / (1 - share))], np.float32)}
    model, m, v, n = Model(p), {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
    each = -(-len(bags_) // BATCH)
    steps = each * max(EPOCHS, -(-STEPS // each))  # small samples are seen more often
    for _ in range(steps // each):
        order = rng.permutation(len(bags_))
        for at in range(0, len(order), BATCH):
            mine = order[at : at + BATCH]
            some = (np.concatenate([bags_[i] for i in mine]) - mean) / scale
            first = np.cumsum([0, *(len(bags_[i]) for i in mine[:-1])])
            _, gradient = model.gradient(some, first, labels[mine].astype(np.float32))
            n += 1
            rate = RATE * (1 - n / (steps + 1))
            for k, g in gradient.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * ((m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8) + (DECAY * p[k] if k in "WVU" else 0))
    p["b"] = p["b"] - (mean / scale) @ p["W"]
    p["W"] = p["W"] / scale[:, None].astype(np.float32)
    return model


def train_rows(doc_id: str = "doc_id") -> Column:
    """The rows that may be learnt from: crc32 of the id's text, modulo 5, is not 0."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) != 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", max_rows: int = 4000, max_chars: int = 24_000_000) -> Model:
    """Learns ``label`` (1 or another number) of ``labels`` for the documents of these ids.

    Rows with a null id, text or label, and held-out ones (``train_rows``), teach nothing. An id with several labels or texts is learnt with each. Without both
    classes the model is a constant: the share of ones, 1/2 without rows. ``labels`` is sampled by a hash of its ids before the
    documents are joined, which moves the sample's texts only; it is what the driver and the tasks get to see.
    """
    known = labels.where(train_rows(doc_id) & F.col(label).isNotNull()).select(F.col(doc_id).alias("i"), (F.col(label) == 1).cast("int").alias("y"))
    ids = known.distinct().orderBy(F.xxhash64("i"), "i", "y").limit(max_rows)
    found = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(ids), "i")  # max_rows ids
    sample = stored(found.withColumns({"n": F.length("t").cast("long"), "k": F.xxhash64("i", "t")}))
    first = sample.select("k", "i", "y", "n").orderBy("k", "i", "y").limit(max_rows)
    total = F.sum("n").over(Window.orderBy("k", "i", "y").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # of max_rows rows
    kept = first.withColumn("total", total).where((F.col("total") <= max_chars) | (F.col("total") == F.col("n"))).select("k", "i", "y").distinct()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([y], pa.int32()), pa.array([encode([t])[0].tobytes()], pa.binary())], ["k", "y", "x"])

    rows = sample.join(F.broadcast(kept), ["k", "i", "y"]).select("k", "y", "t").mapInArrow(encoded, "k long, y int, x binary").toArrow().sort_by([("k", "ascending"), ("y", "ascending")])
    y = rows.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model({"constant": np.array(share)})
    return learn([np.frombuffer(x.as_py(), np.float32).reshape(-1, WIDTH) for x in rows.column("x")], y)


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``score`` (0 to 1, higher: label 1 is likelier), which replaces a column of that name.

    A null text counts as empty; a text without words is one passage without features. Texts of any length are read whole; a long one takes memory in
    proportion to its words. Rows that repeat a text are treated alike. An empty table gives an empty result. Works row by row; no shuffle.
    """
    if "constant" in model.weights:
        return put(docs, score=F.lit(float(model.weights["constant"])))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        words = Words(m.of_words, HIDDEN)
        for texts in batches:
            out, group, held = [np.zeros(0)], [], 0
            for i, t in enumerate(texts):
                group.append((t.as_py() or "").split())
                held += len(t.as_py() or "")
                if held >= TEXTS or i == len(texts) - 1:
                    out.append(m.scores(words, group))
                    group, held = [], 0
            yield pa.array(np.concatenate(out))

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    (s,) = fresh(docs, "score")
    return put(docs.withColumn(s, F.arrow_udf(score, "double")(F.col(text))), score=F.col(s)).drop(s)
