"""Operator 8. Language identification by prediction by partial matching.

Each language has a variable-order byte context tree: for every context of up
to ``order`` bytes, the counts of the bytes that followed it. A byte is coded in
the longest context known to the language; a byte that is new there costs an
escape (method C: as probable as the number of distinct followers) and is coded
in the next shorter context, down to the uniform order -1. After ``fit`` the
statistics are frozen, so that a text's code length is an exact sum over its
bytes. The language with the shortest code wins.

Fitting reads a bounded sample of labelled rows: ``docs_per_lang`` rows per label (as expected values; fewer
where labels are so many that ``max_rows`` would be exceeded), chosen by a hash of id and text; of a text of more than
``max_chars`` characters a window that the hash chooses. Every label is learnt. The tree nodes are counted by
Spark; what reaches the driver and the tasks is bounded by that sample, not by the corpus.

A sixth of the sample of each label that has ``SPREAD_ROWS`` rows isn't learnt but coded: its bits a byte, and how they
spread at a given length, tell which texts are in no learnt language (``score``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, put, stored

UNDETERMINED = "und"
PAD = b"\n"
#: Bytes that are scored at once; bounds a task's memory whatever a text's length.
SEGMENT = 1 << 17
#: Languages of one set of trees. Rows of a label's sample from which some are kept to measure the spread.
SHARD, SPREAD_ROWS = 16, 12
#: Standard deviations above a language's own bits a byte at which a text is as likely in no learnt language.
FAR = 24.0


class Index:
    """Positions of distinct numbers: a hash table that is searched for many at once."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.append(keys, np.uint64(0))
        self.slots = np.full(1 << bits, len(keys), np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self.home(keys)
        while len(left):
            free = self.slots[at] == len(keys)
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each key, and the places in ``keys`` of those that are unknown."""
        none = len(self.keys) - 1
        at = self.home(keys)
        out = self.slots[at]
        open_ = np.flatnonzero((self.keys[out] != keys) & (out != none))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            out[open_] = self.slots[at[open_]]
            open_ = open_[(self.keys[out[open_]] != keys[open_]) & (out[open_] != none)]
        return out, np.flatnonzero(out == none)


@dataclass
class Level:
    """Order k: code lengths of known (context, byte) strings, and escape costs of known contexts, by language.

    Both arrays of costs have a last row for what is unknown.
    """

    grams: Index
    bits: np.ndarray
    contexts: Index
    escapes: np.ndarray


@dataclass
class Trees:
    """The trees of some languages."""

    languages: list[str]
    order: int
    levels: list[Level]

    def code_lengths(self, grams: np.ndarray, order: int | None = None) -> np.ndarray:
        """Bits of each string's last byte given the bytes before it, a column per language."""
        k = self.order if order is None else order
        if k < 0:
            return np.full((len(grams), len(self.languages)), 8.0, np.float32)
        level = self.levels[k]
        grams = grams & np.uint64((1 << (8 * (k + 1))) - 1)
        at, miss = level.grams.find(grams)
        out = level.bits[at]
        if len(miss):
            rest = grams[miss]
            at, _ = level.contexts.find(rest >> np.uint64(8))
            out[miss] = self.code_lengths(rest, k - 1) + level.escapes[at]
        return out


@dataclass
class Model:
    """All languages, by name. ``typical``: for each, bits a byte of its texts, and their variance at length n: second + third / n."""

    shards: list[Trees]
    typical: np.ndarray

    @property
    def languages(self) -> list[str]:
        return [x for s in self.shards for x in s.languages]

    def far(self, best: np.ndarray, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Standard deviations of code lengths above the typical one of language ``best``, for texts of n bytes."""
        mean, own, shared = self.typical[best].T
        return (bits / n - mean) / np.sqrt(own + shared / n)


def strings(data: np.ndarray, order: int) -> np.ndarray:
    """The order + 1 bytes that end at each position from ``order`` on, as numbers."""
    n = len(data) - order
    out = np.zeros(n, np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out


def train_rows(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """The rows that may be learnt from: crc32 of the id's text, modulo 4, is not 2."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) != 2


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", order: int = 4, docs_per_lang: int = 600, max_chars: int = 20_000, max_rows: int = 48_000) -> Model | None:
    """Trees from the labelled training rows of docs; None if there are none (an empty table among others).

    Rows whose text or lang is null, or whose id is null or held out, teach nothing. Rows that repeat both id and text are
    learnt together or not at all.
    """
    known = docs.where(train_rows(docs, doc_id) & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t"), F.col(doc_id).alias("i"))
    sizes = stored(known.groupBy("l").agg(F.count("*").alias("n")))
    labels = sizes.count()
    if not labels:
        return None
    each = max(1, min(docs_per_lang, max_rows // labels))
    draw = lambda name, among: F.pmod(F.xxhash64(F.lit(name), "i", "t"), among)
    lot = draw("langid", F.lit(1_000_003)) / F.lit(1_000_003.0)
    window = F.when(F.length("t") > max_chars, F.substr("t", (1 + draw("window", F.length("t") - max_chars + 1)).cast("int"), F.lit(max_chars))).otherwise(F.col("t"))
    share = F.greatest(F.lit(1), F.lit(each)) / F.col("n")
    spread = (F.least("n", F.lit(each)) >= SPREAD_ROWS) & (draw("spread", F.lit(6)) == 0)
    sample = stored(known.join(sizes, "l").where(lot < share).select("l", window.alias("t"), spread.alias("spread")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(by: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for name, parts in by.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n)], ["l", "g", "n"])

        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            held = 0
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(strings(np.frombuffer(PAD * order + t.encode(), np.uint8), order))
                held += len(by[name][-1])
                if held >= 8 * SEGMENT:  # counts of parts add up
                    yield from counted(by)
                    by, held = {}, 0
            yield from counted(by)

    learnt = sample.where("not spread and t <> ''").select("l", "t")
    rows = learnt.mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()
    if not rows.num_rows:
        return None
    model = build(rows, order)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {x: i for i, x in enumerate(shared.value.languages)}
        for b in batches:
            pairs = [(at[x], t.encode()) for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if x in at]
            bits = totals(shared.value, [t for _, t in pairs])
            n = [len(t) for _, t in pairs]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int32()), pa.array([bits[i, k] for i, (k, _) in enumerate(pairs)], pa.float64()), pa.array(n, pa.float64())], ["k", "bits", "n"])

    coded = sample.where("spread and t <> ''").select("l", "t").mapInArrow(code, "k int, bits double, n double").toArrow()
    model.typical = typical(*(coded.column(c).to_numpy() for c in ("k", "bits", "n")), len(model.languages))
    return model


def typical(k: np.ndarray, bits: np.ndarray, n: np.ndarray, languages: int) -> np.ndarray:
    """Model.typical from coded texts. Languages with fewer than two of them get what all languages have together; without any text, a spread without bound."""
    out = np.tile([0.0, np.inf, 0.0], (languages, 1))
    for i in (None, *np.unique(k)):
        mine = k == i if i is not None else np.ones(len(k), bool)
        if mine.sum() < 2:
            continue
        rate, size = bits[mine] / n[mine], n[mine]
        mean = bits[mine].sum() / size.sum()
        off = (rate - mean) ** 2
        # Medians of squared deviations (0.455: of a squared normal one), so that odd texts of the sample don't count.
        out[slice(None) if i is None else i] = mean, np.median(off) / 0.455, max(np.median(off * size) / 0.455, 1e-6)
    return out


def build(rows: pa.Table, order: int) -> Model:
    names = rows.column("l").combine_chunks().dictionary_encode()
    languages = sorted(names.dictionary.to_pylist())
    place = {x: i for i, x in enumerate(languages)}
    which = np.array([place[x] for x in names.dictionary.to_pylist()])[names.indices.to_numpy()]
    grams, n = rows.column("g").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
    shards = []
    for at in range(0, len(languages), SHARD):
        mine = (which >= at) & (which < at + SHARD)
        shards.append(trees(languages[at : at + SHARD], which[mine] - at, grams[mine], n[mine], order))
    return Model(shards, np.tile([0.0, np.inf, 0.0], (len(languages), 1)))


def trees(languages: list[str], which: np.ndarray, grams: np.ndarray, n: np.ndarray, order: int) -> Trees:
    model = Trees(languages, order, [])
    for k in range(order + 1):
        mask = np.uint64((1 << (8 * (k + 1))) - 1)
        keys, at = np.unique(grams & mask, return_inverse=True)
        counts = np.zeros((len(keys), len(languages)))
        np.add.at(counts, (at, which), n)
        contexts, up = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, distinct = np.zeros((2, len(contexts), len(languages)))
        np.add.at(total, up, counts)
        np.add.at(distinct, up, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escapes = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0)
            seen = -np.log2(counts / (total + distinct)[up])
        lower = model.code_lengths(keys, k - 1)
        bits = np.where(counts > 0, seen, escapes[up] + lower)
        unknown = np.zeros((1, len(languages)))
        model.levels.append(Level(Index(keys), np.vstack([bits, unknown]).astype(np.float32), Index(contexts), np.vstack([escapes, unknown]).astype(np.float32)))
    return model


def totals(model: Model, texts: list[bytes]) -> np.ndarray:
    """Code length of each whole text in each language, in bits. Long texts are scored in segments."""
    return np.hstack([coded(t, texts) for t in model.shards])


def coded(model: Trees, texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), len(model.languages)))
    k, group, held = model.order, [], 0

    def score() -> None:
        nonlocal group, held
        data = np.frombuffer(b"".join(x for _, x in group), np.uint8)
        grams, ends, keep = strings(data, k), np.cumsum([len(x) for _, x in group]), np.ones(len(data) - k, bool)
        for e in ends[:-1]:  # strings that span two texts
            keep[max(0, e - k) : e] = False
        bits = model.code_lengths(grams[keep])
        starts = np.cumsum([0, *(len(x) - k for _, x in group)])
        sums = np.add.reduceat(bits, starts[:-1], axis=0, dtype=np.float64)
        np.add.at(out, [i for i, _ in group], sums)
        group, held = [], 0

    for i, t in enumerate(texts):
        for at in range(0, len(t), SEGMENT):
            before = t[max(0, at - k) : at].rjust(k, PAD)
            group.append((i, before + t[at : at + SEGMENT]))
            held += len(group[-1][1])
            if held >= SEGMENT:
                score()
    if group:
        score()
    return out


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with ``lang_pred`` and ``score``, which replace columns of these names. The score, 0 to 1, is the winner's share of the languages'
    probabilities, times how like its language the text is: 1/2 where it needs ``FAR`` standard deviations more bits a byte than usual.

    A null text, one without a letter (empty, digits, signs) and every text if no language was learnt get
    ``und`` and 0. Languages with equal code lengths: the first by name. Texts of any length are coded whole, in segments.
    Rows that repeat a text are treated alike. An empty table gives an empty result. Works row by row; no shuffle.
    """
    if model is None:
        return put(docs, lang_pred=F.lit(UNDETERMINED), score=F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for a in batches:
            langs: list[str] = []
            scores: list[float] = []
            for at in range(0, len(a), 512):
                part = a.slice(at, 512)
                texts = [(x.as_py() or "").encode() for x in part]
                bits = totals(m, texts)
                best = bits.argmin(axis=1)
                rest = np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
                langs += [m.languages[b] for b in best]
                n = np.array([max(1, len(t)) for t in texts])
                near = 1 / (1 + np.exp(np.clip(m.far(best, bits[np.arange(len(texts)), best], n) - FAR, -50, 50)))
                scores += (near / rest).tolist()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    predict.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    guess = F.arrow_udf(predict, "lang string, score double")(F.when(lettered, F.col(text)))
    p, some = fresh(docs, "p", "l")
    df = docs.withColumns({p: guess, some: lettered})
    return put(
        df,
        lang_pred=F.when(F.col(some), F.col(p)["lang"]).otherwise(UNDETERMINED),
        score=F.when(F.col(some), F.col(p)["score"]).otherwise(0.0),
    ).drop(p, some)
