"""Operator 3. Quality rules and robust multivariate outliers.

Every document gets counts of words, symbols, repeated lines and repeated word windows, and from them a vector of
transformed shares (``FEATURES``), stabilised by logarithm or arc sine. For each language and source a minimum-
covariance-determinant estimate describes the bulk of the vectors, as FAST-MCD finds it for large data:

* starts: on about ``START_ROWS`` distinct vectors of a group (chosen by hash), medians and many small random subsets are
  concentrated twice, and the best of them until nothing changes; the ``STARTS`` with the least determinants go on;
* concentration over all documents: the ``support`` share nearest to a centre is taken, its mean and covariance are
  computed. After two steps the start with the least determinant stays, and steps follow until no group's determinant
  changes any more.

To every covariance the sampling error of the statistics at the group's own text lengths is added (the error of a share
counted over n things, for instance; of a shorter text its own), so that shares which are nearly always 0 don't make every exception an outlier.
Distances are scaled so that their median is the one that normal data have. A document beyond the ``tail`` quantile is
rejected, as are those that fail the fixed rules.

All documents enter the steps, as partial sums and histograms of fixed resolution, so no group meets in one task.
Sources of under ``least`` documents are pooled by language; a pool of fewer has no estimate, and its documents are
judged by the fixed rules only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, per_row, put, stored

SYMBOLS = b"#*$%&|<>"
FEATURES = ("word_length", "symbol_share", "line_share", "repeat_share", "words_a_line")
D = len(FEATURES)
#: Distinct vectors of a group from which starts are made, small subsets that are tried, starts that go on; steps at most, and the change of a
#: log determinant that ends them.
START_ROWS, SUBSETS, STARTS, STEPS, SETTLED = 400, 40, 3, 40, 0.02
#: Chi-squared quantiles with 5 degrees of freedom: the median, and 1 - 1e-6.
MEDIAN, TAIL = 4.3515, 35.8882
#: Groups whose estimates are sent to all tasks, at most.
BROADCAST_GROUPS = 20_000
FIXED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def windows_twice(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window that occurs twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    _, pairs = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)
    _, at, count = np.unique(pairs[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True)
    cover = np.zeros(len(ids), bool)
    twice = count[at] > 1
    for k in range(3):
        cover[k : k + n] |= twice
    return int(cover.sum())


def statistics(text: bytes | None) -> dict:
    data = text or b""
    words = data.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    joined = b"".join(words)
    n_chars = len(joined) - len(joined.translate(None, bytes(range(0x80, 0xC0))))
    return {
        "n_words": len(words),
        "word_chars": len(joined) - n_chars,
        "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": windows_twice(ids),
        "n_lines": len(lines),
    }


KIND = pa.struct([(k, pa.int64()) for k in (*FIXED, "n_lines")])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with struct ``stats`` (replaces a column of that name). A null text has no words."""
    return put(docs, stats=per_row(lambda: statistics, "struct<" + ",".join(f"{k}:long" for k in (*FIXED, "n_lines")) + ">", KIND, F.col(text)))


def failed(s: str = "stats") -> Column:
    return (F.col(f"{s}.n_words") < 50) | (100 * F.col(f"{s}.n_repeat_words") > 50 * F.col(f"{s}.n_words"))


def vector(s: str = "stats") -> list[Column]:
    c = lambda k: F.col(f"{s}.{k}").cast("double")

    def share(a: Column, b: Column) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.when(b > 0, a / b).otherwise(0.0))))

    some = F.greatest(c("n_words"), F.lit(1.0))
    return [F.log(F.greatest(c("word_chars") / some, F.lit(0.1))), share(c("n_symbols"), c("word_chars")), share(c("n_dup_lines"), c("n_lines")), share(c("n_repeat_words"), c("n_words")), F.log(some / F.greatest(c("n_lines"), F.lit(1.0)))]


def errors(s: str = "stats") -> list[Column]:
    """The variance that each part of the vector has by chance in a text of this length. A repeated window of words makes six words repeat."""
    words, lines = (F.greatest(F.col(f"{s}.{k}").cast("double"), F.lit(1.0)) for k in ("n_words", "n_lines"))
    return [0.25 / words, 0.25 / words, 0.25 / lines, 1.5 / words, 1 / lines]


def joined(rows: DataFrame, by_group: DataFrame, many: bool) -> DataFrame:
    """rows with by_group's columns by ``g``; rows whose group it lacks get nulls. Few groups are broadcast, many are joined on a salted key."""
    if not many:
        return rows.join(F.broadcast(by_group), "g", "left")
    salted = by_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")).join(salted, ["g", "salt"], "left").drop("salt")


def quantile(rows: DataFrame, value: Column, share: float, steps: float, keys: tuple[str, ...] = ("g",)) -> DataFrame:
    """(keys, q): the upper edge of the bin, 1/steps wide, below which ``share`` of a group's values lie."""
    counts = rows.groupBy(*keys, F.floor(value * steps).alias("bin")).agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    every = F.sum("n").over(Window.partitionBy(*keys))
    return counts.select(*keys, "bin", (below >= share * every).alias("enough")).where("enough").groupBy(*keys).agg(((F.min("bin") + 1) / steps).alias("q"))


def distance(center: Column, precision: Column) -> Column:
    d = [F.col(f"x{i}") - center[i] for i in range(D)]
    out = F.lit(0.0)
    for i in range(D):
        for j in range(i, D):
            out = out + d[i] * d[j] * precision[i * D + j] * (1 if i == j else 2)
    return out


def concentrated(x: np.ndarray, floor: np.ndarray, h: int, center: np.ndarray, cov: np.ndarray, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(log determinant, centre, covariance) after so many steps, or when a step changes nothing."""
    before = None
    for _ in range(steps):
        off = x - center
        near = np.sort(np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off), kind="stable")[:h])
        if before is not None and (near == before).all():
            break
        before = near
        center, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True) + np.diag(floor)
    return float(np.linalg.slogdet(cov)[1]), center, cov


def fast_mcd(x: np.ndarray, floor: np.ndarray, support: float) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The best few estimates of (log determinant, centre, covariance) of a small set of vectors, the least determinant first."""
    x = x[np.lexsort(x.T)]
    h, rng = max(1, int(np.ceil(support * len(x)))), np.random.default_rng(0)
    middle = np.median(x, axis=0)
    tries = [(middle, np.diag((1.4826 * np.median(np.abs(x - middle), axis=0)) ** 2 + floor))]
    for _ in range(SUBSETS if len(x) > D + 1 else 0):
        some = x[rng.choice(len(x), D + 1, replace=False)]
        tries.append((some.mean(axis=0), np.cov(some.T, bias=True) + np.diag(floor)))
    short = sorted((concentrated(x, floor, h, c, v, 2) for c, v in tries), key=lambda t: t[0])[: 2 * STARTS]
    done, out = sorted((concentrated(x, floor, h, c, v, 100) for _, c, v in short), key=lambda t: t[0]), []
    for t in done:
        if all(abs(t[0] - o[0]) > 1e-9 or not np.allclose(t[1], o[1]) for o in out):
            out.append(t)
    return out[:STARTS]


def starts(rows: DataFrame, floors: DataFrame, many: bool, support: float) -> DataFrame:
    """(g, k, center, precision): the starts of each group, from a bounded number of its distinct vectors."""
    names = [f"x{i}" for i in range(D)]
    distinct = stored(rows.select("g", *names).distinct().withColumn("id", F.xxhash64(*names)))
    share = distinct.groupBy("g").agg((START_ROWS / F.count("*")).alias("share"))
    lot = F.pmod(F.xxhash64(F.lit("start"), "id"), F.lit(1 << 30)) / (1 << 30)
    some = joined(joined(distinct, share, many), floors, many).where(lot < F.col("share")).select("g", "floor", *names)
    kind = pa.schema([("g", pa.string()), ("k", pa.int32()), ("center", pa.list_(pa.float64())), ("precision", pa.list_(pa.float64()))])

    def one(t: pa.Table) -> pa.Table:
        x = np.stack([t.column(n).to_numpy() for n in names], axis=1)
        found = fast_mcd(x, np.array(t.column("floor")[0].as_py()), support)
        return pa.table([[t.column("g")[0].as_py()] * len(found), list(range(len(found))), [c.tolist() for _, c, _ in found], [np.linalg.inv(v).ravel().tolist() for _, _, v in found]], schema=kind)

    return some.groupBy("g").applyInArrow(one, "g string, k int, center array<double>, precision array<double>")


def shape(n: float | None, sums: list[float], squares: list[float], floor: list[float]) -> dict | None:
    """Centre, precision (row by row) and log determinant of a group's nearest documents."""
    if not n:
        return None
    mean = np.array(sums) / n
    cov = np.zeros((D, D))
    cov[np.triu_indices(D)] = np.array(squares) / n
    cov = cov + np.triu(cov, 1).T - np.outer(mean, mean) + np.diag(floor)
    return {"center": mean.tolist(), "precision": np.linalg.inv(cov).ravel().tolist(), "volume": float(np.linalg.slogdet(cov)[1])}


def estimates(rows: DataFrame, support: float, many: bool) -> DataFrame:
    """(g, floor, center, precision, scale, volume) of every group of ``rows`` (id, g, x0..., e0...); volume is the log determinant."""
    def small(df: DataFrame) -> DataFrame:
        """A table with a few rows per group: one file, unless groups are many."""
        return durable(df if many else df.coalesce(1))

    floors = small(rows.groupBy("g").agg(F.array(*[F.avg(f"e{i}") for i in range(D)]).alias("floor")))
    model = durable(starts(rows, floors, many, support)).withColumn("volume", F.lit(None).cast("double"))
    kind = pa.struct([("center", pa.list_(pa.float64())), ("precision", pa.list_(pa.float64())), ("volume", pa.float64())])
    log_d, xs = F.log(distance(F.col("center"), F.col("precision")) + 1e-3), [F.col(f"x{i}") for i in range(D)]
    for step in range(STEPS):
        by_group = model.groupBy("g").agg(F.collect_list(F.struct("k", "center", "precision")).alias("tries"))  # STARTS at most
        near = joined(rows, by_group, many).select("id", "g", *xs, F.explode("tries").alias("t")).select("id", "g", *xs, "t.*").withColumn("d", log_d)
        cuts = quantile(near, F.col("d"), support, 64, ("g", "k")).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", "q"))).alias("cuts"))
        inside = joined(near, cuts, many).where(F.col("d") <= F.col("cuts")[F.col("k")])
        sums = inside.groupBy("g", "k").agg(F.count("*").cast("double").alias("n"), F.array(*[F.sum(x) for x in xs]).alias("a"), F.array(*[F.sum(xs[i] * xs[j]) for i in range(D) for j in range(i, D)]).alias("b"))
        fitted = sums.join(floors, "g").select("g", "k", per_row(lambda: shape, "struct<center:array<double>,precision:array<double>,volume:double>", kind, F.col("n"), F.col("a"), F.col("b"), F.col("floor")).alias("e"))
        before, model = model, small(fitted.select("g", "k", "e.*"))
        if step == 1:  # the least determinant goes on
            model = model.groupBy("g").agg(F.min_by(F.struct("k", "center", "precision", "volume"), F.struct("volume", "k")).alias("m")).select("g", "m.*")
        elif step > 1:
            was = before.select("g", F.col("volume").alias("was"))
            if not model.join(was, "g").where(F.abs(F.col("volume") - F.col("was")) > SETTLED).limit(1).count():
                break
    middle = quantile(joined(rows, model, many).withColumn("d", log_d), F.col("d"), 0.5, 64)
    return small(model.join(middle, "g").join(floors, "g").select("g", "floor", "center", "precision", "volume", F.greatest(F.lit(1.0), F.exp("q") / MEDIAN).alias("scale")))


def own_distance(v: dict | None) -> float | None:
    """A document's distance with the larger of its group's and its own sampling errors; None for None."""
    if v is None:
        return None
    off, floor = np.array(v["x"]) - v["center"], np.array(v["floor"])
    cov = np.linalg.inv(np.reshape(v["precision"], (D, D))) + np.diag(np.maximum(np.array(v["e"]) - floor, 0))
    return float(off @ np.linalg.inv(cov) @ off / v["scale"])


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", support: float = 0.75, tail: float = TAIL, least: int = 40) -> DataFrame:
    """docs without their text, with struct ``stats``, ``base_failed``, ``distance`` (squared, scaled; null where there is no
    estimate) and ``kept``. These replace columns of the same names; any other names may be used.

    Null languages and sources are groups like others. A document that fails the fixed rules doesn't enter the estimates. A text of any length is
    counted whole, in memory of a few times its size. Rows that repeat a document count each. Ties: documents in the histogram bin of a cut are inside
    together. An empty table gives an empty result.
    """
    own = F.to_json(F.struct(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source")))
    pool = F.to_json(F.struct(F.col(lang).cast("string").alias("lang"), F.lit(True).alias("pooled")))
    kept = [c for c in docs.columns if c.lower() not in ("stats", "base_failed", "distance", "kept", text.lower())]
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text).alias("text"), own.alias("g"), pool.alias("pool"))
    known = put(measured(slim), base_failed=failed()).drop("text").withColumn("id", F.monotonically_increasing_id())
    known = stored(known.withColumns({f"x{i}": x for i, x in enumerate(vector())} | {f"e{i}": x for i, x in enumerate(errors())}))
    sizes = known.where(~F.col("base_failed")).groupBy("g", "pool").agg(F.count("*").alias("n"))
    pooled = F.sum(F.when(F.col("n") < least, F.col("n"))).over(Window.partitionBy("pool"))
    choice = durable(sizes.select("g", F.when(F.col("n") >= least, F.col("g")).when(pooled >= least, F.col("pool")).alias("to")))
    many = choice.count() > BROADCAST_GROUPS
    known = joined(known, choice, many).drop("g", "pool").withColumnRenamed("to", "g")
    found = joined(known, estimates(known.where(F.col("g").isNotNull() & ~F.col("base_failed")), support, many), many)
    far = distance(F.col("center"), F.col("precision")) / F.col("scale")
    # Short texts are judged by their own sampling errors; these are needed only beyond the tail.
    parts = F.struct(F.array(*[f"x{i}" for i in range(D)]).alias("x"), F.array(*[f"e{i}" for i in range(D)]).alias("e"), "center", "precision", "floor", "scale")
    found = found.withColumn("far", far)
    far = F.coalesce(per_row(lambda: own_distance, "double", pa.float64(), F.when(F.col("far") > tail, parts)), F.col("far"))
    good = ~F.col("base_failed") & F.coalesce(F.col("distance") <= tail, F.lit(True))
    found = found.select("row", "stats", "base_failed", far.alias("distance"))
    return found.select(*[F.col("row")[c].alias(c) for c in kept], "stats", "base_failed", "distance", good.alias("kept"))
