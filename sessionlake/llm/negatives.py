"""Operator 11. Hard negatives by Four-Russians scoring.

Components become integers. For every group of eight dimensions an anchor gets a table of its 256 subset sums; a
candidate is packed into bit planes, a byte for each plane and group. The byte is the index into the anchor's table: the sum
of the eight products of that plane. Planes are added by shifting, the top one negative (two's complement), which gives the full
exact inner product. Tables of a block of anchors lie side by side, so that one lookup serves the block.

Anchors are dealt into rounds of about ``ROUND`` and sent to all tasks; each task scores its candidates against them block by block and
keeps the best few of each anchor, so that a round shuffles some rows per anchor and task. First the positives are
found, then, with their scores as windows, the negatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Anchors that are sent to all tasks at once (a table of them takes 1024 bytes for each group of dimensions and anchor), anchors of one lookup, candidates scored at once.
ROUND, ANCHORS, ROWS = 8192, 64, 2048
FOUND = "slot long, place int, score long, id long"


def whole_numbers(vectors: pa.Array, scale: float, dims: int | None = None) -> np.ndarray:
    """floor(scale * x) of each vector, one row each; cut or filled with zeros to ``dims`` components (those of the longest if None)."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(scale * pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64))
    if len(values) and np.abs(values).max() >= 2.0**62:
        raise OverflowError("components are too large for exact scores")
    dims = int(sizes.max(initial=0)) if dims is None else dims
    out = np.zeros((len(sizes), dims), np.int64)
    row, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[at < dims], at[at < dims]] = values[at < dims].astype(np.int64)
    return out


def planes(numbers: np.ndarray) -> np.ndarray:
    """Bit planes of rows of integers, lowest first, the last one being the sign: (plane, group of eight columns, row) -> byte."""
    bits = 1 + int(max(numbers.max(initial=0), -1 - numbers.min(initial=0))).bit_length()
    return np.stack([np.packbits((numbers >> p & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(bits)])


def subset_sums(numbers: np.ndarray) -> np.ndarray:
    """For each group of eight columns and each byte, the sum of the columns whose bits are set, of all rows: (group, byte, row)."""
    members = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
    filled = np.pad(numbers, ((0, 0), (0, -numbers.shape[1] % 8)))
    return np.stack([members @ filled[:, g : g + 8].T for g in range(0, filled.shape[1], 8)]) if filled.shape[1] else np.zeros((0, 256, len(numbers)), np.int64)


def scores(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products, a row for each candidate and a column for each anchor."""
    total = np.zeros((packed.shape[2], tables.shape[2]), tables.dtype)
    looked_up = np.empty_like(total)
    for p in range(len(packed) - 1, -1, -1):
        total <<= 1
        for table, index in zip(tables, packed[p], strict=True):
            np.take(table, index, axis=0, out=looked_up, mode="clip")
            if p == len(packed) - 1:
                total -= looked_up
            else:
                total += looked_up
    return total


class Best:
    """The best ``k`` distinct (score, id) of each of many slots: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int) -> None:
        self.k, self.slot, self.score, self.id = k, *np.zeros((3, 0), np.int64)
        self.least = np.full(slots, np.iinfo(np.int64).min)  # of what may still enter

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        slot, score, id_ = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, id_])
        order = np.lexsort((id_, -score, slot))
        slot, score, id_ = slot[order], score[order], id_[order]
        new = np.ones(len(slot), bool)
        new[1:] = (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (id_[1:] != id_[:-1])
        slot, score, id_ = slot[new], score[new], id_[new]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        self.slot, self.score, self.id = slot[rank < self.k], score[rank < self.k], id_[rank < self.k]
        full = rank == self.k - 1
        self.least[slot[full]] = score[full]


def search(anchors: pa.Table, scale: float, k: int, positives: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function: candidates (id, label, vector) -> the best k of each anchor (``positives``), or of each anchor and window ``low`` to ``high``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theirs = whole_numbers(anchors.column("vector").combine_chunks(), scale)
        ids, labels = anchors.column("id").to_numpy(), anchors.column("label").combine_chunks()
        known = pc.unique(labels)
        mine = pc.index_in(labels, value_set=known).to_numpy(zero_copy_only=False)
        blocks = [slice(at, at + ANCHORS) for at in range(0, len(ids), ANCHORS)]
        tables = [subset_sums(theirs[b]) for b in blocks]
        most = int(np.abs(theirs).max(initial=0)) * max(1, theirs.shape[1])
        windows = [np.zeros((len(ids), 1))] * 2 if positives else [np.array(anchors.column(c).to_pylist(), np.int64).reshape(len(ids), -1) for c in ("low", "high")]
        n = windows[0].shape[1]
        best = Best(len(ids) * n, k)
        narrow = [t.astype(np.int32) for t in tables] if most < 1 << 31 else tables
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                numbers = whole_numbers(part.column(2), scale, theirs.shape[1])
                packed, bound = planes(numbers), most * (1 + int(np.abs(numbers).max(initial=0)))
                if bound >= 1 << 61:
                    raise OverflowError("components are too large for exact scores")
                own, label = part.column(0).to_numpy(), pc.index_in(part.column(1), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                for b, table in zip(blocks, narrow if bound < 1 << 29 else tables, strict=True):
                    got, same = scores(table, packed), label[:, None] == mine[None, b]
                    for j in range(n):
                        slot = np.arange(b.start, b.start + got.shape[1]) * n + j
                        fits = got >= best.least[slot]
                        if positives:
                            fits &= same & (own[:, None] != ids[None, b])
                        else:
                            fits &= ~same & (got >= windows[0][b, j]) & (got <= windows[1][b, j])
                        row, column = np.nonzero(fits)
                        if len(row):
                            best.add(slot[column], got[row, column].astype(np.int64), own[row])
        slots = anchors.column("slot").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(slots[best.slot // n]), pa.array((best.slot % n).astype(np.int32)), pa.array(best.score), pa.array(best.id)], ["slot", "place", "score", "id"])

    return run


def best_of(rows: DataFrame, anchors: DataFrame, scale: float, k: int, positives: bool) -> DataFrame:
    """(slot, place, score, id, rank): the best k over all rows, a round of anchors at a time."""
    spark = rows.sparkSession
    rounds, found = 1 + anchors.count() // ROUND, None
    dealt = F.pmod(F.xxhash64("slot"), F.lit(rounds))
    for r in range(rounds):
        part = anchors.where(dealt == r).toArrow()  # about ROUND of them
        if part.num_rows:
            one = rows.mapInArrow(search(part, scale, k, positives), FOUND)
            found = one if found is None else found.union(one)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    order = Window.partitionBy("slot", "place").orderBy(F.desc("score"), "id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, label: str = "label", vector: str = "embedding", vec_id: str = "vec_id", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0) -> DataFrame:
    """For each anchor (rows for which the condition ``anchors`` holds) and each of its positives, the best negatives by rank: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    A score is the inner product of floor(scale * component). Positives: the first other rows (of other ids) of the same label. Negatives: the
    first rows of other labels that satisfy ``low * positive score <= 100 * score <= high * positive score``. Higher scores come first, ties by smaller id.
    Rows with a null id, label or vector, or a component that is null or not finite, take no part. An empty vector scores 0;
    of vectors of different lengths what the longer one has more counts as 0. Rows that repeat an id with the same score are found once; an anchor row that is repeated whole is one.
    An empty table, or one without anchors, gives an empty result. Vectors so large that a score could leave 61 bits are an error.
    """
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    used = vectors.where(whole & F.col(vec_id).isNotNull() & F.col(label).isNotNull())
    columns = [F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector")]
    asked = stored(used.where(anchors).select(*columns).distinct().withColumn("slot", F.monotonically_increasing_id()))
    rows = used.select(*columns)
    first = best_of(rows, asked, scale, positives, True).groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))  # at most ``positives`` each
    # Windows in whole numbers; a place without a positive gets one that nothing fits.
    filled = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.get(F.col("p"), i - 1))
    bounds = {"low": F.transform(filled, lambda p: F.coalesce(F.ceil(low * p["score"] / F.lit(100).cast("decimal(20,0)")).cast("long"), F.lit(1))), "high": F.transform(filled, lambda p: F.coalesce(F.floor(high * p["score"] / F.lit(100).cast("decimal(20,0)")).cast("long"), F.lit(0)))}
    ready = stored(asked.join(first, "slot").withColumns(bounds))
    second = best_of(rows, ready, scale, negatives, False)
    pair = F.get(F.col("p"), F.col("place"))
    out = second.join(ready.select("slot", F.col("id").alias("anchor_id"), "p"), "slot")
    return out.select("anchor_id", pair["id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"), pair["score"].alias("positive_score"), F.col("score").alias("negative_score"))
