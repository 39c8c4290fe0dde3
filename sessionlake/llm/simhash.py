"""Operator 4. SimHash near-duplicates by vantage-point trees.

Fingerprint: 64 majority bits over the XXH64 values (seed 42) of a text's word
shingles. Fingerprints that differ in at most ``radius`` (4) bits are linked, and
links make components.

Exact links come from a forest of vantage-point trees under the Hamming distance:

* Over all 64 bits, distances to any vantage point crowd around 32 (standard
  deviation 4), and a triangle bound of 4 keeps more than half of all branches. So
  the bits are split into ``radius // 2 + 1`` bands: two fingerprints within
  ``radius`` are within ``radius // bands`` (1) in one band at least, and each band
  has its own tree with that smaller radius.
* A tree is grown from a bounded sample (an eighth of the fingerprints, about
  ``sample_rows`` at most). A node measures distances on ``block_bits`` of the bits
  that no node above it used, those that its part of the sample splits best, to a
  vantage point of that sample: the one with the most even shells. Shells of equal
  distance are its branches. On disjoint bits the triangle bounds add up, so a query
  that moves d shells away at one node has d less left for the nodes below.
* A node is split until about ``leaf_rows`` fingerprints are left, so that depth
  follows the table's size. Every fingerprint lives in one leaf per tree and is sent
  as a query to the leaves whose boundary it overlaps; only outward ones (the other
  of a pair sends itself the other way, or the leaf is the same).
* Inside a leaf whole fingerprints are compared. It gives a bounded number of links a
  row, never all pairs of a dense group. Leaves that came out far larger than planned
  are split into blocks that meet each other in tasks of their own.

Components come from star contraction (each round one join and one minimum), in
rounds written to the shared folder; a round is deleted when the next one is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, per_row, put, remove, scratch, stored

RADIUS = 4
#: Fingerprints that a leaf is meant to hold, and those that trees are grown from at most, on average; a leaf of LARGE times as many rows (with visitors) is split.
LEAF_ROWS, SAMPLE_ROWS, LARGE = 512, 1 << 18, 16
#: Shingles that are hashed at once.
CHUNK = 1 << 15


def simhash(text: bytes | None, words: int = 4) -> int:
    """Fingerprint as a signed 64-bit number. Fewer words than a shingle has: one shingle of them all; none: 0."""
    parts = (text or b"").lower().split()  # on bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    ones, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        hashes = np.array([h(joined[a:b], 42) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``fp`` (long; replaces a column of that name). A null text counts as empty."""
    return put(docs, fp=per_row(lambda: simhash, "long", pa.int64(), F.col(text)))


def bands(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each band; a pair within the radius is within radius // len(bands) in one of them."""
    n = radius // 2 + 1
    return [(64 * i // n, 64 * (i + 1) // n - 64 * i // n) for i in range(n)]


@dataclass
class Tree:
    """A node: bits it measures on, its vantage point, its first child (the one of distance 0; -1: a leaf)."""

    mask: np.ndarray
    vantage: np.ndarray
    child: np.ndarray


def even_shells(points: np.ndarray) -> int:
    """Which of the points has the most even shells of distance to all: the least sum of their squared sizes."""
    values, counts = np.unique(points, return_counts=True)
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    sizes = np.stack([np.where(apart == d, counts, 0).sum(axis=1) for d in range(int(apart.max()) + 1)])
    return int(values[(sizes.astype(float) ** 2).sum(axis=0).argmin()])


def grow(sample: np.ndarray, low: int, bits: int, stands_for: float, leaf_rows: int, block_bits: int) -> Tree:
    """A tree over ``bits`` bits from bit ``low`` on; each point of the sample stands for so many fingerprints."""
    mask, vantage, child = [0], [0], [-1]
    todo = [(0, sample, np.arange(low, low + bits))]
    while todo:
        node, points, left = todo.pop()
        if len(points) * stands_for <= leaf_rows or len(points) < 4 or not len(left):
            continue
        ones = ((points[:, None] >> left.astype(np.uint64)) & np.uint64(1)).mean(axis=0)
        best = np.argsort(np.abs(ones - 0.5), kind="stable")[:block_bits]
        if ones[best[0]] in (0, 1):  # all points are alike
            continue
        own = sum(1 << int(b) for b in left[best])
        mask[node], child[node] = own, len(mask)
        vantage[node] = even_shells(points & np.uint64(own))
        shell = np.bitwise_count((points ^ np.uint64(vantage[node])) & np.uint64(own))
        rest = np.delete(left, best)
        for d in range(len(best) + 1):
            todo.append((len(mask), points[shell == d], rest))
            mask.append(0)
            vantage.append(0)
            child.append(-1)
    return Tree(np.array(mask, np.uint64), np.array(vantage, np.uint64), np.array(child, np.int64))


def forest(sample: np.ndarray, stands_for: float, radius: int, leaf_rows: int, block_bits: int) -> list[Tree]:
    return [grow(sample, low, bits, stands_for, leaf_rows, block_bits) for low, bits in bands(radius)]


def visits(fps: np.ndarray, trees: list[Tree], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(leaf, row, home) arrays: where each fingerprint lives, and where it queries. Leaves are numbered over all trees."""
    per_band, base = radius // len(trees), 0
    for t in trees:
        todo = [(np.arange(len(fps)), np.zeros(len(fps), np.int64), per_band, False)]
        while todo:  # rows, nodes, distance left, whether they left their own path
            row, node, left, moved = todo.pop()
            leaf = t.child[node] < 0
            if leaf.any():
                yield node[leaf] + base, row[leaf], not moved
                row, node = row[~leaf], node[~leaf]
            if not len(row):
                continue
            d = np.bitwise_count((fps[row] ^ t.vantage[node]) & t.mask[node]).astype(np.int64)
            most = np.bitwise_count(t.mask[node])
            for move in range(-left if moved else 0, left + 1):  # the first move is outwards
                ok = (d + move >= 0) & (d + move <= most)
                todo.append((row[ok], t.child[node[ok]] + d[ok] + move, left - abs(move), moved or move != 0))
        base += len(t.child)


def links(cells: np.ndarray, home: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked rows within each cell; rows are sorted by cell, those at home first. Enough links to connect all that are linked."""
    n = len(cells)
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    sizes = np.diff(np.r_[starts, n])
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # rows from here to the end of the cell
    small = np.repeat(sizes <= 48, sizes)
    found_a, found_b = [], []
    at = np.flatnonzero(small & home & (left > 1))
    step = 1
    while len(at):
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= radius]
        found_a.append(near)
        found_b.append(near + step)
        step += 1
        at = at[left[at] > step]
    for s, size in zip(starts[sizes > 48], sizes[sizes > 48], strict=True):
        f, h = fps[s : s + size], home[s : s + size]
        new = np.ones(size, bool)
        seeds = np.flatnonzero(h)
        while len(seeds := seeds[new[seeds]]):  # breadth first, from 64 rows at once: a row is compared with those not yet reached only
            front, seeds = seeds[:64], seeds[64:]
            new[front] = False
            a, b = np.nonzero(np.triu(np.bitwise_count(f[front][:, None] ^ f[front][None, :]) <= radius, 1))
            found_a.append(s + front[a])
            found_b.append(s + front[b])
            while len(front):
                reached, live = [], np.flatnonzero(new)
                for block in range(0, len(front), 64):
                    some, live = front[block : block + 64], live[new[live]]
                    if not len(live):
                        break
                    near = np.bitwise_count(f[some][:, None] ^ f[live][None, :]) <= radius
                    if not h[some].all():
                        near &= h[some][:, None] | h[live][None, :]
                    a, b = np.nonzero(near)
                    found_a.append(s + some[a])
                    found_b.append(s + live[b])
                    hit = live[np.unique(b)]
                    new[hit] = False
                    reached.append(hit)
                front = np.concatenate(reached) if reached else np.array([], np.int64)
    none = np.array([], np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def near_pairs(fps: DataFrame, radius: int = RADIUS, block_bits: int = 2, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(a, b): links among distinct fingerprints (column ``fp``), enough to connect all that are linked. ``fps`` is read more than once: give a stored table.

    The trees are sent to all tasks; their size is bounded by the sample's. Links are the same for every sample.
    """
    spark, total = fps.sparkSession, fps.count()
    share = min(0.125, sample_rows / max(1, total))
    lot = F.pmod(F.xxhash64(F.lit("vantage"), "fp"), F.lit(1 << 30)) / (1 << 30)
    some = fps.where(lot < share).select("fp").toArrow().column("fp").to_numpy() if total > leaf_rows else np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast(forest(np.sort(some.view(np.uint64)), 1 / share, radius, leaf_rows, block_bits))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column("fp").to_numpy()
            for leaf, row, own in visits(f.view(np.uint64), shared.value, radius):
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(f[row]), pa.array(np.full(len(row), own))], ["cell", "fp", "home"])

    sent = fps.select("fp").mapInArrow(send, "cell long, fp long, home boolean")
    sizes = sent.groupBy("cell").count()
    visiting = sizes.agg(F.sum("count")).first()[0] or 0
    block = F.lit(0)
    if visiting > LARGE * leaf_rows:
        # A heavy leaf has 1/4096 of all rows at least, so that there are 4096 of them at most: a bound for the broadcast.
        heavy = sizes.where(F.col("count") > max(LARGE * leaf_rows, visiting // 4096)).select("cell", F.ceil(F.col("count") / (LARGE * leaf_rows)).cast("int").alias("ways"))
        every = F.sequence(F.lit(0), F.col("ways") - 1)
        mine, other = (F.pmod(F.xxhash64("fp", F.lit(x)), F.col("ways")).cast("int") for x in (1, 2))
        meet = F.array_union(F.transform(every, lambda i: i * F.col("ways") + other), F.when(F.col("home"), F.transform(every, lambda j: mine * F.col("ways") + j)).otherwise(F.array().cast("array<int>")))
        sent = sent.join(F.broadcast(heavy), "cell", "left").withColumn("block", F.explode(F.when(F.col("ways").isNull(), F.array(F.lit(0))).otherwise(meet)))
        block = F.col("block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(t: pa.Table) -> pa.RecordBatch:
            f = t.column("fp").to_numpy()
            home = t.column("home").to_numpy(zero_copy_only=False)
            a, b = links(t.column("key").to_numpy(), home, f.view(np.uint64), radius)
            own, at = np.unique(f, return_inverse=True)
            m, low = contract(at[a], at[b], len(own))
            return pa.RecordBatch.from_arrays([pa.array(own[m]), pa.array(own[low])], ["a", "b"])

        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            keys = t.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last cell may go on
            if cut:
                yield emit(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and len(held):
            yield emit(held)

    keyed = sent.select(F.xxhash64("cell", block).alias("key"), "fp", "home")
    met = keyed.repartition("key").sortWithinPartitions("key", F.desc("home"))
    return met.mapInArrow(search, "a long, b long")


def contract(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the numbers 0 to n - 1 as (member, smallest of its component), for members that aren't the smallest."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for ends in (label[a], label[b]):
            np.minimum.at(label, ends, low)
        label = label[label]
        if (label == before).all():
            m = np.flatnonzero(label != np.arange(n))
            return m, label[m]


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of every node in pairs (a, b); the component is its smallest node. Rounds of large-star and small-star, until
    one changes nothing; their number grows with the logarithm of the longest chain."""
    spark, at = pairs.sparkSession, scratch(pairs.sparkSession)
    edges, mark = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), at), None
    while True:
        both = edges.union(edges.select("b", "a"))
        # The second key keeps this side apart from the join's own exchange, which can then split a hub.
        low = both.groupBy("a", (F.col("a") % 2).alias("_")).agg(F.least(F.min("b"), F.col("a")).alias("m")).drop("_")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a", (F.col("a") % 2).alias("_")).agg(F.min("b").alias("m")).drop("_")
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        before, at = at, scratch(spark)
        edges = stored(small, at)
        remove(spark, before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        mark = now


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, block_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): a row per row of docs.

    component_id is the smallest id that links lead to, the own one included. A null or empty text has
    fingerprint 0 and is linked like any other; a text of any length has one fingerprint, in memory of a few times its size.
    Rows with a null id link like others; component_id is null where no row of the component has an id. Rows that
    repeat an id each get a row and link by their own texts. An empty table gives an empty result.
    """
    own = stored(fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text").select("doc_id", "fp"))
    ids = stored(own.groupBy("fp").agg(F.min("doc_id").alias("id")))
    linked = stored(components(near_pairs(ids, radius, block_bits)))
    lows = linked.join(ids, linked["node"] == ids["fp"]).groupBy("component").agg(F.min("id").alias("low"))
    of_linked = linked.join(lows, "component").select(F.col("node").alias("fp"), "low")
    return own.join(ids.join(of_linked, "fp", "left").select("fp", F.coalesce("low", "id").alias("component_id")), "fp", "left").select("doc_id", "fp", "component_id")


def row_hash(df: DataFrame) -> Column:
    """64 bits of a whole row."""
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else F.col(c) for c, kind in ((f"`{c}`", kind) for c, kind in df.dtypes)])


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component of fingerprints one row stays, that with the smallest id (null: last), then
    fingerprint, then hash of the row.

    Rows that repeat an id are told apart by their texts: unlike ones stay. Of rows that are equal in all columns one stays.
    An empty table gives an empty result.
    """
    h, i, many = fresh(docs, "h", "i", "many")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_hash(docs).alias("h"), F.col(text).alias("text"))
    own = stored(fingerprints(slim, "text").select("doc_id", "h", "fp"))
    rows = stored(own.groupBy("fp", "doc_id", "h").agg(F.count("*").alias("n")))
    linked = stored(components(near_pairs(stored(rows.select("fp").distinct()))))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "fp", "h", "n")).alias("first")
    of_fp = rows.groupBy("fp").agg(first)
    of_component = of_fp.join(linked, of_fp["fp"] == linked["node"], "left").groupBy(F.coalesce("component", "fp")).agg(F.min("first").alias("first"))
    keep = stored(of_component.select(F.col("first.doc_id").alias(i), F.col("first.h").alias(h), (F.col("first.n") > 1).alias(many)))
    marked = docs.withColumn(h, row_hash(docs))

    def among(winners: DataFrame) -> DataFrame:
        w = winners.withColumnRenamed(h, f"{h}w")
        return marked.join(w, (marked[h] == w[f"{h}w"]) & marked[doc_id].cast("long").eqNullSafe(w[i]), "left_semi")

    out = among(keep.where(~F.col(many))).drop(h)
    if keep.where(many).limit(1).count():
        out = out.unionByName(among(keep.where(many)).dropDuplicates([h, doc_id]).drop(h))
    return out


def hex16(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
