"""Operator 6. Benchmark decontamination with suffix arrays of the training text.

The documents of a task are laid end to end as word numbers, and their suffixes
are sorted (a suffix array per shard; a shard is a block of positions). Every
benchmark suffix is then searched in it by bisection: the range of suffixes that
begin with its first ``window`` words are its verbatim occurrences, and matches
that follow each other in both texts join to the longest ones.

Word numbers: a word of the benchmark has its place in the benchmark's
vocabulary, all other words are 0. Suffixes whose first words cannot fill the
shortest window (a 0 comes too soon) begin no match and are left out of the array.
Keys hold the first words of a suffix, as many as the longest window has; the
words beyond that only ever extend a match, which the joining does.

A benchmark of at most ``block_bytes`` (its distinct texts) is sent to all tasks and made ready once per Python worker;
documents aren't shuffled. A larger one stays a table (``matches_by_key``): its windows and the document suffixes that a
bitmap of their hashes lets through are brought together by key, sorted, and matches are joined along diagonals.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, per_row, put, stored

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: Bits of the bitmap of hashes, and places of a window above which they are searched by bisection.
BITMAP, FEW = 1 << 26, 8
#: Positions of a shard, and bytes of text that are split into words at once.
SHARD, SEGMENT = 1 << 17, 1 << 22
#: Word characters: letters, digits and everything beyond ASCII; A-Z become a-z, all else separates.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def word_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The text's words, in lists of bounded size."""
    folded = (text or b"").translate(FOLD)
    at = 0
    while len(folded) - at > SEGMENT:
        cut = folded.rfind(b" ", at, at + SEGMENT)
        cut = cut if cut >= 0 else folded.find(b" ", at + SEGMENT)
        if cut < 0:
            break
        yield folded[at:cut].split()
        at = cut
    yield folded[at:].split()


def first_where(low: int, high: int, holds: Callable[[int], bool]) -> int:
    """The first number of a range from which on a condition holds; ``high`` if it never does."""
    while low < high:
        middle = (low + high) // 2
        if holds(middle):
            high = middle
        else:
            low = middle + 1
    return low


def suffix_ranks(words: np.ndarray) -> np.ndarray:
    """The rank of each suffix of an array of numbers, by doubling the length that is compared."""
    n, width = len(words), 1
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: max(0, n - width)] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) > 0)
        rank = np.empty(n, np.int64)
        rank[order] = new
        width *= 2
        if not n or int(new[-1]) == n - 1 or width >= 2 * n:
            return rank


class Suffixes:
    """The benchmark's suffixes, ready to be searched. Items: (names, text) of each distinct text."""

    def __init__(self, items: list[tuple[list[str], bytes]], window: int) -> None:
        self.window = window
        self.names = [names for names, _ in items]
        self.texts: list[np.ndarray] = []
        vocabulary: dict[bytes, int] = {}
        heads, texts, places = [np.zeros((0, window), ">u4")], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (_, text) in enumerate(items):
            words = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for ws in word_lists(text) for w in ws], ">u4")
            self.texts.append(words)
            if len(words):  # a short text is one window, filled with 0, which no word has
                heads.append(np.lib.stride_tricks.sliding_window_view(np.pad(words, (0, max(0, window - len(words)))), window))
                texts.append(np.full(len(heads[-1]), k, np.int64))
                places.append(np.arange(len(heads[-1])))
        self.vocabulary = vocabulary
        kind = f"S{4 * window}"
        every = np.concatenate(heads).astype(">u4").view(kind).ravel()  # joining drops the byte order
        order = np.argsort(every, kind="stable")
        self.place_text, self.place = np.concatenate(texts)[order], np.concatenate(places)[order]
        self.low, first = np.unique(every[order], return_index=True)
        self.begin = np.append(first, len(order))
        numbers = self.low.astype(kind).view(">u4").reshape(len(self.low), window)
        self.widths = (numbers > 0).sum(axis=1).astype(np.int64)
        self.shortest = int(self.widths.min()) if len(self.low) else 0
        self.high = np.where(numbers > 0, numbers, 0xFFFFFFFF).astype(">u4").view(kind).ravel()
        self.ordered: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.items_of: dict[int, list[int]] = {}
        self.ranks: list[np.ndarray | None] | None = None

    def texts_of(self, key: int) -> list[int]:
        """The texts that have a window."""
        if key not in self.items_of:
            self.items_of[key] = np.unique(self.place_text[self.begin[key] : self.begin[key + 1]]).tolist()
        return self.items_of[key]

    def by_suffix(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """(texts, places) of a window in the order of the suffixes that begin there. 8 bytes a place: suffixes aren't written out."""
        if self.ranks is None:  # of the texts that have a window in more than FEW places
            often = np.repeat(np.diff(self.begin) > FEW, np.diff(self.begin))
            used = np.unique(self.place_text[often])
            rank = suffix_ranks(np.concatenate([x for k in used for x in (self.texts[k].astype(np.int64), np.zeros(1, np.int64))]))
            ends = np.cumsum([len(self.texts[k]) + 1 for k in used])
            self.ranks = [None] * len(self.texts)
            for k, part in zip(used.tolist(), np.split(rank, ends[:-1]), strict=True):
                self.ranks[k] = part
        if key not in self.ordered:
            mine = slice(self.begin[key], self.begin[key + 1])
            texts, places = self.place_text[mine], self.place[mine]
            rank = np.empty(len(texts), np.int64)
            for k in np.unique(texts).tolist():
                rank[texts == k] = self.ranks[k][places[texts == k]]
            order = np.argsort(rank, kind="stable")
            self.ordered[key] = texts[order], places[order]
        return self.ordered[key]

    def alike(self, words: np.ndarray, at: int, text: int, place: int) -> int:
        """How many words are equal from two places on."""
        n, step, other = 0, 64, self.texts[text]
        while True:
            a, b = words[at + n : at + n + step], other[place + n : place + n + step]
            m = min(len(a), len(b))
            same = a[:m] == b[:m]
            if not same.all():
                return n + int(same.argmin())
            n += m
            if m < step:
                return n
            step *= 2

    def extended(self, words: np.ndarray, at: int, key: int, least: int) -> tuple[int, int, int] | None:
        """(words, text, place) of the longest match that begins with a window at a place of the document, if it has more than ``least`` words; of equal
        ones the first text and place."""
        mine = slice(self.begin[key], self.begin[key + 1])
        if mine.stop - mine.start <= FEW:
            n, k, p = min((-self.alike(words, at, k, p), k, p) for k, p in zip(self.place_text[mine].tolist(), self.place[mine].tolist(), strict=True))
            return (-n, k, p) if -n > least else None
        # The longest common prefix is that of a neighbour of the document's suffix in order; those that share it lie around it.
        texts, places = self.by_suffix(key)
        shared = lambda i: self.alike(words, at, int(texts[i]), int(places[i]))

        def before(i: int) -> bool:
            """Whether a suffix comes before the document's."""
            n, rest = shared(i), self.texts[int(texts[i])][int(places[i]) :]
            return at + n < len(words) and (n == len(rest) or int(rest[n]) < int(words[at + n]))

        spot = first_where(0, len(texts), lambda i: not before(i))
        n = max(shared(i) for i in (spot - 1, spot) if 0 <= i < len(texts))
        if n <= least:
            return None
        low = first_where(0, spot, lambda i: shared(i) >= n)
        high = first_where(spot, len(texts), lambda i: shared(i) < n)
        k = int(texts[low:high].min())
        return n, k, int(places[low:high][texts[low:high] == k].min())

    def words(self, text: bytes | None) -> np.ndarray:
        get, parts = self.vocabulary.get, []
        for ws in word_lists(text):
            parts.append(np.fromiter(map(get, ws, repeat(0)), np.uint32, len(ws)))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def occurrences(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, key) of each occurrence, sorted by position."""
        if not len(self.low) or len(words) < self.shortest:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        unknown = np.append(np.flatnonzero(words == 0), len(words))
        gaps = np.diff(unknown, prepend=-1)  # known words before each unknown one, and one
        begin = np.concatenate([np.arange(e - g + 1, e - self.shortest + 1) for e, g in zip(unknown[gaps > self.shortest].tolist(), gaps[gaps > self.shortest].tolist(), strict=True)] or [np.zeros(0, np.int64)])
        padded = np.concatenate([words, np.zeros(self.window, np.uint32)]).astype(">u4")
        at, which = [], []
        for block in range(0, len(begin), SHARD):
            rows = begin[block : block + SHARD]
            heads = np.lib.stride_tricks.sliding_window_view(padded, self.window)[rows]
            heads = np.ascontiguousarray(heads).view(f"S{4 * self.window}").ravel()
            array = np.argsort(heads, kind="stable")  # the shard's suffix array
            ordered = heads[array]
            first, last = np.searchsorted(ordered, self.low), np.searchsorted(ordered, self.high, "right")
            n = last - first
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at.append(rows[array[np.repeat(first, n) + inner]])
            which.append(np.repeat(np.arange(len(n)), n))
        none = np.zeros(0, np.int64)
        at, which = np.concatenate([none, *at]), np.concatenate([none, *which])
        order = np.argsort(at, kind="stable")
        return at[order], which[order]


def longest(at: np.ndarray, which: np.ndarray, s: Suffixes, words: np.ndarray) -> tuple[int, str | None, int, int]:
    """(words, item, word of the document, word of the item) of the longest verbatim match; of equal ones the first in the document.

    Only places are searched whose run of occurrences could hold a longer match than the one known."""
    best = (0, None, -1, -1)
    if not len(at):
        return best
    run = np.cumsum(np.diff(at, prepend=at[0]) > 1)
    ends = np.maximum.reduceat(at + s.widths[which], np.flatnonzero(np.diff(run, prepend=-1)))
    room = ends[run] - at
    for i in range(len(at)):
        if room[i] > best[0]:
            found = s.extended(words, int(at[i]), int(which[i]), best[0])
            if found:
                best = (found[0], min(s.names[found[1]]), int(at[i]), found[2])
    return best


def merged(starts: np.ndarray, stops: np.ndarray) -> list[dict]:
    """Ranges joined where they touch or overlap; starts are sorted."""
    if not len(starts):
        return []
    stops = np.maximum.accumulate(stops)
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > stops[:-1]]))
    ends = stops[np.append(new[1:], len(starts)) - 1]
    return [{"start": a, "end": b} for a, b in zip(starts[new].tolist(), ends.tolist(), strict=True)]


def match_all(texts: list[bytes | None], s: Suffixes) -> list[dict]:
    """The matches of the documents of a shard."""
    words = [s.words(t) for t in texts]
    out = [{"n_words": len(w), "spans": [], "items": [], "longest": 0, "longest_item": None, "longest_at": -1, "longest_item_at": -1} for w in words]
    ends = np.cumsum([len(w) + 1 for w in words])  # an unknown word after each document
    at, which = s.occurrences(np.concatenate([x for w in words for x in (w, np.zeros(1, np.uint32))]))
    doc = np.searchsorted(ends, at, "right")
    for d in np.unique(doc):
        mine = slice(*np.searchsorted(doc, [d, d + 1]))
        a, k = at[mine] - (ends[d] - len(words[d]) - 1), which[mine]
        out[d]["spans"] = merged(a, a + s.widths[k])
        out[d]["items"] = sorted({name for w in set(k.tolist()) for i in s.texts_of(w) for name in s.names[i]})
        out[d] |= dict(zip(("longest", "longest_item", "longest_at", "longest_item_at"), longest(a, k, s, words[d]), strict=True))
    return out


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
KIND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(SPAN)), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_item", pa.string()), ("longest_at", pa.int64()), ("longest_item_at", pa.int64())])
SCHEMA = "struct<n_words:long,spans:array<struct<start:long,end:long>>,items:array<string>,longest:long,longest_item:string,longest_at:long,longest_item_at:long>"


#: What a Python worker has made ready: the last benchmark that it used.
READY: dict[str, Suffixes] = {}


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a struct ``match`` (replaces a column of that name): ``n_words``; ``spans`` (merged word ranges
    that lie in occurrences of a benchmark window, end exclusive); ``items`` (sorted ids, as text, of items with
    occurrences); the ``longest`` verbatim match in words, its item and its first word in both texts (0, null, -1, -1: none).

    An item of fewer words than the window is one window; one without words, or with a null text or id, matches
    nothing. Rows that repeat an item or a document are treated alike. A null text has no words; texts of any length are searched
    whole. Of longest matches of equal length the first in the document counts, then the first text of the benchmark. An empty
    table of documents or of items gives a result like any other.
    """
    named = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    items = stored(named.groupBy("t").agg(F.array_sort(F.collect_set("i")).alias("i")))
    size = items.agg(F.sum(F.octet_length("t") + F.octet_length(F.array_join("i", ",")))).first()[0] or 0
    if size > block_bytes:
        return matches_by_key(docs, items, text, window)
    shared = docs.sparkSession.sparkContext.broadcast(sorted((r["t"].encode(), r["i"]) for r in items.collect()))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if name not in READY:
            READY.clear()
            READY[name] = Suffixes([(i, t) for t, i in shared.value], window)
        s = READY[name]
        for batch in batches:
            rows: list[dict] = []
            shard: list[bytes | None] = []
            size = 0
            for x in batch:
                t = x.as_py()
                shard.append(t.encode() if t is not None else None)
                size += len(shard[-1] or b"")
                if size >= SEGMENT:
                    rows += match_all(shard, s)
                    shard, size = [], 0
            if shard:
                rows += match_all(shard, s)
            yield pa.array(rows, KIND)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return put(docs, match=F.arrow_udf(run, SCHEMA)(F.col(text)))


def windows(text: bytes | None, widths: list[int], whole: bool) -> Iterator[tuple[bytes, int, int]]:
    """(key, first word, words) of each window of the widths; whole: of a benchmark's text, which is one window where it is shorter than the longest."""
    words = [w for ws in word_lists(text) for w in ws]
    if whole:
        widths = [min(widths[0], len(words))] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(words) else ends
    for n in widths:
        for at, (a, b) in enumerate(zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True) if len(words) >= n else ()):
            yield joined[a:b], at, n


def matches_by_key(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``matches`` for a benchmark (columns t, i: a text and its ids) of any size."""
    row, match = fresh(docs, "row", "match")
    own = stored(docs.drop("match").withColumn(row, F.monotonically_increasing_id()))
    texts = stored(items.withColumn("text_id", F.monotonically_increasing_id()))
    kind = [("key", pa.binary()), ("id", pa.int64()), ("at", pa.int64()), ("n", pa.int64())]

    def cut(widths: list[int], whole: bool, shared=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, seen = shared.value if shared is not None else None, xxhash.xxh64_intdigest
            for b in batches:
                held: list[tuple] = []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for key, at, n in windows(t.encode() if t is not None else None, widths, whole):
                        if known is not None and not known[(bit := seen(key) % BITMAP) >> 3] >> (bit & 7) & 1:
                            continue
                        held.append((key, k, at, n))
                        if len(held) >= 1 << 16:
                            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, (_, x) in zip(zip(*held, strict=True), kind, strict=True)], [x for x, _ in kind])
                            held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, (_, x) in zip(zip(*held, strict=True), kind, strict=True)], [x for x, _ in kind])

        return run

    ddl = "key binary, id long, at long, n long"
    places = stored(texts.select("text_id", "t").mapInArrow(cut([window], True), ddl))
    widths = sorted((r[0] for r in places.select("n").distinct().collect()), reverse=True)  # at most ``window``

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = np.array([xxhash.xxh64_intdigest(k) % BITMAP for k in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 3), pa.array(1 << (bit & 7))], ["byte", "bit"])

    table = np.zeros(BITMAP // 8, np.uint8)
    filled = places.select("key").mapInArrow(bits, "byte long, bit long").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most BITMAP / 8 rows
    table[filled.column("byte").to_numpy()] = filled.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table.tobytes())
    suffixes = own.select(row, text).mapInArrow(cut(widths, False, shared), ddl)
    hits = stored(suffixes.join(places.select("key").distinct(), "key", "left_semi"))
    # Merged ranges: a range begins where all before it end.
    before = Window.partitionBy("id").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1)
    marked = hits.select("id", "at", "n").distinct().withColumn("new", F.coalesce(F.col("at") > F.max(F.col("at") + F.col("n")).over(before), F.lit(True)).cast("int"))
    ranges = marked.withColumn("part", F.sum("new").over(Window.partitionBy("id").orderBy("at", "n"))).groupBy("id", "part").agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("n")).alias("end"))
    spans = ranges.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    in_text = places.select("key", F.col("id").alias("text_id"), F.col("at").alias("place"))
    found = hits.select("id", "key").distinct().join(in_text.select("key", "text_id").distinct(), "key").select("id", "text_id").distinct()
    names = found.join(texts.select("text_id", "i"), "text_id").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("i")))).alias("items"))
    # Longest matches: along a diagonal of document and text, consecutive windows are one match.
    along = hits.join(in_text, "key").withColumn("diagonal", F.col("at") - F.col("place"))
    line = Window.partitionBy("id", "text_id", "diagonal").orderBy("at")
    stretch = along.withColumn("part", F.col("at") - F.row_number().over(line)).groupBy("id", "text_id", "diagonal", "part").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("n")).alias("end"))
    best = stretch.groupBy("id").agg(F.min_by(F.struct("at", "end", "text_id", "diagonal"), F.struct(F.col("at") - F.col("end"), "at", "text_id", "diagonal")).alias("b"))
    best = best.select("id", "b.*").join(texts.select("text_id", F.array_min("i").alias("item")), "text_id")
    known = spans.join(names, "id").join(best, "id").withColumnRenamed("id", row)
    counted = put(own, **{match: per_row(lambda: lambda t: sum(map(len, word_lists(t))), "long", pa.int64(), F.col(text))})
    out = counted.join(known, row, "left")
    value = F.struct(
        F.col(match).alias("n_words"), F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(known["end"] - known["at"], F.lit(0)).cast("long").alias("longest"),
        known["item"].alias("longest_item"), F.coalesce(known["at"], F.lit(-1)).cast("long").alias("longest_at"), F.coalesce(known["at"] - known["diagonal"], F.lit(-1)).cast("long").alias("longest_item_at"),
    )
    return out.select(*[counted[f"`{c}`"] for c in docs.columns if c.lower() != "match"], value.alias("match"))


def n_hit(match: str = "match") -> Column:
    """Words of the document that lie in an occurrence."""
    return F.aggregate(F.col(match)["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(match: str = "match", share: int = 20) -> Column:
    """Whether 1/share of the words, and one at least, lie in occurrences."""
    return (n_hit(match) > 0) & (share * n_hit(match) >= F.col(match)["n_words"])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the contaminated rows, columns unchanged."""
    slim = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("t"))
    return matches(slim, benchmark, "t").where(~contaminated()).select("row.*")


def items_digest(match: str = "match") -> Column:
    return F.sha2(F.array_join(F.col(match)["items"], ","), 256)
