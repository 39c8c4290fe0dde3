"""Operator 5. Harmonic packing of tokenized documents into fixed-length sequences.

Lengths fall into reciprocal-capacity classes: class k holds lengths over capacity/(k+1) and up to capacity/k, and
a bin of class k takes k pieces. A document's ids (with the end id) are cut into full sequences and a rest. A rest
that fills its share of a class-k bin to within 1/``slack``, or that is that short itself, stays whole; another gives
up a piece of capacity/(k+1), the largest share below it, and so on with what is left. So every bin of every class is
filled but for 1/``slack`` at most, and a document has few pieces.

Each worker fills bins by itself: pieces lie in many small lots (hash of a stored row number, so that equal rows
spread), a count of pieces per lot and class gives every lot its first place in each class, and place // k is the
bin. No lot, class or document needs one task. What is left of each class (under k pieces; under 10,000 at any size
of input) goes to shared last bins, the longest first into the first bin with room.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh, per_row, put, stored

CAPACITY, SLACK, END_ID = 2048, 32, 1
#: Words whose ids a Python worker remembers at most.
WORDS = 250_000
#: What the tokenizer must see in its whole text: characters that only str.split takes for white space, a letter that
#: Python lower-cases by its neighbours, and the start of a special token.
AS_IT_IS = ("\x1c", "\x1d", "\x1e", "\x1f", "\u03a3", "<|")
#: Signs that may surround a word without changing how it is split. The others can begin a special token or a contraction.
BEFORE, AFTER = "\"#$%&()*+,-./:;=>?@[\\]^_`{}~!", "'\"#$%&()*+,-./:;=>?@[\\]^_`{}~!"


def byte_letters() -> dict[int, int]:
    """Byte-level BPE writes bytes as letters: printable ones of Latin-1 as they are, the others from U+0100 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in same]
    return {b: b for b in same} | {b: 256 + i for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def tokenizer(name: str) -> Callable[[bytes | None], np.ndarray]:
    """text -> ids. ``name``: a file of public_tokenizers, or a path; a byte-level BPE that lower-cases and drops white space.

    The tokenizer never joins text across white space, so that a text's ids are those of its blocks without white
    space. A block that is one word between signs is split here, other blocks by the tokenizer. The ids of words are
    remembered, also from task to task.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
    letters, model = byte_letters(), t.model
    words: dict[str, bytes] = {}

    def bpe(word: str) -> bytes:
        known = words.get(word)
        if known is None:
            if len(words) >= WORDS:
                words.clear()
            parts = model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(letters))
            known = words[word] = array("I", [p.id for p in parts]).tobytes()
        return known

    def block_ids(block: str) -> bytes:
        rest = block.lstrip(BEFORE)
        core = rest.rstrip(AFTER)
        if not core.isalpha():
            return array("I", t.encode(block, add_special_tokens=False).ids).tobytes()
        common = core in words
        before, after = block[: len(block) - len(rest)], rest[len(core) :]
        out = (bpe(before) if before else b"") + bpe(core) + (bpe(after) if after else b"")
        if common:
            words[block] = out
        return out

    def ids(text: bytes | None) -> np.ndarray:
        s = (text or b"").decode()
        if any(c in s for c in AS_IT_IS):
            return np.array(t.encode(s, add_special_tokens=False).ids, "<u4")
        blocks = normalize("NFC", s).lower().split()
        out = list(map(words.get, blocks))
        if None in out:
            out = [block_ids(b) if known is None else known for b, known in zip(blocks, out, strict=True)]
        return np.frombuffer(b"".join(out), "<u4")

    return ids


def cuts(n: int, capacity: int, slack: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    out, at = [(k, capacity) for k in range(0, n - capacity + 1, capacity)], n - n % capacity
    while n > at:
        rest = n - at
        k = capacity // rest
        whole = rest * slack <= capacity or slack * k * rest >= (slack - 1) * capacity
        out.append((at, rest if whole else capacity // (k + 1)))
        at += out[-1][1]
    return out


PIECES = pa.struct([("doc_tokens", pa.int64()), ("pieces", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])))])
SCHEMA = "struct<doc_tokens:long,pieces:array<struct<start:long,length:long,ids_crc32:long,ids:binary>>>"


def cut(tokenizer_name: str, capacity: int, slack: int, end_id: int, id_bytes: int) -> Callable[[bytes | None], dict]:
    encode = tokenizer(tokenizer_name)

    def one(text: bytes | None) -> dict:
        numbers = np.append(encode(text), np.array(end_id, "<u4"))
        if 0 < id_bytes < 4 and int(numbers.max()) >> 8 * id_bytes:
            raise ValueError(f"ids don't fit {id_bytes} bytes")
        ids, short, pieces = numbers.tobytes(), numbers.astype(f"<u{id_bytes or 4}"), []
        for start, length in cuts(len(ids) // 4, capacity, slack):
            part = ids[4 * start : 4 * (start + length)]
            pieces.append({"start": start, "length": length, "ids_crc32": zlib.crc32(part), "ids": short[start : start + length].tobytes() if id_bytes else None})
        return {"doc_tokens": len(ids) // 4, "pieces": pieces}

    return one


def tokenized(docs: DataFrame, tokenizer_name: str, text: str = "text", capacity: int = CAPACITY, slack: int = SLACK, end_id: int = END_ID, id_bytes: int = 0) -> DataFrame:
    """docs with a struct ``cut``: the document's tokens and its pieces (with their ids if asked for)."""
    return put(docs, cut=per_row(lambda: cut(tokenizer_name, capacity, slack, end_id, id_bytes), SCHEMA, PIECES, F.col(text)))


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each of a bounded number of pieces, which come longest first."""
    room, bins, offsets = np.zeros(len(lengths), np.int64) + capacity, [], []
    for n in lengths.tolist():
        b = int(np.argmax(room >= n))
        bins.append(b)
        offsets.append(capacity - int(room[b]))
        room[b] -= n
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def assign(pieces: DataFrame, row: str, capacity: int = CAPACITY, lots: int | None = None) -> DataFrame:
    """pieces (columns ``length``, 1 to capacity, and ``row``, a number of its own for each) with ``sequence_id`` and ``offset``, gapless
    from 0 within each sequence.

    ``pieces`` is read more than once: give a stored table. lots: how many, about 20,000 pieces each if None.
    """
    spark = pieces.sparkSession
    lots = lots or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + pieces.count() // 20_000)
    k, lot, at, first, every, bin_, before = fresh(pieces, "k", "lot", "at", "first", "every", "bin", "before")
    rows = pieces.withColumns({k: F.floor(F.lit(capacity) / F.col("length")).cast("int"), lot: F.pmod(F.xxhash64(row), F.lit(lots)).cast("int")})
    sizes = rows.groupBy(k, lot).agg(F.count("*").alias(every))
    by_class = Window.partitionBy(k).orderBy(lot)
    classes = durable(sizes.select(k, lot, (F.sum(every).over(by_class) - F.col(every)).alias(first), F.sum(every).over(Window.partitionBy(k)).alias(every)))
    placed = rows.withColumn(at, F.row_number().over(Window.partitionBy(lot, k).orderBy(row)) - 1).join(classes, [lot, k])
    placed = placed.withColumn(at, F.col(at) + F.col(first))
    # Sequence numbers: classes one after another, then the last bins.
    base, n = {}, 0
    for r in classes.groupBy(k).agg(F.first(every).alias("a")).orderBy(k).collect():  # at most a row per length
        base[r[k]] = n
        n += r["a"] // r[k]
    bases = F.create_map(*[F.lit(x) for kv in base.items() for x in kv]) if base else F.create_map(F.lit(0), F.lit(0))
    full = F.col(at) < F.col(every) - F.col(every) % F.col(k)
    main = placed.where(full).withColumns({bin_: F.floor(F.col(at) / F.col(k)), "sequence_id": (bases[F.col(k)] + F.floor(F.col(at) / F.col(k))).cast("long")})
    main = main.withColumn("offset", F.sum("length").over(Window.partitionBy(k, bin_).orderBy(at)) - F.col("length"))
    kind = pa.schema([(row, pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([("length", "descending"), (row, "ascending")])
        bins, offsets = first_fit(t.column("length").to_numpy(), capacity)
        yield pa.RecordBatch.from_arrays([t.column(row).combine_chunks(), pa.array(bins + n), pa.array(offsets)], schema=kind)

    rest = durable(placed.where(~full).drop(k, lot, at, first, every))  # bounded by the classes
    ends = rest.select(F.col(row).cast("long").alias(row), F.col("length").cast("long").alias("length")).coalesce(1).mapInArrow(last, f"`{row}` long, sequence_id long, offset long")
    columns = [*pieces.columns, F.col("sequence_id"), F.col("offset").cast("long").alias("offset")]
    return main.select(*columns).union(rest.join(ends, row).select(*columns))


def pack(docs: DataFrame, tokenizer_name: str = "word_bpe_49k.json", doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, slack: int = SLACK, end_id: int = END_ID, id_bytes: int = 0) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and if ``id_bytes`` is 2 or 4: ids (little-endian unsigned
    numbers of so many bytes), which are shuffled once. An id that doesn't fit is an error.

    A null or empty text is the end id alone; a text of any length is tokenized whole. Rows that repeat a document are packed one by one, rows with a
    null id too. An empty table gives an empty result.
    """
    cut_ = tokenized(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), tokenizer_name, "text", capacity, slack, end_id, id_bytes)
    rows = cut_.select("doc_id", "cut.doc_tokens", F.explode("cut.pieces").alias("p"))
    pieces = stored(rows.select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", *(["p.ids"] if id_bytes else []), F.monotonically_increasing_id().alias("row")))
    out = assign(pieces.drop("ids"), "row", capacity)
    return (out.join(pieces.select("row", "ids"), "row") if id_bytes else out).drop("row")
