"""Operator 12. Alignment of two tokenizers' tokens by fragments that compose.

A document's bytes (a space and the text) are encoded by both tokenizers. Offsets where a token of each ends cut the tokens into
groups; the last tokens of a group are linked. A byte range of a document yields a fragment: the ids of the tokens that end in it, and at each
common end how many ids of either kind came before. What precedes the first common end is an open prefix, what follows the last one
an open suffix, all between are closed groups. Fragments compose by joining ids and shifting the cuts, so that a suffix and the
next prefix become one group, or stay open; the operation is associative, with the empty fragment as its unit.

Texts of over ``CHUNK`` bytes are cut into byte ranges, which are encoded in different tasks, each with the few bytes around it up to places that no
token spans, and composed by a tree, ``FAN`` fragments at a time. Shorter texts are one range and don't move.

Counts of linked ids are summed in each task first. In a linked pair the bytes of one token end those of the other, so that the pairs of two
vocabularies are known to be few (``most_pairs``); their counts are sent to all tasks.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, per_row, put, stored
from .packing import byte_letters

CHUNK, FAN = 1 << 16, 8
#: Words that a task remembers at most, in each of two generations.
WORDS = 150_000
#: Words that are encoded together. Characters whose words are looked up or encoded together, and those of texts whose words are counted together.
BATCH, TEXTS, COUNTED = 4096, 1 << 19, 1 << 26
#: Words that are joined to one text, and after how many bytes it ends.
JOINED, LETTERS = 64, 1 << 12
#: Written for a space in pieces; the only character that they spell as another.
SPACE_SIGN = "▁"
#: Characters that any version of Unicode puts into the same classes.
LATIN = re.compile("[\x00-\x7f\u00c0-\u024f]*").fullmatch
#: A space that isn't the first of its run begins no new word; neither tokenizer joins anything to a space after another character.
AFTER_SPACE, BEFORE_SPACE, CUT = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )"), re.compile(rb"(?<=[!-~]) ")
WHITE = re.compile(r"\s").search
SHIFT = np.int64(32)


class Pair:
    """Both tokenizers. ``a``: a byte-level BPE file of the tokenizers library, ``b``: a sentencepiece model with byte fallback that rewrites nothing, whose pieces have
    spaces in front only."""

    def __init__(self, a: str, b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        path = lambda name: name if "/" in name else public_tokenizers.path(name)
        self.a = Tokenizer.from_file(path(a))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path(b))
        back = {letter: byte for byte, letter in byte_letters().items()}
        entries = {i: bytes(back[ord(c)] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [entries.get(i, b"") for i in range(1 + max(entries))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(" " in p or re.search("[^▁]▁|\n", p) for p in plain) or sum(map(self.b.is_byte, range(len(pieces)))) != 256:
            raise ValueError("a piece spans the place before a space, or a newline, or bytes have no pieces")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.letters = [np.frombuffer(b"".join(v), np.uint8) for v in (self.a_bytes, self.b_bytes)]
        self.starts = [np.cumsum(n) - n for n in (self.a_sizes, self.b_sizes)]  # of each id's bytes
        named = lambda v, sign: np.array([f"{i}{sign}" for i in range(len(v))], object)
        self.names = [named(v, ",") for v in (self.a_bytes, self.b_bytes)]
        self.last_names = [named(self.a_bytes, "|"), named(self.b_bytes, ";")]
        self.blank = self.b.encode("\n ")[len(self.b.encode("\n")) :]
        with open(path(a)) as f:
            file = json.load(f)
        ids = [self.a.token_to_id("".join(m.split(" ") if isinstance(m, str) else m)) for m in file["model"]["merges"]]
        splits = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        usual = file["normalizer"] is None and ids == sorted(ids) and splits.items() <= (file["pre_tokenizer"] or {}).items()
        #: The same tokens, faster, for texts of LATIN: the usual pattern, and merges by their ids.
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in entries.items()}, special_tokens={})._core_bpe.encode_ordinary if usual else None

    def a_ids(self, text: str) -> list[int]:
        return self.fast(text) if self.fast and LATIN(text) else self.a.encode(text, add_special_tokens=False).ids

    def encode(self, words: list[str]) -> Encoded:
        """Of words, each with a space put before it, as B does itself before any text but an empty one.

        Words are joined to texts, whose tokens are theirs. Those that end with white space, which might go with the next space, and those that B spells in another way stay alone.
        """
        tails = [w[-1:] for w in words]
        if "" not in tails and not WHITE("".join(tails)) and LATIN("".join(words)):
            return self.joined(words)
        kinds = np.array([2 if not w or w[-1].isspace() or SPACE_SIGN in w else 0 if LATIN(w) else 1 for w in words])
        groups: list[list[str]] = [[], [], []]
        for w, k in zip(words, kinds.tolist(), strict=True):
            groups[k].append(w)
        parts = [encode(g) for g, encode in zip(groups, (self.joined, self.joined, self.alone), strict=True)]
        return Encoded.of(parts).taken(np.argsort(np.argsort(kinds, kind="stable")))

    def joined(self, words: list[str]) -> Encoded:
        lengths = np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)) + 1
        stops = np.cumsum(lengths)
        first = (np.arange(len(words)) % JOINED == 0) | (np.diff((stops - lengths) // LETTERS, prepend=0) > 0)
        at = [*np.flatnonzero(first).tolist(), len(words)]
        texts = [" ".join(words[x:y]) for x, y in zip(at, at[1:], strict=False)]
        data = [" " + t for t in texts]
        letters = np.frombuffer("".join(data).encode(), np.uint8)
        ids, sizes = [], []
        for k, found in enumerate((map(self.a_ids, data), self.b.encode(texts, num_threads=1))):
            ids.append(np.array(list(chain.from_iterable(found)), np.int64))
            ends = np.cumsum((self.a_sizes, self.b_sizes)[k][ids[k]])
            last = np.searchsorted(ends, stops, "right")
            if not self.spells(k, ids[k], ends, letters) or (ends[last - 1] != stops).any():
                return self.alone(words)
            sizes.append(np.diff(last, prepend=0))
        return Encoded(ids, sizes, lengths, np.ones(len(words), bool))

    def spells(self, k: int, ids: np.ndarray, ends: np.ndarray, letters: np.ndarray) -> bool:
        """Whether ids of A (0) or B (1), whose bytes end at ``ends``, spell the letters."""
        done = 0
        for at in range(0, len(ids), 1 << 16):
            i, to = ids[at : at + (1 << 16)], ends[at : at + (1 << 16)]
            size = (self.a_sizes, self.b_sizes)[k][i]
            place = np.repeat(self.starts[k][i] - (to - size), size) + np.arange(done, to[-1])
            if not np.array_equal(self.letters[k][place], letters[done : to[-1]]):
                return False
            done = int(to[-1])
        return done == len(letters)

    def alone(self, words: list[str]) -> Encoded:
        texts = [" " + w for w in words]
        data = list(map(str.encode, texts))
        ids, sizes, spelled = [], [], []
        for found, spell in ((list(map(self.a_ids, texts)), self.a_bytes), ([x or self.blank for x in self.b.encode(words, num_threads=1)], self.b_bytes)):
            flat = list(chain.from_iterable(found))
            ids.append(np.array(flat, np.int64))
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            spelled.append(list(map(spell.__getitem__, flat)))
        out = Encoded(ids, sizes, np.fromiter(map(len, data), np.int64, len(data)), np.ones(len(data), bool))
        if not b"".join(spelled[0]) == b"".join(data) == b"".join(spelled[1]):
            at = [np.cumsum([0, *n]).tolist() for n in sizes]
            for i, d in enumerate(data):
                out.whole[i] = all(b"".join(x[n[i] : n[i + 1]]) == d for x, n in zip(spelled, at, strict=True))
        return out

    def fragment(self, words: list[str], first: int = 0, last: int | None = None) -> dict:
        """Of the words' bytes, the fragment of the tokens that end after ``first`` and not after ``last``."""
        found = self.encode(words)
        if not found.whole.all():
            return dict.fromkeys(("a", "b", "a_cuts", "b_cuts"), b"") | {"whole": False}
        ids, ends, common = found.cut(self)
        inside = [(e > first) & (e <= (e[-1] if last is None else last)) for e in ends]
        out = {"whole": True}
        for k, i, e, c, mine in zip("ab", ids, ends, common, inside, strict=True):
            out |= {k: packed(i[mine]), f"{k}_cuts": packed(np.flatnonzero(c[mine]) + 1)}
        return out


@dataclass
class Encoded:
    """Ids of some words by A and B, how many each word has, the words' bytes, and whether both spell them."""

    ids: list[np.ndarray]
    sizes: list[np.ndarray]
    lengths: np.ndarray
    whole: np.ndarray

    @staticmethod
    def of(parts: list[Encoded]) -> Encoded:
        ids, sizes = ([np.concatenate([v[k] for v in x]) for k in (0, 1)] for x in ([p.ids for p in parts], [p.sizes for p in parts]))
        return Encoded(ids, sizes, np.concatenate([p.lengths for p in parts]), np.concatenate([p.whole for p in parts]))

    def taken(self, order: np.ndarray) -> Encoded:
        """The words in another order."""
        ids = []
        for i, n in zip(self.ids, self.sizes, strict=True):
            start, size = (np.cumsum(n) - n)[order], n[order]
            ids.append(i[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(i))])
        return Encoded(ids, [n[order] for n in self.sizes], self.lengths[order], self.whole[order])

    def spelled(self) -> Encoded:
        """Without the words that aren't whole."""
        if self.whole.all():
            return self
        ids = [i[np.repeat(self.whole, n)] for i, n in zip(self.ids, self.sizes, strict=True)]
        return Encoded(ids, [n[self.whole] for n in self.sizes], self.lengths[self.whole], self.whole[self.whole])

    def cut(self, both: Pair) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Ids, where each ends, and which end where one of the other kind does. All words are whole."""
        ends = [np.cumsum(n[i]) for n, i in zip((both.a_sizes, both.b_sizes), self.ids, strict=True)]
        marks = np.zeros((2, int(self.lengths.sum()) + 1), bool)
        for m, e in zip(marks, ends, strict=True):
            m[e] = True
        return self.ids, ends, [marks[1][ends[0]], marks[0][ends[1]]]

    def links(self, both: Pair) -> tuple[np.ndarray, np.ndarray]:
        """Linked ids, and how many each word has."""
        ids, ends, common = self.cut(both)
        word = np.searchsorted(np.cumsum(self.lengths), ends[0][common[0]])
        return ids[0][common[0]] << SHIFT | ids[1][common[1]], np.bincount(word, minlength=len(self.lengths))

    def said(self, both: Pair) -> list[str]:
        """Groups of each word."""
        ids, _, common = self.cut(both)
        cuts = [np.concatenate([[0], np.flatnonzero(c) + 1]) for c in common]
        group = [np.cumsum(c) - c for c in common]  # of each id
        out = np.empty(len(ids[0]) + len(ids[1]), object)
        for k, (i, g, c) in enumerate(zip(ids, group, common, strict=True)):
            place = np.arange(len(i)) + cuts[1 - k][g + k]  # after the other's ids of earlier groups, B's also after A's of its own
            out[place] = np.where(c, both.last_names[k][i], both.names[k][i])
        names, ends = out.tolist(), np.cumsum(self.sizes[0] + self.sizes[1]).tolist()
        return ["".join(names[x:y])[:-1] for x, y in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=2)
def pair(a: str, b: str) -> Pair:
    return Pair(a, b)


def packed(x: np.ndarray) -> bytes:
    return x.astype("<u4").tobytes()


def numbers(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u4").astype(np.int64)


def compose(fragments: list[dict]) -> dict:
    """One fragment of neighbouring ones, in order."""
    out: dict = {k: b"".join(f[k] for f in fragments) for k in ("a", "b")} | {"whole": all(f["whole"] for f in fragments)}
    for k in ("a", "b"):
        before = np.cumsum([0, *(len(f[k]) // 4 for f in fragments)])
        out[f"{k}_cuts"] = b"".join(packed(numbers(f[f"{k}_cuts"]) + n) for f, n in zip(fragments, before, strict=False))
    return out


def words(text: str) -> list[str]:
    """The text with a space before it, cut before each space that follows another character; without these spaces."""
    return [w[1:] for w in BEFORE_SPACE.split(" " + text)] if AFTER_SPACE.search(" " + text) else text.split(" ")


def parted(words: Iterable[str]) -> Iterator[list[str]]:
    """Words that are encoded together: ``BATCH``, or fewer with about ``TEXTS`` characters."""
    some, n = [], 0
    for w in words:
        some.append(w)
        n += len(w)
        if len(some) >= BATCH or n >= TEXTS:
            yield some
            some, n = [], 0
    if some:
        yield some


def links(fragment: dict) -> np.ndarray:
    """The linked ids of a whole fragment, A's shifted left."""
    last = [numbers(fragment[k])[numbers(fragment[f"{k}_cuts"]) - 1] for k in ("a", "b")]
    return last[0] << SHIFT | last[1]


def said(fragment: dict) -> str:
    """Ids of each group, A's before B's: ``a1,a2|b1;a3|b2,b3``."""
    a, b = (list(map(str, numbers(fragment[k]).tolist())) for k in ("a", "b"))
    out, i, j = [], 0, 0
    for m, n in zip(numbers(fragment["a_cuts"]).tolist(), numbers(fragment["b_cuts"]).tolist(), strict=True):
        out.append(f"{','.join(a[i:m])}|{','.join(b[j:n])}")
        i, j = m, n
    return ";".join(out)


def chunks(data: bytes, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Byte ranges of about ``size``: (begin, first, last, end), of which first to last is the range, and begin and end are places around it that no token spans.

    A range ends within a word, but not within one that is longer than a quarter of ``size``: this goes to one range whole.
    """
    last, n = 0, len(data)
    while last < n:
        first = last
        last = min(n, first - first % size + size)
        begin, end = around(data, first, size), n
        if last < n:
            low, end = around(data, last, size), following(data, last)
            if end - low > size // 4:
                last = end
        yield begin, first, last, end


def following(data: bytes, at: int) -> int:
    cut = CUT.search(data, at)
    return cut.start() if cut else len(data)


def around(data: bytes, at: int, size: int) -> int:
    """The last cut at or before a place; a place itself is one if ``chunks`` put it at a long word's end."""
    reach = size
    while at > 0:
        low = max(0, at - reach)
        found = [m.start() for m in CUT.finditer(data, low, at + 1)]
        if found:
            return found[-1]
        if not low:
            return 0
        reach *= 2
    return 0


FRAGMENT = "struct<a:binary,b:binary,a_cuts:binary,b_cuts:binary,whole:boolean>"
FRAGMENT_ARROW = pa.struct([(k, pa.binary()) for k in ("a", "b", "a_cuts", "b_cuts")] + [("whole", pa.bool_())])


def composed(docs: DataFrame, row: str, text: str, a: str, b: str, size: int) -> DataFrame:
    """(row, f): the fragment of each whole text. ``docs`` is read more than once."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = b" " + t.as_py().encode()
                for k, (begin, first, last, end) in enumerate(chunks(data, size)):
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([k], pa.int64()), pa.array([data[begin:end]], pa.binary()), pa.array([first - begin], pa.int64()), pa.array([last - begin], pa.int64())], ["row", "k", "data", "first", "last"])

    def one() -> Callable[[bytes, int, int], dict]:
        both = pair(a, b)
        return lambda data, first, last: both.fragment(words(data.decode()[1:]), first, last)

    parts = docs.select(F.col(row).alias("row"), F.col(text).alias("t")).mapInArrow(ranges, "row long, k long, data binary, first long, last long").repartition("row", "k")
    tree = parts.select("row", "k", per_row(one, FRAGMENT, FRAGMENT_ARROW, F.col("data"), F.col("first"), F.col("last")).alias("f"))
    most = docs.agg(F.max(F.octet_length(text))).first()[0] or 0
    left = 2 + most // size
    while left > 1:
        groups = tree.groupBy("row", F.floor(F.col("k") / FAN).alias("k")).agg(F.array_sort(F.collect_list(F.struct("k", "f"))).alias("fs"))
        tree = groups.select("row", "k", per_row(lambda: compose, FRAGMENT, FRAGMENT_ARROW, F.col("fs.f")).alias("f"))
        left = -(-left // FAN)
    return tree.select("row", "f")


def most_pairs(a: str, b: str) -> int:
    """A bound of the linked pairs of two vocabularies: the bytes of one token end those of the other."""
    both = pair(a, b)
    n = 0
    for ours, theirs in ((both.a_bytes, both.b_bytes), (both.b_bytes, both.a_bytes)):
        of = Counter(theirs)
        n += sum(of[t[k:]] for t in ours for k in range(len(t)))
    return n


def summed(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Sums of (codes, counts), in one batch."""
    codes, n = np.zeros((2, 0), np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def add() -> None:
        nonlocal codes, n, held
        every = np.concatenate([codes, *(c for c, _ in held)])
        weights = np.concatenate([n, *(w for _, w in held)])
        codes, at = np.unique(every, return_inverse=True)
        n = np.bincount(at, weights, len(codes)).astype(np.int64)  # exact up to 2**53
        held = []

    for part in parts:
        held.append(part)
        if len(held) >= 32:
            add()
    add()
    yield pa.RecordBatch.from_arrays([pa.array(codes >> SHIFT), pa.array(codes & np.int64(0xFFFFFFFF)), pa.array(n)], ["a_id", "b_id", "n"])


def linked(a: str, b: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function: texts -> (a_id, b_id, n). Words are counted first, and encoded when there are two times ``WORDS`` different ones: those that came once, or
    all of them if the others are many or the texts have ``COUNTED`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a, b)

        def of(held: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for some in parted(held):
                codes, each = both.encode(some).links(both)
                yield codes, np.repeat(np.fromiter(map(held.__getitem__, some), np.int64, len(some)), each)

        def spelled(ws: list[str]) -> bool:
            return bool(both.encode([w for w in ws if SPACE_SIGN in w]).whole.all())

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held: Counter = Counter()
            letters = 0
            for batch in batches:
                for t in batch.column(0):
                    text = t.as_py()
                    ws = words(text) if text else []
                    if SPACE_SIGN not in text or spelled(ws):
                        held.update(ws)
                        letters += len(text)
                    if len(held) >= 2 * WORDS or letters >= COUNTED:
                        kept = Counter({w: n for w, n in held.items() if n > 1})
                        if len(kept) >= WORDS or letters >= COUNTED:
                            kept.clear()
                        yield from of({w: n for w, n in held.items() if w not in kept})
                        held, letters = kept, sum(map(len, kept))
            yield from of(held)

        yield from summed(parts())

    return run


def counted(short: DataFrame, whole: DataFrame, text: str, a: str, b: str) -> DataFrame:
    """(a_id, b_id, n) over short texts and whole fragments."""

    def of_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from summed((x := links(f.as_py()), np.ones(len(x), np.int64)) for batch in batches for f in batch.column(0) if f.as_py()["whole"])

    kind = "a_id long, b_id long, n long"
    every = short.where(F.col(text) != "").select(text).mapInArrow(linked(a, b), kind).union(whole.select("f").mapInArrow(of_fragments, kind))
    return every.groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))


class Scores:
    """Counts of all pairs, and of each B id the highest."""

    def __init__(self, rows: pa.Table) -> None:
        codes = rows.column("a_id").to_numpy() << SHIFT | rows.column("b_id").to_numpy()
        order = np.argsort(codes)
        self.codes, self.n = codes[order], rows.column("n").to_numpy()[order]
        b = self.codes & np.int64(0xFFFFFFFF)
        highest = np.zeros(int(b.max(initial=0)) + 1, np.int64)
        np.maximum.at(highest, b, self.n)
        self.best = self.n == highest[b]

    def found(self, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each link is its B id's best, and its count; pairs that only texts without tokens have count nothing."""
        if not len(self.codes):
            return np.zeros(len(linked), bool), np.zeros(len(linked), np.int64)
        at = np.minimum(np.searchsorted(self.codes, linked), len(self.codes) - 1)
        there = self.codes[at] == linked
        return self.best[at] & there, self.n[at] * there

    def of_words(self, both: Pair, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """For each word a row of ``SUMS`` (zeros before the last for a word that isn't whole), and its groups."""
        every = both.encode(words)
        ok = every.spelled()
        linked, each = ok.links(both)
        word = np.repeat(np.arange(len(each)), each)
        rows = np.zeros((len(words), len(SUMS)), np.int64)
        rows[every.whole, :-1] = np.stack([*ok.sizes, each, *(np.bincount(word, x, len(each)).astype(np.int64) for x in self.found(linked))], axis=1)
        rows[:, -1] = ~every.whole
        groups = iter(ok.said(both))
        return rows, [next(groups) if w else "" for w in every.whole.tolist()]

    def of(self, fragment: dict) -> tuple[int, int, int, int, int, str]:
        """As of_words, of a whole fragment."""
        best, n = self.found(links(fragment))
        return len(fragment["a"]) // 4, len(fragment["b"]) // 4, len(n), int(best.sum()), int(n.sum()), said(fragment)


NAMES = ("n_a", "n_b", "n_groups", "n_best", "count_sum", "groups")
ALIGNED = "struct<n_a:long,n_b:long,n_groups:long,n_best:long,count_sum:long,groups:string>"
ALIGNED_ARROW = pa.struct([(k, pa.int64()) for k in NAMES[:-1]] + [(NAMES[-1], pa.string())])
NONE = dict.fromkeys(NAMES, 0) | {"groups": ""}
#: Of a word, or summed over a text's words.
SUMS = (*NAMES[:-1], "n_not_whole")


class Known:
    """Words that are remembered, each with its row of ``SUMS`` and its groups."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.rows, self.groups = np.zeros((0, len(SUMS)), np.int64), []

    def add(self, words: list[str], rows: np.ndarray, groups: list[str]) -> None:
        n, more = len(self.at), len(self.at) + len(words)
        self.at.update(zip(words, range(n, more), strict=True))
        if more > len(self.rows):
            self.rows = np.concatenate([self.rows[:n], np.zeros((more, len(SUMS)), np.int64)])
        self.rows[n:more] = rows
        self.groups += groups

    def of(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        at = list(map(self.at.__getitem__, words))
        return self.rows[np.array(at, np.int64)], list(map(self.groups.__getitem__, at))


def scored(shared: Broadcast, a: str, b: str) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """A task's function: texts -> ALIGNED, by the ``Scores`` that are shared."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        both, scores = pair(a, b), shared.value
        young, old = Known(), Known()
        for texts in batches:
            at = 0
            while at < len(texts):
                every: list[str] = []
                ends, held = [0], 0
                while at < len(texts) and held < TEXTS:
                    text = texts[at].as_py() or ""
                    every += words(text) if text else []
                    ends.append(len(every))
                    held += len(text)
                    at += 1
                if len(young.at) >= WORDS:
                    young, old = Known(), young
                missing = set(every).difference(young.at)
                again = [w for w in missing if w in old.at]
                if again:
                    young.add(again, *old.of(again))
                for some in parted(missing.difference(again)):
                    young.add(some, *scores.of_words(both, some))
                rows, groups = young.of(every)
                sums = np.diff(np.concatenate([np.zeros((1, len(SUMS)), np.int64), np.cumsum(rows, axis=0)])[ends], axis=0)
                ok = (sums[:, -1] == 0) & (sums[:, 0] > 0)
                said = [";".join(groups[x:y]) if w else "" for x, y, w in zip(ends[:-1], ends[1:], ok.tolist(), strict=True)]
                yield pa.StructArray.from_arrays([*map(pa.array, (sums[:, :-1] * ok[:, None]).T), pa.array(said, pa.string())], fields=list(ALIGNED_ARROW))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def prepared(docs: DataFrame, text: str, a: str, b: str, size: int) -> tuple[DataFrame, DataFrame, str, DataFrame]:
    """(short documents, stored long ones with a row number, its name, the long ones' stored fragments)."""
    (row,) = fresh(docs, "row")
    is_long = F.coalesce(F.octet_length(text) > size, F.lit(False))
    long = stored(docs.where(is_long).withColumn(row, F.monotonically_increasing_id()))
    return docs.where(~is_long), long, row, stored(composed(long, row, text, a, b, size))


def pair_counts(docs: DataFrame, text: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", size: int = CHUNK) -> DataFrame:
    """(a_id, b_id, n): how many links of all documents hold two ids linked. See ``align``."""
    short, _, _, whole = prepared(docs, text, a, b, size)
    return counted(short, whole, text, a, b)


def align(docs: DataFrame, text: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", size: int = CHUNK) -> DataFrame:
    """docs with struct ``aligned`` (replaces a column of that name): n_a and n_b tokens, n_groups (each has one link, of its last tokens), n_best (links whose count
    is their B id's highest in the corpus, ties included), count_sum (of the links' counts) and ``groups``, as ``said`` writes them.

    A text that is null, empty or not spelled by either's tokens (B spells U+2581 as a space) has no tokens: zeros and an empty string, and its links don't
    count. Texts of any length are encoded whole; a part of a text without any space after a visible ASCII character is one task's. Rows that repeat a text count each.
    An empty table gives an empty result. The documents are read twice.
    """
    short, long, row, whole = prepared(docs, text, a, b, size)
    counts = counted(short, whole, text, a, b).toArrow()  # bounded by the vocabularies
    if counts.num_rows > most_pairs(a, b):
        raise AssertionError("more pairs than the vocabularies allow")
    shared = docs.sparkSession.sparkContext.broadcast(Scores(counts))

    def of_fragment() -> Callable[[dict], dict]:
        scores = shared.value
        return lambda f: dict(zip(NAMES, scores.of(f), strict=True)) if f["whole"] else NONE

    r, f = fresh(long, "r", "f")
    joined = long.join(whole.select(F.col("row").alias(r), F.col("f").alias(f)), F.col(row) == F.col(r))
    of_long = per_row(of_fragment, ALIGNED, ALIGNED_ARROW, F.col(f))
    return put(short, aligned=F.arrow_udf(scored(shared, a, b), ALIGNED)(F.col(text))).union(put(joined, aligned=of_long).drop(row, r, f))
