"""Operator 7. Token counts of sections, by offset mapping.

A whole document is encoded once. A byte-level token stands for known bytes, so that the running
sum of the tokens' byte lengths gives every token's span in the text. The spans are joined with the document's
sections by bisection of the section borders. A token that crosses a border is counted once, by rule:

* ``start`` (default): in the section that holds its first byte;
* ``majority``: in the section that holds most of its bytes, the first of equal ones.

What lies in no section is counted under section null. Row by row, no shuffle.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_row, put

RULES = ("start", "majority")
#: Characters that are encoded at once, up to the next white space after something else: no token spans such a place, nor does
#: the split before it depend on what follows.
SEGMENT, CUT = 1 << 20, re.compile(r"(?<=\S)\s")


def vocabulary(name: str) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """(encoder, byte lengths of the ids). ``name``: a rank file of public_tokenizers, or a path."""
    import public_tokenizers
    import tiktoken

    with open(name if "/" in name else public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, lengths


def spans(text: str, encode: Callable[[str], list[int]], lengths: np.ndarray) -> np.ndarray:
    """First byte of every token, and the text's end."""
    parts, at = [], 0
    while at < len(text):
        cut = CUT.search(text, at + SEGMENT)
        end = cut.start() if cut else len(text)
        parts.append(lengths[encode(text[at:end])])
        at = end
    return np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *parts]))])


def count(rule: str, name: str) -> Callable[[bytes | None, list[dict] | None], dict]:
    encode, lengths = vocabulary(name)

    def one(text: bytes | None, sections: list[dict] | None) -> dict:
        data = text or b""
        first = spans(data.decode(), encode, lengths)
        n = len(first) - 1
        points = np.concatenate([np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), [len(data)]])  # bytes of characters
        order = sorted(range(len(sections or [])), key=lambda i: (sections[i]["start"], sections[i]["end"]))
        clip = lambda x: points[min(max(x, 0), len(points) - 1)]
        starts = np.array([clip(sections[i]["start"]) for i in order], np.int64)
        ends = np.array([clip(sections[i]["end"]) for i in order], np.int64)
        got = np.zeros(len(order), np.int64)
        if n and len(order):
            begin, stop = first[:-1], first[1:]
            if rule == "start":
                at = np.searchsorted(starts, begin, "right") - 1
                # Of sections that start at one place, empty ones come first; the last one holds the byte.
                got = np.bincount(at[(at >= 0) & (begin < ends[np.maximum(at, 0)])], minlength=len(order))
            else:
                low, high = np.searchsorted(ends, begin, "right"), np.searchsorted(starts, stop)
                one_only = high - low == 1
                inside = np.minimum(stop[one_only], ends[low[one_only]]) - np.maximum(begin[one_only], starts[low[one_only]])
                most = 2 * inside >= (stop - begin)[one_only]
                got = np.bincount(low[one_only][most], minlength=len(order))
                for t in np.flatnonzero(high - low > 1):
                    k = np.arange(low[t], high[t])
                    share = np.minimum(stop[t], ends[k]) - np.maximum(begin[t], starts[k])
                    out = stop[t] - begin[t] - share.sum()
                    if share.max() >= out:
                        got[k[share.argmax()]] += 1
        counts = [0] * len(order)
        for place, i in enumerate(order):
            counts[i] = int(got[place])
        return {"doc_tokens": n, "outside": n - sum(counts), "counts": counts}

    return one


KIND = pa.struct([("doc_tokens", pa.int64()), ("outside", pa.int64()), ("counts", pa.list_(pa.int64()))])


def attribute(docs: DataFrame, sections: Column, text: str = "text", rule: str = "start", tokenizer_name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """docs with struct ``tokens`` (replaces a column of that name): ``doc_tokens``, ``outside`` (in no section) and ``counts``, a number per section.

    sections: array of struct(start, end), places in code points, end exclusive, that don't overlap; in any order.
    A null text has no tokens; null sections are none. Rows that repeat a document are treated alike.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    found = per_row(lambda: count(rule, tokenizer_name), "struct<doc_tokens:long,outside:long,counts:array<long>>", KIND, F.col(text), sections)
    return put(docs, tokens=found)


def line_spans(text: bytes | None) -> list[dict] | None:
    if text is None:
        return None
    ends = np.cumsum([len(x) + 1 for x in text.decode().split("\n")])
    ends[-1] -= 1
    return [{"start": a, "end": b} for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def lines(text: str) -> Column:
    """A section for each line with the newline that ends it."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return per_row(lambda: line_spans, "array<struct<start:long,end:long>>", pa.list_(span), F.col(text))
