import hashlib
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from sessionlake.llm import crosstoken, queries
from sessionlake.llm.packing import byte_letters
from tokenizers import Tokenizer
from pyspark.sql import functions as F

NAMES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
A = Tokenizer.from_file(public_tokenizers.path(NAMES[0]))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(NAMES[1]))
BACK = {chr(letter): byte for byte, letter in byte_letters().items()}


def tokens(text):
    """(id, bytes) of the whole text by either tokenizer."""
    a = A.encode(" " + text, add_special_tokens=False)
    b = B.encode(text)
    spell = lambda i: bytes([int(B.id_to_piece(i)[1:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()
    return [(i, bytes(BACK[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)], [(i, spell(i)) for i in b]


def groups(text):
    """Groups as lists of ids, by sets of ends; [] without tokens."""
    if not text:
        return []
    both = tokens(text)
    if any(b"".join(x for _, x in t) != (" " + text).encode() for t in both):
        return []
    ends = []
    for t in both:
        at, mine = 0, []
        for i, x in t:
            at += len(x)
            mine.append((at, i))
        ends.append(mine)
    common = {e for e, _ in ends[0]} & {e for e, _ in ends[1]}
    parts = []
    for mine in ends:
        parts.append([[]])
        for e, i in mine:
            parts[-1][-1].append(i)
            if e in common:
                parts[-1].append([])
    return list(zip(parts[0][:-1], parts[1][:-1], strict=True))


def brute(texts):
    """(n_a, n_b, n_groups, n_best, count_sum, groups) of each text."""
    each = [groups(t) for t in texts]
    counts = Counter((a[-1], b[-1]) for g in each for a, b in g)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for g in each:
        linked = [(a[-1], b[-1]) for a, b in g]
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(counts[x] == best[x[1]] for x in linked), sum(counts[x] for x in linked), said))
    return out


ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b \n\n c\n", "\n\nx\ty\r\n z", "don't we'll 'tis o'clock's", "▁", "a▁b and more", "x ▁ y", "<|endoftext|> <s> </s> <0x41> <unk>",
    "日本語のテキスト。 中文字符", "é é ﬁ ２ ² ²." , "👩‍👩‍👧‍👦 emoji​ nbsp　wide   x", "a\x00b\x1c c\x85 d", "e.g. www.x.com. 3.14 1,000 (x) [y] {z} a.b,c;d:e!f?g", "x" * 500, "=" * 300, "    def f(x):\n        return x\n\n\n", "a.\nB.\n\nC\n D", "word_word __x__ 1st 2nd²",
]


def mixed(n, seed):
    rng = random.Random(seed)
    pool = [" ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "'", "▁", "é", "日", "👍", "²", "_", "-", "<", ">", " ", "　"]
    return ["".join(rng.choice(pool) if rng.random() < 0.4 else rng.choice(["the", "and", "Th", "x", "7", "ontion", "q9"]) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def run(df, **options):
    return {r["k"]: tuple(r["aligned"]) for r in crosstoken.align(df, **options).select("k", "aligned").collect()}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k long, text string")


def test_whole_documents_of_odd_texts(spark):
    texts = [*ODD, *mixed(400, 1)]
    got = run(frame(spark, [*texts, None]).withColumn("Aligned", F.lit(1)).withColumn("row", F.lit(2)).withColumn("f", F.lit(3)))
    want = dict(enumerate([*brute(texts), (0, 0, 0, 0, 0, "")]))
    assert got == want
    assert sum(w[0] == 0 for w in want.values()) > 20  # texts with the space sign


@pytest.mark.parametrize("size", [7, 16, 64])
def test_fragments_of_small_ranges_compose_to_the_whole(spark, size):
    texts = [*[t.replace("▁", "") for t in ODD], *mixed(60, 2), "the and thing ontion " * 40, "y" * 200 + " end"]
    got = run(frame(spark, texts), size=size)
    assert got == dict(enumerate(brute(texts)))


def test_composition_is_associative_and_groups_stay_open():
    both = crosstoken.pair(*NAMES)
    text = "Unbelievably anthropomorphic thhewhes reinstitutionalization, ordinarily."
    ws, n = crosstoken.words(text), len(text) + 1
    whole = both.fragment(ws)
    rng = random.Random(3)
    for _ in range(200):
        at = sorted({0, n, *(rng.randrange(1, n) for _ in range(4))})
        fs = [both.fragment(ws, i, j) for i, j in zip(at, at[1:], strict=False)]
        k = rng.randrange(1, len(fs)) if len(fs) > 1 else 0
        empty = both.fragment(ws, n, n)
        assert crosstoken.compose(fs) == whole == crosstoken.compose([crosstoken.compose(fs[:k]), empty, crosstoken.compose(fs[k:])])
    assert crosstoken.said(whole) == brute([text])[0][5]
    parts = [both.fragment(ws, i, i + 1) for i in range(n)]
    assert any(not p["a_cuts"] and p["a"] for p in parts)  # a fragment that is open throughout


def test_ranges_cover_each_byte_once_and_long_words_go_to_one():
    for data in (b" a bb ccc dddd" * 50, b" " + b"x" * 1000, b" ab " + b"y" * 333 + b" c d e" * 9, b" \n \n" * 80, b" "):
        for size in (5, 16, 100):
            rs = list(crosstoken.chunks(data, size))
            assert [r[1] for r in rs] == [0, *(r[2] for r in rs[:-1])] and rs[-1][2] == len(data)
            assert all(b <= f < l <= e for b, f, l, e in rs)
            assert sum(e - b for b, _, _, e in rs) <= 3 * len(data) + size


def test_one_long_word_is_encoded_once(spark):
    text = "start " + "z" * 300_000 + " end"
    rs = list(crosstoken.chunks((" " + text).encode(), 1 << 12))
    assert max(e - b for b, _, _, e in rs) < 310_000 and sum(e - b for b, _, _, e in rs) < 330_000


def test_pair_counts_and_their_bound(spark):
    texts = [*ODD, *mixed(50, 4), "the and " * 100]
    want = Counter((a[-1], b[-1]) for t in texts for a, b in groups(t))
    for size in (1 << 16, 32):
        assert {(r["a_id"], r["b_id"]): r["n"] for r in crosstoken.pair_counts(frame(spark, texts), size=size).collect()} == want
    both = crosstoken.pair(*NAMES)
    for a, b in want:
        x, y = both.a_bytes[a], both.b_bytes[b]
        assert x.endswith(y) or y.endswith(x)
    assert len(want) <= crosstoken.most_pairs(*NAMES) < 1_000_000


def test_memories_may_be_cleared_at_any_time(monkeypatch):
    for name, n in (("WORDS", 3), ("BATCH", 2), ("TEXTS", 10)):
        monkeypatch.setattr(crosstoken, name, n)
    texts = [*ODD, *mixed(50, 5)]
    rows = [{"text": t} for t in texts]
    counts = Counter((a[-1], b[-1]) for t in texts for a, b in groups(t))
    scores = crosstoken.Scores(pa.table({"a_id": [a for a, _ in counts], "b_id": [b for _, b in counts], "n": list(counts.values())}))
    got = [x for batch in crosstoken.scored(SimpleNamespace(value=scores), *NAMES)(iter([pa.array([r["text"] for r in rows])])) for x in batch.to_pylist()]
    assert [tuple(x.values()) for x in got] == brute(texts)
    counted = list(crosstoken.linked(*NAMES)(iter([pa.record_batch({"t": texts})])))
    assert {(a, b): n for b in counted for a, b, n in zip(*b.to_pydict().values(), strict=True)} == counts


def calls(monkeypatch, both):
    """Texts given to A's fast encoder."""
    given, fast = [], both.fast
    monkeypatch.setattr(both, "fast", lambda text: given.append(text) or fast(text))
    return given


def test_words_are_encoded_joined(monkeypatch):
    both = crosstoken.pair(*NAMES)
    given = calls(monkeypatch, both)
    words = [f"thing{i}onti, é{i}" if i % 5 == 0 else f"un{i}der." for i in range(1000)]
    together = both.encode(words)
    assert len(given) <= 2 * 1000 / crosstoken.JOINED
    each = [both.alone([w]) for w in words]
    for k in (0, 1):
        assert together.ids[k].tolist() == [i for e in each for i in e.ids[k].tolist()] and together.sizes[k].tolist() == [len(e.ids[k]) for e in each]


@pytest.mark.parametrize("joined, letters", [(1, 1 << 12), (3, 1 << 12), (64, 9), (64, 1 << 12)])
def test_joined_words_have_the_tokens_of_words_alone(monkeypatch, joined, letters):
    monkeypatch.setattr(crosstoken, "JOINED", joined)
    monkeypatch.setattr(crosstoken, "LETTERS", letters)
    both = crosstoken.pair(*NAMES)
    rng = random.Random(6)
    every = list(dict.fromkeys(w for t in [*ODD, *mixed(300, 7)] for w in crosstoken.words(t)))
    for n in (1, 2, 20, len(every)):
        words = rng.sample(every, n)
        together, each = both.encode(words), both.alone(words)
        for k in (0, 1):
            assert together.ids[k].tolist() == each.ids[k].tolist() and together.sizes[k].tolist() == each.sizes[k].tolist()
        assert together.lengths.tolist() == each.lengths.tolist() and together.whole.tolist() == each.whole.tolist()


def test_frequent_words_are_encoded_once_by_the_count(monkeypatch):
    monkeypatch.setattr(crosstoken, "WORDS", 50)
    given = calls(monkeypatch, crosstoken.pair(*NAMES))
    texts = [f"often again thing{i} on{i}ti" for i in range(500)]
    for limit in (1 << 26, 400):
        monkeypatch.setattr(crosstoken, "COUNTED", limit)
        given.clear()
        got = list(crosstoken.linked(*NAMES)(iter([pa.record_batch({"t": texts})])))
        want = Counter((a[-1], b[-1]) for t in texts for a, b in groups(t))
        assert {(a, b): n for r in got for a, b, n in zip(*r.to_pydict().values(), strict=True)} == want
        assert (sum(t.split().count("often") for t in given) == 1) == (limit > 400)


def test_batches_without_any_text(spark):
    scores = crosstoken.Scores(pa.table({k: pa.array([], pa.int64()) for k in ("a_id", "b_id", "n")}))
    got = list(crosstoken.scored(SimpleNamespace(value=scores), *NAMES)(iter([pa.array([None, ""], pa.string()), pa.array(["a b", None])])))
    assert [x["n_a"] for r in got for x in r.to_pylist()] == [0, 0, 2, 0]


def test_only_texts_without_tokens(spark):
    assert set(run(frame(spark, ["▁", "a ▁ b"] * 5)).values()) == {(0, 0, 0, 0, 0, "")}


def test_empty_table(spark):
    df = spark.createDataFrame([], "k long, text string")
    assert crosstoken.align(df).collect() == [] and crosstoken.pair_counts(df).collect() == []


def test_query_equals_brute_force(spark, sf, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (sf, str(tmp_path)):
        rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
        want = [(r["doc_id"], *w[:3], w[2], *w[3:5], hashlib.sha256(w[5].encode()).hexdigest() if w[0] else "") for r, w in zip(rows, brute([r["text"] for r in rows]), strict=True)]
        df = queries.op12_token_alignment(spark, folder)
        assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
