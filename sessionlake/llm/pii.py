"""Operator 10. Personal data: candidate spans judged by gradient-boosted trees.

Fixed formats (email, ip, card, phone) always count. Beside them, generators with high recall propose
spans that may overlap each other: anything around an @ sign, spelled-out addresses, dotted numbers, and
every long run of digits and separators, read as a card (12 to 19 digits) and as a phone number (7 to 15). Trees that were boosted on
format and context features score each proposal; a proposal at or above its kind's calibrated threshold is
redacted too. Of overlapping proposals the best score wins (ties: the first one, then the kind as listed), and
none may overlap a fixed-format span.

Training needs no labels from people. A proposal that overlaps a fixed-format span of its kind is an example, once as it is and once with
the telling feature (plus sign, at sign) masked. Of the proposals that overlap no fixed-format span, the only ones that can be added, those that
pass their kind's format check and have its context word are examples (``likely``); all others are counter-examples. The features are small whole
numbers, so Spark counts the examples of each feature vector over the whole corpus, and the trees are grown from that table of counts, whose size
is bounded by the features' values and not by the corpus. Documents with an odd hash calibrate, the others train: a threshold is the lowest
score at which the precision over calibration's addable proposals is ``precision`` or more (none: nothing is added).
Scoring is a SQL expression. No Python runs on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .spans import locate, none, of_kind, overlap, redacted

# Fixed formats, as the result's contract states them, in forms that take linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

# Generators.
AROUND_AT = r"(?<![^\s@\"'<>()|,;])[^\s@\"'<>()|,;]++@[^\s@\"'<>()|,;]++"
SPELLED = r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[a-z0-9-]{1,64}(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[a-z0-9-]{1,64}){1,4}"
DOTTED = r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3,}+"
DIGITS = r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().\-/]{0,2}+[0-9]){6,}+"

#: Words that make a kind likelier when they stand shortly before a span.
CONTEXT = (r"(?i)(?:tel|phone|call|fax|mobil|whatsapp)", r"(?i)(?:card|visa|master|credit|karte|tarjeta|carte)", r"(?i)(?:mail|contact|write to|@)", r"(?i)(?:\bip\b|addr|host|server)", r"(?i)(?:order|invoice|isbn|issn|version|\bid\b|no\.|nr\.|#)")
#: Context words of the labels, as whole words.
CALLED, CHARGED = r"(?i)\b(?:tel|telephone|telefon|phone|call|fax|mobile?|whatsapp)\b", r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|tarjeta|carte)\b"
#: Name and largest value of each feature; they start from 0.
FEATURES = (("kind", 3), ("lead", 2), ("digits", 6), ("separators", 3), ("dots", 3), ("bracket", 1), ("luhn", 1), ("octets", 1), ("at", 2), ("context", 5), ("left", 2), ("right", 2))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def octets(s: Column) -> Column:
    """Whether the parts between dots are all 255 at most."""

    def small(x: Column) -> Column:
        digits_ = F.ltrim(x, F.lit("0"))
        return (F.length(digits_) < 3) | ((F.length(digits_) == 3) & (digits_ <= "255"))

    return F.forall(F.split(s, r"\."), small)


def base(df: DataFrame, text: str) -> DataFrame:
    """df with ``__base``: the fixed formats' spans, by kind as listed, then start. text has no nulls."""
    some = F.col("__digit")
    df = df.withColumn("__digit", F.col(text).rlike("[0-9]"))
    df = locate(df, "__e", text, "email", EMAIL, where=F.col(text).contains("@"))
    df = locate(df, "__i", text, "ip", IP, where=some & F.col(text).contains("."))
    df = locate(df, "__c", text, "card", CARD, where=some)
    df = locate(df, "__f", text, "phone", PHONE, where=some & F.col(text).contains("+"))
    kept = F.concat(
        "__e",
        F.filter("__i", lambda s: octets(s["value"])),
        F.filter("__c", lambda s: F.length(digits(s["value"])).between(16, 19) & luhn(digits(s["value"]))),
        F.filter("__f", lambda s: F.length(digits(s["value"])).between(8, 15)),
    )
    return df.withColumn("__base", kept).drop("__e", "__i", "__c", "__f")


def proposals(df: DataFrame, text: str) -> DataFrame:
    """df with ``__cand``: array of struct(s: span, f: struct of features)."""
    some = F.col("__digit")
    df = locate(df, "__e", text, "email", AROUND_AT, where=F.col(text).contains("@"))
    df = locate(df, "__s_", text, "email", SPELLED, where=F.lower(text).rlike(r"[\[(]at[\])]"))
    df = locate(df, "__i", text, "ip", DOTTED, where=some & F.col(text).contains("."))
    df = locate(df, "__c", text, "card", DIGITS, where=some)

    def read_as(kind: str, least: int, most: int) -> Column:
        return F.transform(F.filter("__c", lambda s: F.length(digits(s["value"])).between(least, most)), lambda s: s.withField("kind", F.lit(kind)))

    df = df.withColumn("__all", F.concat("__e", "__s_", "__i", read_as("card", 12, 19), read_as("phone", 7, 15))).drop("__e", "__s_", "__i", "__c")

    def features(s: Column) -> Column:
        v, before = s["value"], s["before"]
        n = F.length(digits(v))
        context = F.lit(0)
        for i, words in reversed(list(enumerate(CONTEXT))):
            context = F.when(before.rlike(words), i + 1).otherwise(context)

        def beside(c: Column) -> Column:
            return F.when(c.rlike(r"^[\p{L}0-9]$"), 2).when(c.rlike(r"^\S$"), 1).otherwise(0)

        def upto(c: Column, most: int) -> Column:
            return F.least(c, F.lit(most))

        values = {
            "kind": F.when(s["kind"] == "email", 0).when(s["kind"] == "ip", 1).when(s["kind"] == "card", 2).otherwise(3),
            "lead": F.when(v.startswith("+"), 1).when(v.startswith("("), 2).otherwise(0),
            "digits": F.when(n < 7, 0).when(n < 8, 1).when(n < 12, 2).when(n < 16, 3).when(n < 17, 4).when(n < 20, 5).otherwise(6),
            "separators": upto(F.length(F.regexp_replace(v, r"[^ \-/]", "")), 3),
            "dots": upto(F.length(F.regexp_replace(v, r"[^.]", "")), 3),
            "bracket": v.contains("(").cast("int"),
            "luhn": F.when(n.between(12, 19), luhn(digits(v)).cast("int")).otherwise(0),
            "octets": F.when(s["kind"] == "ip", octets(v)).otherwise(F.lit(False)).cast("int"),
            "at": F.when(v.rlike(r"@.*\.[A-Za-z]{2,10}$"), 2).when(v.contains("@"), 1).otherwise(0),
            "context": context,
            "left": beside(F.right(before, F.lit(1))),
            "right": beside(s["after"]),
        }
        return F.struct(*[F.coalesce(values[name].cast("int"), F.lit(0)).alias(name) for name, _ in FEATURES])

    return df.withColumn("__cand", F.transform("__all", lambda s: F.struct(s.alias("s"), features(s).alias("f")))).drop("__all")


@dataclass
class Model:
    """Trees are nested tuples (feature, largest value of the left branch, left, right), leaves are numbers."""

    start: float
    trees: list
    thresholds: dict[int, float]

    def score(self, f: Column) -> Column:
        def walk(t) -> Column:
            return F.lit(float(t)) if not isinstance(t, tuple) else F.when(f[FEATURES[t[0]][0]] <= t[1], walk(t[2])).otherwise(walk(t[3]))

        total = F.lit(self.start)
        for t in self.trees:
            total = total + walk(t)
        return 1 / (1 + F.exp(-total))

    def chosen(self, f: Column) -> Column:
        least = F.lit(None).cast("double")
        for kind, value in self.thresholds.items():
            least = F.when(f["kind"] == kind, value).otherwise(least)
        return F.coalesce(self.score(f) >= least, F.lit(False))


def apply_tree(t, x: np.ndarray) -> np.ndarray:
    if not isinstance(t, tuple):
        return np.full(len(x), t)
    return np.where(x[:, t[0]] <= t[1], apply_tree(t[2], x), apply_tree(t[3], x))


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float):
    """A tree of Newton steps: gradients g and curvatures h, summed by row."""
    best, at = 1e-9, None
    if depth:
        whole = g.sum() ** 2 / (h.sum() + 1)
        for j, (_, most) in enumerate(FEATURES):
            gs, hs = (np.cumsum(np.bincount(x[:, j], v, most + 1)) for v in (g, h))
            gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - whole
            k = int(gain[:-1].argmax())
            if gain[k] > best:
                best, at = gain[k], (j, k)
    if at is None:
        return -rate * g.sum() / (h.sum() + 1)
    left = x[:, at[0]] <= at[1]
    return (*at, grow(x[left], g[left], h[left], depth - 1, rate), grow(x[~left], g[~left], h[~left], depth - 1, rate))


def boost(x: np.ndarray, yes: np.ndarray, no: np.ndarray, trees: int = 12, depth: int = 3, rate: float = 0.5) -> Model:
    """Log-loss boosting over a table of feature vectors with their counts of examples and counter-examples. Each tree splits by kind first: a run
    of digits is read as a card and as a phone number, and the readings' labels are often opposite."""
    start = float(np.clip(np.log((yes.sum() + 1) / (no.sum() + 1)), -8, 8))
    total, grown = np.full(len(x), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p * (yes + no) - yes, p * (1 - p) * (yes + no)
        own = [grow(x[of], g[of], h[of], depth, rate) for of in (x[:, 0] == k for k in range(len(KINDS)))]
        grown.append((0, 0, own[0], (0, 1, own[1], (0, 2, own[2], own[3]))))
        total += apply_tree(grown[-1], x)
    return Model(start, grown, {})


def likely(c: Column) -> Column:
    """Whether a proposal outside the fixed formats is taken for personal data in training: its format check holds, and numbers follow a context word."""
    f, before, n = c["f"], c["s"]["before"], F.length(digits(c["s"]["value"]))
    card = n.between(13, 19) & (f["luhn"] == 1) & before.rlike(CHARGED)
    return F.when(f["kind"] == 0, f["at"] != 1).when(f["kind"] == 2, card).when(f["kind"] == 3, n.between(7, 15) & before.rlike(CALLED)).otherwise(False)


def counted(df: DataFrame) -> list:
    """Rows (half, f, free, yes, n) from documents with ``id``, ``base`` and ``cand``: how often each feature vector occurs, and as an example."""

    def rows_of(c: Column) -> Column:
        f, own = c["f"], F.exists("base", lambda b: (b["kind"] == c["s"]["kind"]) & overlap(b, c["s"]))
        free = ~F.exists("base", lambda b: overlap(b, c["s"]))
        row = lambda f, y, free: F.struct(f.alias("f"), y.alias("y"), free.alias("free"))
        masked = F.struct(*[F.lit(0).alias(k) if k in ("lead", "at") else f[k].alias(k) for k, _ in FEATURES])
        return F.when(own, F.array(row(f, F.lit(True), free), row(masked, F.lit(True), free))).otherwise(F.array(row(f, free & likely(c), free)))

    c = F.explode(F.flatten(F.transform("cand", rows_of)))
    seen = df.where(F.size("cand") > 0).select(F.pmod(F.xxhash64("id"), F.lit(2)).alias("half"), c.alias("c"))
    return seen.groupBy("half", "c.f", "c.free").agg(F.sum(F.col("c.y").cast("long")).alias("yes"), F.count("*").alias("n")).orderBy("half", "f", "free").collect()


def learn(table: list, precision: float) -> Model | None:
    """The model from the rows of ``counted``; None without any."""
    if not table:
        return None
    x = np.array([list(r["f"]) for r in table])
    yes, n, half, free = (np.array([r[k] for r in table], float) for k in ("yes", "n", "half", "free"))
    train = half == 0 if (half == 0).any() else half == 1
    model = boost(x[train], yes[train], (n - yes)[train])
    check = half == 1 if (half == 1).any() else train
    score = 1 / (1 + np.exp(-(model.start + sum(apply_tree(t, x) for t in model.trees))))
    for kind in range(len(KINDS)):
        rows = np.flatnonzero(check & (free == 1) & (x[:, 0] == kind))
        rows = rows[np.argsort(-score[rows], kind="stable")]
        good = np.cumsum(yes[rows]) >= precision * np.cumsum(n[rows])
        last = np.append(score[rows][1:] != score[rows][:-1], True) if len(rows) else good  # whole ties only
        if (good & last).any():
            model.thresholds[kind] = float(score[rows][np.flatnonzero(good & last)[-1]]) - 1e-9
    return model


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", precision: float = 0.995, keep_text: bool = True) -> DataFrame:
    """docs with ``base_spans`` and ``spans`` (arrays of kind, start, end, value, part, before, after, by kind as listed, then start; they
    replace columns of these names); without the text unless keep_text.

    Texts are searched once: what was found is stored (with the text only if that is kept), counted for the model, and read again. A null text counts as empty. Equal texts get equal
    spans. Texts of any length are searched whole, in time that is linear in their length but for proposals times fixed spans. Rows with a null id take
    part in training like others. Any column names of docs may be used. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in ("base_spans", "spans") and (keep_text or c != text)]
    slim = docs.select(F.coalesce(F.col(text), F.lit("")).alias("__t"), F.col(doc_id).alias("id"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    found = proposals(base(slim, "__t"), "__t")
    df = stored(found.select("id", "row", F.col("__base").alias("base"), F.col("__cand").alias("cand")))
    model = learn(counted(df.select("id", "base", "cand")), precision)
    spans = F.col("base")
    if model is not None and model.thresholds:
        free = F.filter("cand", lambda c: ~F.exists("base", lambda b: overlap(b, c["s"])) & model.chosen(c["f"]))
        ranked = F.array_sort(F.transform(free, lambda c: F.struct((-model.score(c["f"])).alias("r"), c["s"]["start"].alias("start"), c["f"]["kind"].alias("kind"), c["s"].alias("s"))))
        df = df.withColumn("new", F.when(F.size("cand") > 0, ranked))
        picked = F.aggregate("new", none(), lambda a, c: F.when(F.exists(a, lambda s: overlap(s, c["s"])), a).otherwise(F.concat(a, F.array(c["s"]))))
        df = df.withColumn("new", F.when(F.size("new") > 0, picked).otherwise(none()))
        spans = F.when(F.size("new") > 0, by_kind(F.concat("base", "new"))).otherwise(F.col("base"))
    return df.select(*[F.col("row")[c].alias(c) for c in kept], F.col("base").alias("base_spans"), spans.alias("spans"))


def by_kind(spans: Column) -> Column:
    return F.transform(F.flatten(F.array(*[F.array_sort(F.transform(of_kind(spans, k), lambda s: F.struct(s["start"].alias("start"), s.alias("s")))) for k in KINDS])), lambda x: x["s"])


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with personal data replaced by <EMAIL>, <IP>, <CARD> or <PHONE>; n_chars, if there is one, follows. Null texts stay null."""
    slim = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("t"), F.col(doc_id).alias("i"))
    found = scan(slim, "t", "i").withColumn("t", redacted(F.col("t"), F.col("spans")))
    new = {text: F.col("t"), "n_chars": F.when(F.size("spans") > 0, F.length("t").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[(new[c] if new.get(c) is not None else F.col("row")[c]).alias(c) for c in docs.columns])
