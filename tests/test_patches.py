"""Edit targets against a plain line by line reading of patches."""

import json
import random

from pyspark.sql import functions as F
from sessionlake.functions import patches

HEADS = {"*** Add File: ": "A", "*** Update File: ": "U", "*** Delete File: ": "D", "*** Move to: ": "M"}


def plain(text):
    """Targets of a patch; [None] where it isn't sound."""
    lines = text.strip().splitlines()
    if len(lines) < 3 or lines[0] != "*** Begin Patch" or lines[-1] != "*** End Patch":
        return [None]
    out, section, empty, moved = [], "", False, False
    for line in [*lines[1:-1], "*** Delete File: end"]:  # the end closes a section as a header does
        kind = next((k for h, k in HEADS.items() if line.startswith(h) and len(line) > len(h)), None)
        if kind == "M":
            if section != "U" or moved or not empty:
                return [None]
            moved = True
        elif kind:
            if section == "U" and empty and not moved:
                return [None]
            section, empty, moved = kind, True, False
        else:
            ends = line == "*** End of File"
            fits = {"A": line.startswith("+"), "U": line[:1] in ("+", "-", " ", "") or line.startswith("@@") or ends}.get(section, False)
            if not fits or (line.startswith("*** ") and not ends):
                return [None]
            empty = empty and line[:1] not in ("+", "-", " ") or line == ""and empty
            continue
        target = line[line.index(": ") + 2 :]
        if target not in out:
            out.append(target)
    out.remove("end") if out[-1] == "end" else None
    return out or [None]


def drawn(rng):
    line = lambda: rng.choice(["+a", "-b", " c", "@@ x", "", "*** End of File", "odd", "*** odd", "+*** Add File: no", "*** Add File: "])
    body = []
    for _ in range(rng.randrange(0, 5)):
        kind = rng.choice(["Add File", "Update File", "Update File", "Delete File"])
        body.append(f"*** {kind}: {rng.choice('fghé')}")
        if kind == "Update File" and rng.random() < 0.4:
            body += [line()] * (rng.random() < 0.2) + [f"*** Move to: {rng.choice('xyz')}"] * rng.choice([1, 1, 1, 2])
        body += [rng.choice(["+a", "+"]) if kind == "Add File" else line() if rng.random() < 0.15 else rng.choice(["+a", "-b", " c", "@@", ""]) for _ in range(rng.randrange(0, 3) if kind != "Delete File" else rng.random() < 0.1)]
    ends = ["*** Begin Patch", *body, "*** End Patch"]
    if rng.random() < 0.1:
        ends.pop(rng.choice([0, -1]))
    return rng.choice(["\n", "\n", "\r\n", " "]).join(ends) + rng.choice(["", "\n", " \n\n"])


def test_patches_equal_a_line_by_line_reading(spark):
    rng = random.Random(11)
    texts = [drawn(rng) for _ in range(3000)] + ["", "x", "*** Begin Patch\n*** End Patch", "*** Begin Patch\n\n*** End Patch"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", patches.patch_targets(F.col("t")).alias("got")).orderBy("i").collect()
    want = [plain(t) for t in texts]
    assert sum(w != [None] for w in want) > 700 and sum(w == [None] for w in want) > 700
    for t, r, w in zip(texts, got, want, strict=True):
        assert r["got"] == w, t


def test_arguments_and_changes(spark):
    patch = "*** Begin Patch\n*** Delete File: a\n*** End Patch"
    arguments = [patch, {"patch": patch, "workdir": "/d"}, {"input": patch, "cwd": "/c"}, {"patch": None, "input": patch}, json.dumps({"input": patch}), json.dumps(patch), 5, None, {"workdir": 3, "cwd": "/c", "patch": patch}]
    v = F.parse_json(F.lit(json.dumps(arguments)))
    rows = spark.range(1).select(F.explode(F.try_variant_get(v, "$", "array<variant>")).alias("a")).select(*[c.alias(n) for n, c in zip("tc", patches.argument_patch(F.col("a")), strict=True)]).collect()
    assert [tuple(r) for r in rows] == [(["a"], None), (["a"], "/d"), (["a"], "/c"), ([None], None), (["a"], None), (["a"], None), ([None], None), ([None], None), (["a"], None)]
    for text, want in (('{"b": {"move_path": "c"}, "a": {}, "d": {"move_path": 4}}', ["a", "b", "c", "d", None]), ("{}", [None]), ("[1]", [None]), ("null", [None])):
        got = spark.range(1).select(patches.change_targets(F.parse_json(F.lit(text)))).first()[0]
        assert got == want
