"""Start places and instruction costs against hand cases and plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F
from sessionlake.operators import places


def test_first_directories(spark):
    rows = [("a", 5, "/x"), ("a", 6, "/y"), ("b", 5, "/x"), ("b", 5, "/y"), ("c", None, "/z"), ("d", None, "/z"), ("d", None, "/q"), ("e", None, "/q"), ("e", 7, "/w"), ("f", 1, None), ("f", 2, "/x")]
    got = {r["session_id"]: (r["cwd"], r["ambiguous"]) for r in places.first_directories(spark.createDataFrame(rows, "session_id string, us long, cwd string")).collect()}
    assert got == {"a": ("/x", False), "b": (None, True), "c": ("/z", False), "d": (None, True), "e": ("/w", False), "f": (None, True)}


def test_places_of_nested_roots_and_worktrees(spark):
    roots = [("/w", "workspace", "/w"), ("/w/lib", "nested", "/w"), ("/w/lib/deep", "nested", "/w"), ("/w-two", "worktree", "/w"), ("/v", "workspace", "/v"), ("/w/inner", "workspace", "/w/inner")]
    cases = {
        "/w": ("/w", "workspace-root", None, "."), "/w/a/b": ("/w", "subfolder", None, "a/b"), "/w/lib": ("/w", "nested-repository", "lib", "lib"), "/w/lib/x": ("/w", "nested-repository", "lib", "lib/x"),
        "/w/lib/deep/y": ("/w", "nested-repository", "lib/deep", "lib/deep/y"), "/w/library": ("/w", "subfolder", None, "library"), "/w-two/z": ("/w", "same-repository-worktree", None, "z"),
        "/w-two": ("/w", "same-repository-worktree", None, "."), "/v/q": ("/v", "subfolder", None, "q"), "/w/inner/i": ("/w/inner", "subfolder", None, "i"),
    }
    kind = "session_id string, agent string, us long, cwd string, evidence string, worker boolean, ambiguous boolean"
    rows = [(f"s{i}", "c", 5, p, "session-header", i % 2 == 0, False) for i, p in enumerate(cases)]
    rows += [("out", "c", 5, "/other", None, False, False), ("none", "c", 5, None, None, False, True), ("kid", "c", 5, "/w", None, True, False), ("late", "c", 99, "/w", None, False, False), ("s0", "c", 9, "/v", None, False, False), ("undated", "c", None, "/w", None, False, False)]
    got = places.start_places(spark.createDataFrame(rows, kind), spark.createDataFrame(roots, "path string, kind string, workspace string")).cache()
    assert {r["cwd"]: (r["workspace"], r["kind"], r["repository"], r["relative"]) for r in got.where("session_id LIKE 's%'").collect()} == cases
    counts = places.start_counts(got, 0, 50)
    assert counts.agg(F.sum("n")).first()[0] == len(cases)
    assert {r["reason"]: r["n"] for r in places.start_coverage(got, 0, 50).collect()} == {"outside_workspace": 1, "missing_or_ambiguous_cwd": 1, "worker_start_unknown": 1, "outside_window": 2}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("---\npaths: src/*\n---\nx", True), ("---\npaths: [a, b]\n---\n", True), ("---\npaths: [ , ]\n---\n", False), ("---\npaths:\n  - a\n---\n", True), ("---\npaths:\n\n# c\n- a\n---\n", True), ("---\npaths:\nother: 1\n---\n", False),
        ("---\npaths: # none\n---\n", False), ("---\n'paths': \"a#b\"\n---\n", True), ("---\npaths: null\n---\n", False), ("---\npaths: |\n  a\n---\n", True), ("---\npaths:\n  - ''\n---\n", False), ("paths: a", False), ("---\nx: 1\n---\npaths: a", False), ("", False),
    ],
)
def test_conditional_rules(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(places.conditional(F.col("t"))).first()[0] is want


def test_imports(spark):
    text = 'See @b.md, (@sub/c.md) and @"my file.md"; mail a@b.md, `@no.md` and ``x @no.md``\n```\n@no.md\n```\n~~~~\n@no.md\n~~~\n@no.md\n~~~~\n@../up.md @/abs.md @~/h.md @http://x @missing.md @./sub/../b.md @../../out.md'
    files = [("r", "d/a.md", text), ("r", "d/b.md", "@a.md"), ("r", "d/sub/c.md", "@../../root.md"), ("r", "d/my file.md", ""), ("r", "up.md", ""), ("r", "root.md", ""), ("r", "d/no.md", ""), ("q", "d/missing.md", ""), ("r", "out.md", "")]
    got = sorted((r["source"], r["target"]) for r in places.imports(spark.createDataFrame(files, "repo string, path string, text string")).collect())
    assert got == [("d/a.md", "d/b.md"), ("d/a.md", "d/my file.md"), ("d/a.md", "d/sub/c.md"), ("d/a.md", "up.md"), ("d/b.md", "d/a.md"), ("d/sub/c.md", "root.md")]


def plain_costs(files, links):
    """(scope, files, characters, tokens, root tokens) of each agent of one repository."""
    names = {"codex": "AGENTS.md", "claude": "CLAUDE.md", "gemini": "GEMINI.md"}
    of = lambda p: p.rsplit("/", 1)[0] if "/" in p else "."
    depends = {p for p, t in files.items() if p.startswith(".claude/rules/") and t.startswith("---\npaths: x")}
    rules = {"claude": {p for p in files if p.startswith(".claude/rules/")} - depends, "cursor": {p for p in files if p.startswith(".cursor/rules/")}, "copilot": {p for p in files if p == ".github/copilot-instructions.md"}}
    out = {}
    for agent in ("codex", "claude", "gemini", "cursor", "copilot"):
        main = {p for p in files if p.rsplit("/", 1)[-1] == names.get(agent)}
        best, root = None, 0
        for scope in sorted({of(p) for p in main} | {"."}):
            above = {scope, "."} | {scope[:i] for i, c in enumerate(scope) if c == "/"}
            read = {p for p in main if of(p) in above} | rules.get(agent, set())
            if agent == "claude":
                size = -1
                while size < len(read):
                    size = len(read)
                    read |= {t for s, t in links if s in read}
                read -= depends
            text = "".join(files[p] for p in read)
            wide = sum("一" <= c <= "鿿" for c in text)
            tokens = math.ceil((len(text) - wide) / 4) + wide
            root = tokens if scope == "." else root
            if read and (best is None or tokens > best[3]):
                best = (scope, len(read), len(text), tokens)
        if best:
            out[agent] = (*best, root)
    return out


def test_costs_of_random_import_graphs(spark):
    rng = random.Random(4)
    rows, links, want = [], [], {}
    for g in range(1000):
        pool = ["CLAUDE.md", "a/CLAUDE.md", "a/b/CLAUDE.md", "c/CLAUDE.md", "AGENTS.md", "a/AGENTS.md", "GEMINI.md", "x.md", "y.md", "a/z.md", ".claude/rules/r.md", ".claude/rules/s.md", ".cursor/rules/k", ".github/copilot-instructions.md"]
        files = {p: ("---\npaths: x\n---\n" if p.endswith("s.md") else "") + rng.choice(["", "ab", "字字", "cde" * 7]) * rng.randrange(1, 9) for p in rng.sample(pool, rng.randrange(1, 12))}
        some = {(rng.choice(list(files)), rng.choice(list(files))) for _ in range(rng.randrange(0, 12))}  # cycles and own ends too
        rows += [(f"g{g}", p, t) for p, t in files.items()]
        links += [(f"g{g}", s, t) for s, t in some]
        want |= {(f"g{g}", a): c for a, c in plain_costs(files, some).items()}
    got = places.instruction_costs(spark.createDataFrame(rows, "repo string, path string, text string"), spark.createDataFrame(links, "repo string, source string, target string")).collect()
    assert {(r["repo"], r["agent"]): (r["scope"], r["files"], r["characters"], r["tokens"], r["root_tokens"]) for r in got} == want
