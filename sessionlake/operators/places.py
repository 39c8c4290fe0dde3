"""Where sessions start (M38), and what instructions cost there (M39), over tables of many repositories.

Paths are in normal form (paths.normalize_path). Files of instructions are in tables: repo, path (in the repository, with slashes), text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import durable

# ---- fixed values: names of instruction files, and the form of an import and of conditional front matter ----
MAIN_FILES = {"AGENTS.md": "codex", "CLAUDE.md": "claude", "GEMINI.md": "gemini"}
RULES, COPILOT, CURSOR = ".claude/rules/", ".github/copilot-instructions.md", ".cursor/rules/"
IMPORT = r'(?<![\w@])@(?:"([^"\n]+)"|([^\s`<>]+))'
NO_PATHS = ("", "[]", "{}", "null", "Null", "NULL", "~", "''", '""')
# ---- end of fixed values ----


# ---------------------------------------------------------------- M38


def ancestors(path: Column) -> Column:
    """The path and all folders above it, up to the root, which is empty."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def first_directories(contexts: DataFrame) -> DataFrame:
    """session_id, cwd, ``ambiguous``: the directory of each session's first dated context, of all of them if none is dated; ambiguous if there are several, or none.

    contexts: session_id, us (null: undated), cwd.
    """
    each = contexts.groupBy("session_id").agg(F.min("us").alias("first"))
    at_first = contexts.join(each, "session_id").where(F.col("us").eqNullSafe(F.col("first")))
    found = at_first.groupBy("session_id").agg(F.min("cwd").alias("cwd"), (F.count_distinct("cwd") != 1).alias("ambiguous"))
    return found.select("session_id", F.when(~F.col("ambiguous"), F.col("cwd")).alias("cwd"), "ambiguous")


def start_places(starts: DataFrame, roots: DataFrame) -> DataFrame:
    """M38. Each start with its place: workspace, kind, repository, relative, and ``problem`` (null: it has a place).

    starts: session_id, agent, us, cwd, evidence (session-header, first-observed-cwd, or null), worker, ambiguous. roots: path, kind (workspace, nested or worktree), workspace (the
    path of the workspace that a nested repository lies in or that a worktree is another checkout of).

    A start belongs to the deepest root at or above its directory: directories are exploded into their ancestors and joined to roots by equality. A session that is
    there twice is counted once, by its first row.
    """
    one = Window.partitionBy("agent", "session_id").orderBy(F.col("us").asc_nulls_last(), F.col("cwd"))
    rows = starts.withColumn("n_", F.row_number().over(one)).where("n_ = 1").drop("n_")
    up = rows.where("cwd IS NOT NULL").select("cwd").distinct().select("cwd", F.explode(ancestors(F.col("cwd"))).alias("above"))
    hit = up.join(roots.select(F.col("path").alias("above"), "kind", "workspace"), "above")
    best = hit.groupBy("cwd").agg(F.max_by(F.struct("above", "kind", "workspace"), F.length("above")).alias("r"))  # directories, not sessions: a busy one is a row
    placed = rows.join(best, "cwd", "left")
    inside = F.substr("cwd", F.length("r.above") + 2)
    kind = F.when(F.col("r.kind") == "worktree", "same-repository-worktree").when(F.col("r.kind") == "nested", "nested-repository").when(inside == "", "workspace-root").otherwise("subfolder")
    unknown_worker = F.col("worker") & (~F.coalesce(F.col("evidence").isin("session-header", "first-observed-cwd"), F.lit(False)) | F.col("cwd").isNull())
    nested = F.when(F.col("r.kind") == "nested", F.substr("r.above", F.length("r.workspace") + 2))
    relative = F.when(nested.isNull(), inside).when(inside == "", nested).otherwise(F.concat(nested, F.lit("/"), inside))
    problem = (
        F.when(F.col("ambiguous") | F.col("cwd").isNull(), "missing_or_ambiguous_cwd")
        .when(F.col("r").isNull(), "outside_workspace")
        .when(unknown_worker, "worker_start_unknown")
    )
    keep = lambda c, n: F.when(problem.isNull(), c).alias(n)
    return placed.select(*starts.columns, F.col("r.workspace").alias("workspace"), keep(kind, "kind"), keep(nested, "repository"), keep(F.when(relative == "", ".").otherwise(relative), "relative"), problem.alias("problem"))


def start_counts(places: DataFrame, since: int, until: int) -> DataFrame:
    """M38. Starts in the window by workspace, agent, place, role and evidence."""
    seen = places.where((F.col("us") >= since) & (F.col("us") < until) & F.col("problem").isNull())
    role = F.when(F.col("worker"), "worker").otherwise("top-level")
    return seen.groupBy("workspace", "agent", "kind", "repository", "relative", role.alias("role"), F.coalesce("evidence", F.lit("first-observed-cwd")).alias("evidence")).agg(F.count("*").alias("n"))


def start_coverage(places: DataFrame, since: int, until: int) -> DataFrame:
    """M38. Starts without a place, by reason; those outside the window are one."""
    inside = F.coalesce((F.col("us") >= since) & (F.col("us") < until), F.lit(False))
    return places.withColumn("reason", F.when(~inside, "outside_window").otherwise(F.col("problem"))).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- M39


def folder(path: Column) -> Column:
    """The folder of a path in a repository; the root is a dot."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def conditional(text: Column) -> Column:
    """Whether a rule's front matter names paths that it is for: a scalar, a list in brackets, or lines of a block."""
    front = F.regexp_extract(text, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    uncommented = F.transform(F.split(front, "\n"), lambda x: F.rtrim(F.regexp_replace(F.concat(F.lit(" "), x), r"\s+#.*$", "")))
    lines = F.transform(uncommented, lambda x: F.substr(x, F.lit(2)))

    def value(x: Column) -> Column:
        return F.trim(F.regexp_replace(x, r"""^(?:paths|'paths'|"paths"):""", ""))

    def says(x: Column, i: Column) -> Column:
        v = value(x)
        empty = v.isin(*NO_PATHS) | v.rlike(r"""^\[[ \t,"']*\]$""")
        block = (v == "") | v.rlike(r"^[|>][-+]?$")
        after = F.slice(lines, i + 2, F.size(lines))
        # The lines of a block are those before the next that isn't indented and isn't blank.
        stop = F.array_min(F.transform(after, lambda y, j: F.when((y != "") & ~y.rlike(r"^[ \t-]"), j)))
        own = F.slice(after, F.lit(1), F.coalesce(stop, F.size(after)))
        item = F.exists(own, lambda y: ~F.trim(F.regexp_replace(F.trim(y), "^-", "")).isin(*NO_PATHS))
        return x.rlike(r"""^(?:paths|'paths'|"paths"):""") & F.when(block, item).otherwise(~empty)

    return F.coalesce(F.exists(F.transform(lines, says), lambda x: x), F.lit(False))


def code_free(text: Column) -> Column:
    """The text without fenced blocks and code between backticks."""
    fenced = F.regexp_replace(text, r"(?ms)^ {0,3}(`{3,}|~{3,})[^\n]*$.*?(?:^ {0,3}\1[`~]*[ \t]*$|\z)", "\n")
    return F.regexp_replace(fenced, r"(?s)(?<!`)(`+)(?!`).*?(?<!`)\1(?!`)", "")


def imports(files: DataFrame) -> DataFrame:
    """repo, source, target: files that a file's text names by @path, from its own folder; none outside the repository, none that isn't there."""
    text = code_free(F.col("text"))
    both = [F.regexp_extract_all(text, F.lit(IMPORT), F.lit(k)) for k in (1, 2)]
    named = F.zip_with(*both, lambda a, b: F.rtrim(F.when(a != "", a).otherwise(b), F.lit(",;)")))
    rows = files.select("repo", F.col("path").alias("source"), F.explode(named).alias("name"))
    local = rows.where(~F.col("name").rlike(r"^[/~]|[\\:]"))
    parts = F.filter(F.split(F.when(folder(F.col("source")) == ".", F.col("name")).otherwise(F.concat(folder(F.col("source")), F.lit("/"), F.col("name"))), "/"), lambda x: (x != "") & (x != "."))

    def step(a: Column, part: Column) -> Column:
        up = part == ".."
        out = F.when(~up, F.array_append(a["parts"], part)).otherwise(F.slice(a["parts"], F.lit(1), F.greatest(F.size(a["parts"]) - 1, F.lit(0))))
        return F.struct(out.alias("parts"), (a["out"] | (up & (F.size(a["parts"]) == 0))).alias("out"))

    end = F.aggregate(parts, F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out")), step)
    found = local.withColumn("e", end).where("NOT e.out").select("repo", "source", F.array_join("e.parts", "/").alias("target")).distinct()
    return found.join(files.select("repo", F.col("path").alias("target")).distinct(), ["repo", "target"], "left_semi").select("repo", "source", "target")


def estimated(files: DataFrame) -> DataFrame:
    """files with ``characters``, and ``narrow`` and ``wide`` ones of the token estimate (P9), whose sums over files round up once."""
    t = F.regexp_replace("text", "\r\n?", "\n")
    narrow = F.length(F.regexp_replace(t, r"[\p{IsHangul}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]", ""))
    return files.withColumns({"characters": F.length("text").cast("long"), "narrow": narrow.cast("long"), "wide": (F.length(t) - narrow).cast("long")})


def inherited_files(files: DataFrame, links: DataFrame) -> DataFrame:
    """repo, agent, scope, path: the files that an agent reads in each folder that has instructions of its own, and in the root.

    These are the agent's files in the folder and above it, its rules, and, for the agent that imports, what these import, however far and in cycles; conditional rules are left
    out at the end. files: repo, path, text; links: repo, source, target.
    """
    name = F.element_at(F.split("path", "/"), -1)
    agent = F.coalesce(*[F.when(name == n, a) for n, a in MAIN_FILES.items()])
    main = files.select("repo", agent.alias("agent"), "path", folder(F.col("path")).alias("folder")).where("agent IS NOT NULL")
    rule = F.col("path").startswith(RULES) & F.col("path").endswith(".md")
    depends = files.where(rule & conditional(F.col("text"))).select("repo", "path").withColumn("agent", F.lit("claude"))
    general = F.when(rule, "claude").when(F.col("path") == COPILOT, "copilot").when(F.col("path").startswith(CURSOR), "cursor")
    rules = files.select("repo", general.alias("agent"), "path").where("agent IS NOT NULL").join(depends, ["repo", "agent", "path"], "left_anti")
    agents = files.select("repo").distinct().select("repo", F.explode(F.array(*[F.lit(a) for a in ("codex", "claude", "gemini", "copilot", "cursor")])).alias("agent"))
    scopes = main.select("repo", "agent", F.col("folder").alias("scope")).union(agents.withColumn("scope", F.lit("."))).distinct()
    up = F.when(F.col("scope") == ".", F.array(F.lit("."))).otherwise(F.concat(F.filter(ancestors(F.col("scope")), lambda x: x != ""), F.array(F.lit("."))))
    above = scopes.select("repo", "agent", "scope", F.explode(up).alias("folder")).join(main, ["repo", "agent", "folder"]).select("repo", "agent", "scope", "path")
    reached = fresh = durable(above.union(scopes.join(rules, ["repo", "agent"]).select("repo", "agent", "scope", "path")).distinct())
    edges = links.select("repo", F.col("source").alias("path"), "target")
    while True:  # rounds follow the depth of the imports; settled files aren't followed again
        more = fresh.where("agent = 'claude'").join(edges, ["repo", "path"]).select("repo", "agent", "scope", F.col("target").alias("path")).distinct()
        fresh = durable(more.join(reached, ["repo", "agent", "scope", "path"], "left_anti"))
        if fresh.isEmpty():
            break
        reached = reached.union(fresh)
    return reached.join(depends, ["repo", "agent", "path"], "left_anti").select("repo", "agent", "scope", "path")


def instruction_costs(files: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """M39. By repository and agent: scope, files, characters and estimated tokens of the folder that costs most (the first by name of equal ones), and the root's tokens."""
    links = imports(files) if links is None else links
    sized = estimated(files).select("repo", "path", "characters", "narrow", "wide")
    read = inherited_files(files, links).join(sized, ["repo", "path"])
    total = read.groupBy("repo", "agent", "scope").agg(F.count("*").alias("files"), F.sum("characters").alias("characters"), (F.ceil(F.sum("narrow") / 4) + F.sum("wide")).cast("long").alias("tokens"))
    # The most tokens, then the first scope by name.
    least = F.min_by(F.struct("scope", "files", "characters", "tokens"), F.struct(-F.col("tokens"), F.col("scope"))).alias("m")
    out = total.groupBy("repo", "agent").agg(least, F.coalesce(F.max(F.when(F.col("scope") == ".", F.col("tokens"))), F.lit(0)).alias("root_tokens"))
    return out.select("repo", "agent", "m.*", "root_tokens")
