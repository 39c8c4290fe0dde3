"""Queries of start places and instruction costs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import places
from .bridge import SINCE, UNTIL
from .registry import Views, query

ROOTS = (("/r0", "workspace", "/r0"), ("/r0/s0", "nested", "/r0"), ("/r1", "worktree", "/r0"), ("/r2", "workspace", "/r2"))
NARROW = "length(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\p{Hangul}\\p{Han}\\p{Hiragana}\\p{Katakana}]', '', 'g'))"


@query("""
WITH f AS (SELECT session_id, min(us) AS us FROM contexts GROUP BY 1),
d AS (SELECT f.session_id, f.us, count(DISTINCT cwd) AS n, min(cwd) AS cwd, min(c.agent) AS agent FROM f JOIN contexts c ON c.session_id = f.session_id AND c.us = f.us GROUP BY 1, 2),
s AS (SELECT d.*, CASE WHEN s.parent_id IS NOT NULL THEN 'worker' ELSE 'top-level' END AS role FROM d JOIN sessions s USING (session_id) WHERE n = 1 AND us >= $SINCE AND us < $UNTIL),
p AS (SELECT *, CASE WHEN cwd LIKE '/r2%' THEN '/r2' WHEN cwd LIKE '/r0%' OR cwd LIKE '/r1%' THEN '/r0' END AS workspace,
 CASE WHEN cwd LIKE '/r1%' THEN 'same-repository-worktree' WHEN cwd LIKE '/r0/s0%' THEN 'nested-repository' ELSE 'subfolder' END AS kind, CASE WHEN cwd LIKE '/r0/s0%' THEN 's0' END AS repository,
 substr(cwd, 5) AS relative FROM s)
SELECT workspace, agent, kind, repository, relative, role, 'first-observed-cwd' AS evidence, count(*) AS n FROM p WHERE workspace IS NOT NULL GROUP BY ALL""")
def start_counts(v: Views) -> DataFrame:
    first = places.first_directories(v.contexts).join(v.contexts.groupBy("session_id").agg(F.min("us").alias("us")), "session_id")
    starts = first.join(v.sessions, "session_id").select("session_id", "agent", "us", "cwd", F.lit("first-observed-cwd").alias("evidence"), F.col("parent_id").isNotNull().alias("worker"), "ambiguous")
    roots = v.spark.createDataFrame(ROOTS, "path string, kind string, workspace string")
    return places.start_counts(places.start_places(starts, roots), SINCE, UNTIL)


@query("""
WITH d AS (SELECT source AS repo, doc_id, lang = 'en' AS en, length(text) AS characters, $NARROW AS narrow, length(replace(text, chr(13) || chr(10), chr(10))) AS total,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, 'd' || CAST(doc_id % 10 AS VARCHAR) || '/x' || CAST(doc_id AS VARCHAR) AS folder FROM documents WHERE text IS NOT NULL),
scopes AS (SELECT repo, 'claude' AS agent, folder AS scope, n FROM d WHERE en AND n > 1 UNION ALL SELECT repo, 'codex', folder, n FROM d WHERE NOT en AND n > 1 UNION ALL SELECT repo, 'claude', '.', 1 FROM d WHERE n = 1),
files AS (SELECT s.repo, agent, scope, count(*) AS files, sum(characters)::BIGINT AS characters, (ceil(sum(narrow) / 4) + sum(total - narrow))::BIGINT AS tokens FROM scopes s JOIN d ON d.repo = s.repo AND (d.n = s.n OR (agent = 'claude' AND d.n <= 3)) GROUP BY ALL),
root AS (SELECT repo, agent, max(CASE WHEN scope = '.' THEN tokens ELSE 0 END) AS root_tokens FROM files GROUP BY ALL)
SELECT f.repo, f.agent, scope, files, characters, tokens, root_tokens FROM files f JOIN root USING (repo, agent) QUALIFY row_number() OVER (PARTITION BY f.repo, f.agent ORDER BY tokens DESC, scope) = 1""", NARROW=NARROW)  # fmt: skip
def instruction_costs(v: Views) -> DataFrame:
    """A document is a file, a source a repository: its first one lies in the root and imports the second, which imports the third."""
    d = v.table("documents").where("text IS NOT NULL").selectExpr("source AS repo", "doc_id", "lang", "text", "row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n")
    folder = F.concat(F.lit("d"), (F.col("doc_id") % 10).cast("string"), F.lit("/x"), F.col("doc_id").cast("string"))
    path = F.when(F.col("n") == 1, "CLAUDE.md").otherwise(F.concat(folder, F.when(F.col("lang") == "en", "/CLAUDE.md").otherwise("/AGENTS.md")))
    files = d.withColumn("path", path).select("repo", "path", "text", "n")
    few = files.where("n <= 3").select("repo", "path", "n")
    links = few.select("repo", F.col("path").alias("source"), (F.col("n") + 1).alias("n")).join(few.select("repo", F.col("path").alias("target"), "n"), ["repo", "n"]).select("repo", "source", "target")
    return places.instruction_costs(files.drop("n"), links)
