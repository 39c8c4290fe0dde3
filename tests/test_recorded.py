"""Recorded outcomes: tables, contradictions as rows, and what they give to the checks' operators."""

import copy
import json

import pytest
from pyspark.sql import functions as F
from sessionlake.operators import outcomes
from sessionlake.sources import recorded

HEAD, MERGE = "a" * 40, "B" * 40


def day(n):
    return f"2030-01-{n:02d}T00:00:00Z"


def pull(number, **more):
    merged = {"number": number, "state": "closed", "merged": True, "created_at": day(2), "closed_at": day(4), "merged_at": day(4), "head": {"sha": HEAD, "ref": "b"}, "merge_commit_sha": MERGE, "title": "t", "body": None}
    return {"response": merged | more, "checks_at_merge": None}


def run(name, conclusion="success", **more):
    return {"name": name, "head_sha": HEAD, "started_at": day(3), "completed_at": day(3), "status": "completed", "conclusion": conclusion} | more


def document(repo, *pulls, commits=(), **more):
    return {"repository": repo, "coverage_start": day(1), "observed_at": day(20), "pulls_complete": True, "commits_complete": True, "pulls": list(pulls), "commits": list(commits)} | more


def commit(sha, n, message="m"):
    return {"sha": sha * 40, "commit": {"message": message, "committer": {"date": day(n)}}}


def load(spark, path, *docs):
    path.mkdir(exist_ok=True)
    for i, d in enumerate(docs):
        (path / f"{i}.json").write_text(d if isinstance(d, str) else json.dumps(d))
    return recorded.recorded(spark, str(path))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_tables_of_a_sound_document_feed_the_verdict(spark, tmp_path):
    one = pull(1)
    one["checks_at_merge"] = {"head_sha": HEAD, "captured_at": day(4), "required": ["x", "y"], "check_runs": [run("x", "failure", completed_at="2030-01-02T00:00:00Z"), run("x", id=1, app={"id": 7}), run("z", "failure")], "statuses": [{"context": "y", "sha": HEAD, "updated_at": day(3), "state": "success"}]}
    two = pull(2)
    two["checks_at_merge"] = {"head_sha": HEAD, "captured_at": day(4), "required": None, "check_runs": [run("x", None, status="queued", completed_at=None)], "statuses": []}
    open_ = pull(3, state="open", merged=False, closed_at=None, merged_at=None, merge_commit_sha=None)
    r = load(spark, tmp_path / "d", document("Own/Repo", one, two, open_, commits=[commit("c", 5), commit("d", 25)]))
    assert rows(r.observations, "repo", "pulls_complete", "commits_complete") == [("own/repo", True, True)]
    assert rows(r.pulls, "pr", "open", "merge_sha", "has_snapshot", "body") == [("own/repo#1", False, "b" * 40, True, ""), ("own/repo#2", False, "b" * 40, True, ""), ("own/repo#3", True, None, False, "")]
    assert rows(r.runs, "pr", "name", "app_id", "complete", "ok") == [("own/repo#1", "x", 7, True, True), ("own/repo#1", "x", None, True, False), ("own/repo#1", "z", None, True, False), ("own/repo#2", "x", None, False, False)]
    assert rows(r.required, "pr", "names") == [("own/repo#1", ["x", "y"]), ("own/repo#2", None)]
    assert rows(r.commits, "sha") == [("c" * 40,)] and rows(r.violations, "reason", "structural") == [("commit_outside_coverage", False)]
    valid = lambda t: outcomes.at_merge(t, r.pulls).where("gap IS NULL")
    assert rows(outcomes.checks_verdict(valid(r.runs), valid(r.statuses), r.required), "pr", "verdict") == [("own/repo#1", "green"), ("own/repo#2", "unknown")]


@pytest.mark.parametrize(
    "change",
    [
        {"merged": False}, {"merged_at": None}, {"merge_commit_sha": None}, {"state": "open"}, {"closed_at": None}, {"created_at": day(21)}, {"closed_at": day(3)}, {"created_at": day(5)}, {"closed_at": day(25), "merged_at": day(25)},
    ],
)
def test_contradictory_instants_void_completeness(spark, tmp_path, change):
    r = load(spark, tmp_path / "d", document("o/r", pull(1, **change), pull(2)), document("o/other", pull(1)))
    assert rows(r.pulls, "pr") == [("o/other#1",), ("o/r#2",)]
    assert rows(r.violations, "repo", "pr", "reason", "structural") == [("o/r", "o/r#1", "pr_evidence_inconsistent", False)]
    assert rows(r.observations, "repo", "pulls_complete", "commits_complete") == [("o/other", True, True), ("o/r", False, True)]


def test_malformed_documents_and_rows_are_said(spark, tmp_path):
    snapshot = {"head_sha": HEAD, "captured_at": day(4), "required": [], "check_runs": [], "statuses": []}

    def snapped(number, **more):
        return pull(number) | {"checks_at_merge": snapshot | more}

    bad = [
        pull(0), pull("1"), pull(5), pull(5), pull(6, created_at="soon"), pull(7, head={"sha": "x"}), pull(8, title=None), pull(9) | {"more": 1}, {"response": {}}, 4, pull(10) | {"observed_checks_at_merge": "blue"},
        snapped(11, required=["a", "a"]), snapped(12, check_runs=[run("x", "odd")]), snapped(13, statuses=[{"context": "", "sha": HEAD, "updated_at": day(3), "state": "success"}]), snapped(14, captured_at=None), snapped(15, extra=1), snapped(16, check_runs=[run("x", id=1), run("y", id=1)]),
    ]
    docs = [document("o/r", *bad, commits=[commit("c", 5), commit("c", 6), commit("d", 5, None)]), document("o/twice"), document("O/Twice"), document("no-slash"), document("o/late", coverage_start=day(20)), document("o/flag", pulls_complete=1), document("o/list", pulls={}), document("o/more", more=1), "{broken", "[]"]
    r = load(spark, tmp_path / "d", *copy.deepcopy(docs))
    got = sorted(x["reason"] for x in r.violations.collect())
    assert got == sorted(
        ["number_state_or_merged"] * 2 + ["duplicate_pull"] * 2 + ["instants", "sha", "texts", "entry_fields", "entry_fields", "entry_fields", "observed_label", "required_names", "check_runs", "statuses", "snapshot_head_or_instant", "snapshot_fields", "check_runs"]
        + ["duplicate_commit"] * 2 + ["commit"] + ["duplicate_repository"] * 2 + ["repository", "coverage", "completeness", "arrays", "fields", "unreadable", "unreadable"]
    )
    assert rows(r.observations, "repo", "pulls_complete", "commits_complete") == [("o/r", False, False)]
    assert {x["pr"] for x in r.pulls.collect()} == {f"o/r#{i}" for i in range(11, 17)} and r.runs.count() == 0 and r.commits.count() == 0


def test_no_documents(spark, tmp_path):
    r = load(spark, tmp_path / "d", document("o/r"))
    assert r.pulls.count() == r.runs.count() == r.violations.count() == 0 and r.observations.select(F.col("until_us") > F.col("start_us")).first()[0]
