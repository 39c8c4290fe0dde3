import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
import pytest

from test_decontam import brute as brute_hits
from test_packing import check
from test_pii import brute as brute_pii
from test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output, as the pipeline chains them."""
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        out[name] = (before, docs)
    return out


def by_id(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "packing"]
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "packing")


def test_language_stage_drops_texts_without_a_language(spark, stages):
    before, after = map(by_id, stages["language_id"])
    assert set(before) - set(after) == {d for d, t in before.items() if not any(c.isalpha() for c in t or "")}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(7)
    odd = [(-1 - i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz      ", k=400)), None, "src0", 400) for i in range(5)]
    mixed = docs.union(spark.createDataFrame(odd, docs.schema))
    assert set(by_id(corpus_pipeline.language_id(spark, mixed, SF))) == set(after)


def test_dedup_stage_keeps_one_of_each_group(stages):
    before, after = map(by_id, stages["near_dedup"])
    groups = brute_components(sorted((d, brute_fp(t)) for d, t in before.items()))
    assert set(after) == set(groups.values()) and all(after[d] == before[d] for d in after)


def test_decontamination_stage_drops_the_contaminated(spark, stages):
    before, after = map(by_id, stages["decontamination"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == {r[0] for r in brute_hits(before.items(), items) if not r[5]}


def test_pii_stage_redacts_all_and_nothing_else(stages):
    before, after = map(by_id, stages["pii"])
    assert set(before) == set(after)
    for d, t in before.items():
        if not brute_pii(t):
            assert after[d] == t
        else:
            assert not [s for s in brute_pii(after[d]) if s[0] != "ip"] and after[d] != t
    assert all(r["n_chars"] == len(r["text"]) for r in stages["pii"][1].collect() if brute_pii(before[r["doc_id"]]))


def test_packing_stage_is_a_packing(stages):
    check(stages["packing"][1].collect(), by_id(stages["packing"][0]))


def test_stages_take_odd_and_empty_tables(spark, docs):
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
            rows.count()
