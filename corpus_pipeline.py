"""The training-data pipeline: documents -> language ID -> near-dedup -> decontamination -> PII -> packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; ``run`` writes each
result as Parquet to the shared folder and reads it again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sessionlake.llm import decontam, langid, packing, pii, simhash
from sessionlake.llm.common import read, shared_dir

#: A prediction under this score is none: texts that are too unlike their likeliest language.
LEAST_SCORE = 0.5
#: Not SQL: code lengths, fingerprints and packing have no such form. tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a language: a letter, and a score of LEAST_SCORE or more."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = langid.identify(rows, langid.fit(docs))
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't contaminated by the benchmark."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids, in sequences."""
    return packing.pack(docs, id_bytes=2)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", redaction), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
