"""The registered queries of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosstoken, decontam, html, langid, negatives, packing, passages, pii, quality, secrets, simhash, tokencount, warc
from .common import read, shared_dir
from .spans import of_kind, said


def span_counts(kinds: tuple[str, ...]) -> list[Column]:
    return [F.size(of_kind("base_spans", k)).cast("long").alias(f"n_{k}") for k in kinds]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", *span_counts(secrets.KINDS[:3]), F.sha2(said(F.col("base_spans")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.store(read(spark, sf_dir, "pages"), path)
    back = warc.read(spark, path, payload=False).where(F.col("record_type").isin("response", "revisit"))
    return back.select(warc.page_number("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", warc.page_number("refers_to").alias("refers_to"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", *[F.col(f"stats.{k}").alias(k) for k in quality.FIXED], "base_failed", "kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("match.n_words").alias("n_words"), decontam.n_hit().alias("n_hit"), F.size("match.items").cast("long").alias("n_items"), decontam.items_digest().alias("items_sha256"), decontam.contaminated().alias("contaminated"), F.col("match.longest").alias("longest_match"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("lines", tokencount.lines("text"))
    found = tokencount.attribute(docs, F.col("lines"))
    one = found.select("doc_id", F.col("tokens.doc_tokens").alias("doc_tokens"), F.posexplode_outer(F.zip_with("lines", "tokens.counts", lambda s, n: F.struct(s["start"].alias("start"), s["end"].alias("end"), n.alias("n")))).alias("line", "s"))
    return one.select("doc_id", F.col("line").cast("long").alias("line"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.n").alias("n_tokens"), "doc_tokens")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", F.coalesce(~langid.train_rows(found), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", *span_counts(pii.KINDS), F.sha2(said(F.col("base_spans")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crosstoken.align(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("aligned.n_a") > 0, F.sha2("aligned.groups", 256)).otherwise("")
    return found.select("doc_id", *[F.col(f"aligned.{k}").alias(k) for k in ("n_a", "n_b", "n_groups")], F.col("aligned.n_groups").alias("n_links"), "aligned.n_best", "aligned.count_sum", digest.alias("groups_sha256"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = passages.classify(docs, passages.fit(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(~passages.train_rows(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secrets, op2_warc, op3_quality, op4_simhash, op5_packing, op6_decontamination, op7_token_counts, op8_language_id, op9_html_text, op10_pii, op11_hard_negatives, op12_token_alignment, op13_quality_classifier)}
ORACLES: dict[str, str] = {
    "op11_hard_negatives": """
WITH whole AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda x: coalesce(x[1] * x[2], 0))), 0)::BIGINT AS score
  FROM whole a JOIN whole b ON a.id % 100 = 0 AND a.id <> b.id
),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER best)::INTEGER AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
WINDOW best AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER best <= 5
""",
}
