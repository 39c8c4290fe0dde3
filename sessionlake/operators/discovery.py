"""Repositories that workers are found to have changed, and how far they are to be followed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import durable


def owner(repo: Column) -> Column:
    return F.substring_index(repo, "/", 1)


def first_claims(sessions: DataFrame, authored: DataFrame, ancestors: DataFrame, touched: DataFrame, owners: Sequence[str]) -> DataFrame:
    """session_id, repo, us, until_us: a session's claim to a repository of the owners. It counts for lifetimes that end after ``us``, and not after ``until_us`` (null: no bound).

    sessions: session_id, start_us. authored: session_id, us, repo (null: an event that names none). ancestors: session_id, ancestor. touched: session_id, repo.
    A session claims what it has authored since its start; as long as it has authored nothing, what its ancestors have since then, of the repositories that it has touched.
    """
    own = authored.join(sessions, "session_id").where(F.col("us") >= F.col("start_us"))
    named = own.where("repo IS NOT NULL").groupBy("session_id", "repo").agg(F.min("us").alias("us"))
    first = own.groupBy("session_id").agg(F.min("us").alias("until_us"))
    theirs = authored.where("repo IS NOT NULL").select(F.col("session_id").alias("ancestor"), "us", "repo")
    inherited = ancestors.join(sessions, "session_id").join(theirs, "ancestor").where(F.col("us") >= F.col("start_us"))
    inherited = inherited.join(touched, ["session_id", "repo"], "left_semi").groupBy("session_id", "repo").agg(F.min("us").alias("us"))
    both = named.withColumn("until_us", F.lit(None).cast("bigint")).unionByName(inherited.join(first, "session_id", "left"))
    return both.where(owner(F.col("repo")).isin(*owners) & (F.col("until_us").isNull() | (F.col("us") < F.col("until_us"))))


def discovered(claims: DataFrame, observations: DataFrame, repos: DataFrame, until: int) -> tuple[DataFrame, int]:
    """J28. (repo of all that are to be measured, end of the lifetimes): the fixpoint of two that feed each other.

    The repositories that are claimed within the lifetimes join those of ``repos``; lifetimes last to the latest observation of any of them (observations: repo, until_us), and at least to
    ``until``. Rounds are as many as ends that are met, each over the claims, which are a row per session and repository.
    """
    claims, seen = durable(claims), durable(observations.groupBy("repo").agg(F.max("until_us").alias("until_us")))
    measured, end = durable(repos.select("repo").distinct()), until
    while True:
        found = claims.where((F.col("us") < end) & (F.col("until_us").isNull() | (F.col("until_us") >= end))).select("repo")
        measured = durable(measured.union(found).distinct())
        later = measured.join(seen, "repo").agg(F.max("until_us")).first()[0]
        if later is None or later <= end:
            return measured, end
        end = later
