"""What local checks say of workers' sessions (J18 with its evidence rules, J20)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .outcomes import local_state


def unit_states(edits: DataFrame, checks: DataFrame, activity: DataFrame, since: int, until: int, active_minutes: int = 5) -> DataFrame:
    """J18. (session_id, state, reason) in the scan ``since`` to ``until``.

    As local_state, and: a check's start outside the scan is none; a session with evidence gaps is unverified, whatever else it shows; one without a known edit has no change only if no edit
    lacks its instant and, in the open format, there is no gap at all.

    edits: session_id, us. checks: session_id, us, start_us, exit_code, here. activity: session_id, last_us, completed_us, gaps and edit_gaps (numbers of records without evidence, of edits among them), open_format.
    """
    inside = lambda c: (F.col(c) >= since) & (F.col(c) < until)
    known = checks.withColumn("start_us", F.when(inside("start_us"), F.col("start_us")))
    found = local_state(edits.where(inside("us")), known.where(inside("us")), activity, until, active_minutes)
    rows = found.join(activity.select("session_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("edit_gaps", F.lit(0)).alias("edit_gaps"), F.coalesce("open_format", F.lit(False)).alias("open_format")), "session_id")
    unchanged = (F.col("reason") == "no_known_edit") & (F.col("edit_gaps") == 0) & (~F.col("open_format") | (F.col("gaps") == 0))
    void = ~unchanged & ((F.col("gaps") > 0) | (F.col("edit_gaps") > 0))
    return rows.select("session_id", F.when(void, "unverified").otherwise(F.col("state")).alias("state"), F.when(void, "incomplete_edit_or_command_timestamps").otherwise(F.col("reason")).alias("reason"))


@dataclass
class LocalDelivery:
    """``units``: the workers' sessions that started in the window, with state, reason and tokens; ``overhead``: tokens of the sessions that dispatch them; ``excluded``: other sessions by reason;
    ``verifier``: exit codes of matching checks by arm; ``states``: units by agent and state, with their tokens (null: some are unknown)."""

    units: DataFrame
    overhead: DataFrame
    excluded: DataFrame
    verifier: DataFrame
    states: DataFrame


def local_delivery(sessions: DataFrame, states: DataFrame, tokens: DataFrame, checks: DataFrame, since: int, until: int, arms: Sequence[tuple[str, int, int]] = ()) -> LocalDelivery:
    """J20. The parts of a report on a repository; units are chosen by what is known of their start alone, before any outcome is looked at.

    sessions: session_id, agent, start_us, scope (project, other or unassigned; null: no directory known), worker, in_scan (whether it was active in the scan). states: of unit_states. tokens: session_id, tokens
    (null: not all known). checks: session_id, us, exit_code, of commands that are the repository's. arms: (name, since, until) of verification windows; the window itself if there are none.

    The gate's health concerns all sessions of the repository: also those without a change, and those that only dispatch.
    """
    unknown = F.col("start_us").isNull() | F.col("scope").isNull()
    own = sessions.where(~unknown & (F.col("scope") == "project"))
    reason = F.when(unknown, "missing_start_metadata").when(F.col("scope") != "project", F.col("scope"))
    excluded = sessions.where("in_scan").withColumn("reason", reason).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    windows = list(arms) or [("all", since, until)]
    arm = F.explode(F.array_compact(F.array(*[F.when((F.col("us") >= a) & (F.col("us") < b), F.lit(name)) for name, a, b in windows])))
    verifier = checks.join(own, "session_id", "left_semi").where("exit_code IS NOT NULL").select(arm.alias("arm"), "exit_code").groupBy("arm", "exit_code").agg(F.count("*").alias("n"))
    overhead = own.where("NOT worker AND in_scan").join(tokens, "session_id", "left").select("session_id", "agent", "tokens")
    units = own.where(F.col("worker") & (F.col("start_us") >= since) & (F.col("start_us") < until)).join(states, "session_id", "left").join(tokens, "session_id", "left").select("session_id", "agent", "start_us", F.coalesce("state", F.lit("no_change")).alias("state"), F.coalesce("reason", F.lit("no_known_edit")).alias("reason"), "tokens")
    total = F.when(F.count("tokens") == F.count("*"), F.sum("tokens"))
    return LocalDelivery(units, overhead, excluded, verifier, units.groupBy("agent", "state").agg(F.count("*").alias("n"), total.alias("tokens")))
