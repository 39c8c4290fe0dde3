"""Executions of commands from their launches and ends, in three modes (F8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import execution_cwd

#: What a row of the input has besides session_id, id, us and ord.
FIELDS = ("phase", "pairing", "command", "exit_code", "at_us", "cwd", "cwd_given", "deferred", "require_pair", "error")


def executions(events: DataFrame) -> DataFrame:
    """F8. The last execution of each session and id: end_us, command, exit_code, start_us, cwd, error, and ``pending`` (whether its directory is still to be found from contexts).

    events: session_id, id, us, ord (arrival) and FIELDS, as vendor's ``command`` events have them; a null cwd_given is true, another null flag false. An end takes the last launch of its id that has arrived:

    * explicit (pairing is null): what the end states itself, whether or not there is a launch;
    * launch: the launch's start and directory, and its command if the end states none or needs a launch; an end that needs one and has none is left out; a deferred launch leaves the exit code unknown;
    * interval: both may state a start and a directory. If the starts differ, or the launch states none, start and directory are unknown; if the directories differ, the directory is.

    Errors of a deferred launch or end are unknown. Ends without an instant make no row. One window per session and id; no join.
    """
    w = Window.partitionBy("session_id", "id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = events.select("session_id", "id", "us", "ord", *FIELDS).withColumns({"cwd_given": F.coalesce("cwd_given", F.lit(True)), "deferred": yes("deferred"), "require_pair": yes("require_pair")})
    started = F.struct("at_us", "cwd", "cwd_given", "command", "deferred")
    rows = rows.withColumn("launch", F.last(F.when(F.col("phase") == "start", started), ignorenulls=True).over(w)).where("phase <> 'start'")
    own, launch, found = F.col("at_us"), F.col("launch"), F.col("launch").isNotNull()
    of_launch = lambda c: launch[c]
    by_launch, by_interval = F.col("pairing") == "launch", F.col("pairing") == "interval"
    explicit_cwd = F.coalesce(of_launch("cwd_given"), F.lit(False))
    start_conflict = found & (of_launch("at_us").isNull() | F.coalesce(own != of_launch("at_us"), F.lit(False)))
    cwd_conflict = explicit_cwd & F.col("cwd_given") & ~execution_cwd(of_launch("cwd")).eqNullSafe(execution_cwd(F.col("cwd")))
    paired_cwd = explicit_cwd & of_launch("at_us").isNotNull() & ~start_conflict
    interval_cwd = F.when(~start_conflict & ~cwd_conflict, F.when(F.col("cwd_given"), F.col("cwd")).when(paired_cwd, of_launch("cwd")))

    def chosen(launched: Column, interval: Column, explicit: Column) -> Column:
        return F.when(by_launch, launched).when(by_interval, interval).otherwise(explicit)

    out = rows.where(~F.coalesce(F.col("require_pair") & ~found, F.lit(False)) & F.col("us").isNotNull()).select(
        "session_id", "id", "ord", F.col("us").alias("end_us"),
        chosen(F.when(F.col("command").isNull() | F.col("require_pair"), of_launch("command")).otherwise(F.col("command")), F.col("command"), F.col("command")).alias("command"),
        chosen(F.when(~F.coalesce(of_launch("deferred"), F.lit(False)), F.col("exit_code")), F.col("exit_code"), F.col("exit_code")).alias("exit_code"),
        chosen(of_launch("at_us"), F.when(~start_conflict, F.coalesce(own, of_launch("at_us"))), own).alias("start_us"),
        chosen(of_launch("cwd"), interval_cwd, F.col("cwd")).alias("cwd"),
        F.when(~(F.col("deferred") | F.coalesce(of_launch("deferred"), F.lit(False))), F.col("error")).alias("error"),
        chosen(~explicit_cwd, start_conflict | cwd_conflict | (~F.col("cwd_given") & ~paired_cwd), F.lit(False)).alias("pending"),
    )
    last = out.groupBy("session_id", "id").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("session_id", "id", "ord")]), "ord").alias("e"))
    return last.select("session_id", "id", "e.*")
