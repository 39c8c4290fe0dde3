"""Trailing-hour windows over a stream of requests, and the snapshot sink."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000_000
OUT = "session_id string, now_us long, current_calls long, current_tokens long, previous_calls long, previous_tokens long, requests long"


class Requests(StatefulProcessor):
    """Per session the best-ranked context and earliest time of each request id; emits the two trailing hours at the batch's latest instant.

    State is a value per request id and lives ``ttl_ms`` after its last update (0: for ever), so that late updates of old requests merge and
    state stays bounded. A change of the session's model starts anew.
    """

    def __init__(self, ttl_ms: int = 0) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttlDurationMs": self.ttl_ms} if self.ttl_ms else {}
        self.seen = handle.getMapState("seen", "id string", "us long, rank long, ord long, context long", **ttl)
        self.model = handle.getValueState("model", "model string", **ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = 0
        batch = pd.concat(list(rows)).sort_values("ord", kind="stable")
        for r in batch.itertuples(index=False):
            model = None if pd.isna(r.model) else r.model
            known = self.model.get()[0] if self.model.exists() else None
            if self.model.exists() and known != model:
                for k in [k for k in self.seen.keys()]:
                    self.seen.removeKey(k)
            if not self.model.exists() or known != model:
                self.model.update((model,))
            new = (int(r.us), int(r.rank), int(r.ord), int(r.context))
            old = self.seen.getValue((r.id,)) if self.seen.containsKey((r.id,)) else None
            if old is not None:
                best = max(new, tuple(old), key=lambda x: (x[1], x[2]))
                new = (min(new[0], old[0]), *best[1:])
            self.seen.updateValue((r.id,), new)
            now = max(now, int(r.now_us))
        hours = {"current": [0, 0], "previous": [0, 0]}
        n = 0
        for _, (us, _, _, context) in self.seen.iterator():
            n += 1
            for name, k in (("current", 1), ("previous", 2)):
                if now - k * HOUR <= us < now - (k - 1) * HOUR:
                    hours[name][0] += 1
                    hours[name][1] += context
        yield pd.DataFrame([(key[0], now, *hours["current"], *hours["previous"], n)], columns=[f.split()[0] for f in OUT.split(", ")])

    def close(self) -> None:
        """No resources."""


def trailing_hours(requests: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """Streaming L5: requests(session_id, id, us, ord, rank, context, model, now_us) to a row per session and batch. Needs the RocksDB state store."""
    return requests.groupBy("session_id").transformWithStateInPandas(Requests(ttl_ms), OUT, "Update", "None")


def snapshot_writer(path: str):
    """S17. A foreachBatch function: each batch is a complete generation under path; readers take the largest."""

    def write(batch: DataFrame, generation: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/generation={generation}")

    return write


def latest_snapshot(spark, path: str) -> DataFrame:
    """The rows of the last complete generation."""
    rows = spark.read.option("basePath", path).parquet(path)
    last = rows.agg(F.max("generation")).first()[0]
    return rows.where(F.col("generation") == last).drop("generation")
