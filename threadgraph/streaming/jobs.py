"""Latest state per job with expiry counted from creation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_SECONDS = 4 * 3600


def job_state(events: DataFrame, now: DataFrame | None = None, ttl: int = TTL_SECONDS) -> DataFrame:
    """Batch twin: latest status and progress, creation time and whether the entry is alive.

    ``events``: job_id, ts, seq, status, progress. The clock is the latest event time unless
    ``now`` (one row, column ``now``) is given.
    """
    s = events.groupBy("job_id").agg(
        F.max_by(F.struct("status", "progress"), F.struct("ts", "seq")).alias("l"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    clock = events.agg(F.max("ts").alias("now")) if now is None else now
    s = s.withColumn("_k", F.lit(1)).join(clock.withColumn("_k", F.lit(1)), "_k")
    alive = F.col("created_at") + F.expr(f"INTERVAL {ttl} SECONDS") > F.col("now")
    return s.select("job_id", F.col("l.status").alias("status"), F.col("l.progress").alias("progress"), "created_at", "updated_at", alive.alias("alive"))


OUT = "job_id long, status string, progress double, created_at timestamp, updated_at timestamp, expired boolean"
STATE = "created long, updated long, seq long, status string, progress double"


def job_state_stream(events: DataFrame, delay: str = "10 minutes", ttl: int = TTL_SECONDS) -> DataFrame:
    """Streaming form: state per job, one event-time timer set from its first event.

    State holds one small row per live job, however many events a job has; events are read in
    Arrow batches, never gathered.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            created, updated, _, status, progress = state.get
            state.remove()
            yield row(key[0], status, progress, created, updated, True)
            return
        cur = list(state.get) if state.exists else None
        for pdf in batches:
            micros = pdf["ts"].astype("datetime64[us]").astype("int64")
            last = pdf.assign(_m=micros).sort_values(["_m", "seq"]).iloc[-1]
            first, latest = int(micros.min()), (int(last["_m"]), int(last["seq"]))
            if cur is None:
                cur = [first, latest[0], latest[1], last["status"], float(last["progress"])]
                continue
            cur[0] = min(cur[0], first)
            if latest > (cur[1], cur[2]):
                cur[1:] = [latest[0], latest[1], last["status"], float(last["progress"])]
        if cur is None:
            return
        due = cur[0] // 1000 + ttl * 1000
        if due <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield row(key[0], cur[3], cur[4], cur[0], cur[1], True)
            return
        state.update(tuple(cur))
        state.setTimeoutTimestamp(due)
        yield row(key[0], cur[3], cur[4], cur[0], cur[1], False)

    def row(job, status, progress, created, updated, expired) -> pd.DataFrame:
        at = lambda us: pd.Timestamp(us, unit="us")
        return pd.DataFrame({"job_id": [job], "status": [status], "progress": [progress], "created_at": [at(created)], "updated_at": [at(updated)], "expired": [expired]})

    return (events.withWatermark("ts", delay).groupBy("job_id")
            .applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout))
