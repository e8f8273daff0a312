"""Freshness as a stream: one alarm for each time that an asset's window passes without a completion.

State is keyed by asset and holds its last settled completion and those that the watermark has not passed yet, in order; an event-time timer wakes it when the window ends.
Completions may come late by up to the watermark's delay: what is on time is settled in order of time, so alarms don't depend on the order of files or batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALARMS = "asset string, last_completed timestamp, due_at timestamp"


def _stamp(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


def _settle(last: int | None, pending: list[int], window: int, upto: int) -> tuple[int | None, list[int], list[int]]:
    """Passes over completions up to ``upto``: the last one, those still open, and the ones after which the window passed. All in microseconds."""
    missed = []
    while pending and pending[0] <= upto:
        if last is not None and pending[0] - last > window:
            missed.append(last)
        last, pending = pending[0], pending[1:]
    return last, pending, missed


def freshness_alarms(completions: DataFrame, hours: float, delay: str = "1 hour") -> DataFrame:
    """asset, last_completed, due_at from a stream of completions (asset, completed_at): an alarm when ``due_at`` has passed without another completion."""
    window = int(hours * 3_600_000_000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told, pending = state.get if state.exists else (None, None, [])
        pending = sorted([*pending, *(int(t.value // 1000) for p in parts for t in p["completed_at"] if not pd.isna(t))])
        mark = state.getCurrentWatermarkMs() * 1000
        if told is not None or last is not None:
            pending = [t for t in pending if t > last]  # repeated deliveries
        last, pending, missed = _settle(last, pending, window, mark)
        missed = [m for m in missed if m != told]
        due = None if last is None else last + window
        if due is not None and due < mark and last != told and not (pending and pending[0] <= due):
            missed.append(last)
            told = last
        state.update((last, told, pending))
        wake = [t for t in (due if last != told else None, pending[0] if pending else None) if t is not None]
        if wake:
            state.setTimeoutTimestamp(max(min(wake) // 1000 + 1, mark // 1000 + 1))
        if missed:
            yield pd.DataFrame({"asset": [key[0]] * len(missed), "last_completed": [_stamp(m) for m in missed], "due_at": [_stamp(m + window) for m in missed]})

    stream = completions.select(F.col("asset").cast("string").alias("asset"), F.col("completed_at").cast("timestamp").alias("completed_at")).withWatermark("completed_at", delay)
    return stream.groupBy("asset").applyInPandasWithState(step, ALARMS, "last bigint, told bigint, pending array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def freshness_gaps(completions: DataFrame, hours: float, until) -> DataFrame:
    """The same alarms from a whole table, for windows that ended before ``until``."""
    rows = completions.where("completed_at IS NOT NULL").select(F.col("asset").cast("string").alias("asset"), F.col("completed_at").cast("timestamp").alias("last_completed"))
    due = F.col("last_completed") + F.expr(f"interval {int(hours * 3600)} second")
    following = F.lead("last_completed").over(Window.partitionBy("asset").orderBy("last_completed"))
    rows = rows.withColumn("due_at", due).withColumn("next", following)
    return rows.where(F.when(F.col("next").isNull(), F.col("due_at") < F.lit(until).cast("timestamp")).otherwise(F.col("next") > F.col("due_at"))).select("asset", "last_completed", "due_at")
