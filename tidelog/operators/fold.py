"""Folds over histories, snapshots and rehydration.

A commutative fold is an aggregate with partial sums; an ordered one that SQL can write runs as a higher-order function over the sorted
events of a stream; any other takes an `Aggregate` per stream in Python. A stream's ordered fold is serial by nature; snapshots keep it short.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.schema import InvalidInput


class Aggregate(Protocol):
    """State folded from events: default-constructed, applied in order, optionally saved and restored."""

    def apply(self, event: object) -> None: ...

    def snapshot(self) -> bytes:
        raise InvalidInput("this aggregate has no snapshot")

    @classmethod
    def restore(cls, data: bytes) -> Aggregate:
        raise InvalidInput("this aggregate has no snapshot")


def sum_fold(events: DataFrame, value: Column, key: str = "stream") -> DataFrame:
    """key, state (the sum), version of the last event."""
    return events.groupBy(key).agg(F.sum(value).alias("state"), F.max("version").alias("version"))


def ordered_fold(events: DataFrame, start: Column, step: Callable[[Column, Column], Column], columns: list[str], key: str = "stream", order: tuple[str, ...] = ("version",)) -> DataFrame:
    """key, state, version: step(state, event) over the events in order; the event has `columns`."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    return events.groupBy(key).agg(F.aggregate(rows, start, step).alias("state"), F.max("version").alias("version"))


def python_fold(events: DataFrame, aggregate: type, key: str = "stream", snapshots: DataFrame | None = None) -> DataFrame:
    """key, state (the aggregate's snapshot), version, for folds that only Python can write; from snapshots (key, state, through_version) where there are any."""
    rows = events
    if snapshots is not None:
        rows = events.join(snapshots.select(key, F.col("state").alias("__state"), "through_version"), key, "left").where(F.col("through_version").isNull() | (F.col("version") > F.col("through_version")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf["__state"].iloc[0] if "__state" in pdf else None
        state = aggregate.restore(bytes(held)) if held is not None else aggregate()
        pdf = pdf.sort_values("version", kind="stable")
        for event in pdf.itertuples(index=False):
            state.apply(event)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "state": [state.snapshot()], "version": [int(pdf["version"].iloc[-1])]})

    return rows.groupBy(key).applyInPandas(run, f"{key} string, state binary, version long")


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The last published snapshot of each stream."""
    return snapshots.groupBy("stream").agg(F.max(F.struct("snap_seq", *[c for c in snapshots.columns if c not in ("stream", "snap_seq")])).alias("s")).select("stream", "s.*")


def rehydrate_sum(snapshots: DataFrame, events: DataFrame, value: Column) -> DataFrame:
    """stream, state, version: the latest snapshot (state as a number) and the sum of what follows it."""
    last = latest_snapshots(snapshots).select("stream", F.col("state").alias("__state"), F.col("through_version").alias("__through"))
    rows = events.join(last, "stream", "left").where(F.col("__through").isNull() | (F.col("version") > F.col("__through")))
    backlog = rows.groupBy("stream").agg(F.sum(value).alias("__sum"), F.max("version").alias("__last"))
    return backlog.join(last, "stream", "full_outer").select("stream", (F.coalesce("__state", F.lit(0)) + F.coalesce("__sum", F.lit(0))).alias("state"), F.coalesce("__last", "__through").alias("version"))


def backlog(tails: DataFrame, snapshots: DataFrame) -> DataFrame:
    """stream, backlog: versions after the latest snapshot, by tail."""
    last = latest_snapshots(snapshots).select("stream", "through_version")
    return tails.join(last, "stream", "left").select("stream", F.greatest(F.coalesce(F.col("version") + 1, F.lit(0)) - F.coalesce(F.col("through_version") + 1, F.lit(0)), F.lit(0)).alias("backlog"))


def job_status(journal: DataFrame, compactions: DataFrame) -> DataFrame:
    """job_id, status, worker, error: completed if a compaction record names the job, else what its last journal event says."""
    last = journal.groupBy("job_id").agg(F.max(F.struct("pos", "type", "worker", "error")).alias("j"))
    done = compactions.where("job_id is not null").select("job_id", F.lit(True).alias("done")).distinct()
    state = F.when(F.col("done"), "completed").when(F.col("j.type") == "requested", "pending").when(F.col("j.type") == "claimed", "claimed").when(F.col("j.type") == "failed", "failed")
    both = last.join(done, "job_id", "full_outer")
    return both.select("job_id", state.alias("status"), F.when(state == "claimed", F.col("j.worker")).alias("worker"), F.when(state == "failed", F.col("j.error")).alias("error"))
