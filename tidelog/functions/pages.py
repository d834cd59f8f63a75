"""Database pages as DataFrames: newest-wins images, sealed segments, coalescing, restore as of a transaction, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.schema import InvalidInput


def newest(log: DataFrame) -> DataFrame:
    """db, pgno, txid, data of the last write of each page; combined before the shuffle."""
    last = F.max_by(F.struct("txid", "data"), F.struct("txid", "frame_idx"))
    return log.groupBy("db", "pgno").agg(last.alias("p")).select("db", "pgno", "p.txid", "p.data")


def seal(log: DataFrame, every: int) -> DataFrame:
    """Segments of `every` transactions: db, seg, txid_start, txid_end, pgno, txid, data."""
    seg = F.expr(f"txid div {every}")
    last = F.max_by(F.struct("txid", "data"), F.struct("txid", "frame_idx"))
    kept = log.groupBy("db", seg.alias("seg"), "pgno").agg(last.alias("p"))
    spans = log.groupBy("db", seg.alias("seg")).agg(F.min("txid").alias("txid_start"), F.max("txid").alias("txid_end"))
    return kept.join(spans, ["db", "seg"]).select("db", "seg", "txid_start", "txid_end", "pgno", "p.txid", "p.data")


def coalesce(segments: DataFrame, db_size: int | None = None) -> DataFrame:
    """One segment of all: the newest of each page, pages beyond the database's size dropped; merged: how many versions it replaces."""
    rows = segments if db_size is None else segments.where(F.col("pgno") <= db_size)
    return rows.groupBy("db", "pgno").agg(F.max("txid").alias("txid"), F.max_by("data", "txid").alias("data"), F.count(F.lit(1)).alias("merged"))


def restore_at(segments: DataFrame, log: DataFrame, target: int, first: int = 1) -> DataFrame:
    """The image at a transaction: segments that end at or before it, then the log from there to it, which must have every transaction between (they count from `first` on)."""
    if log.where(F.col("txid") >= target).isEmpty() and segments.where(F.col("txid_end") >= target).isEmpty():
        raise InvalidInput(f"transaction {target} is not reconstructable")
    whole = segments.where(F.col("txid_end") <= target)
    reached = whole.agg(F.coalesce(F.max("txid_end"), F.lit(0))).first()[0]
    between = log.where((F.col("txid") > reached) & (F.col("txid") <= target)).agg(F.count_distinct("txid")).first()[0]
    if between < target - max(reached, first - 1):
        raise InvalidInput(f"transactions between {reached} and {target} are missing")
    base = whole.groupBy("db").agg(F.max("txid_end").alias("__base"))
    tail = log.where(F.col("txid") <= target).join(base, "db", "left").where(F.col("txid") > F.coalesce("__base", F.lit(0)))
    both = whole.select("db", "pgno", "txid", F.lit(0).alias("frame_idx"), "data").unionByName(tail.select("db", "pgno", "txid", "frame_idx", "data"))
    return newest(both)


def logical_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """equal, missing (rows of a that b lacks), extra (rows of b that a lacks)."""
    left, right = a.exceptAll(b.select(*a.columns)), b.select(*a.columns).exceptAll(a)
    counts = left.agg(F.count(F.lit(1)).alias("missing")).crossJoin(right.agg(F.count(F.lit(1)).alias("extra")))  # one row each
    return counts.select(((F.col("missing") == 0) & (F.col("extra") == 0)).alias("equal"), "missing", "extra")


def report(samples: DataFrame) -> DataFrame:
    """phase, n, mean, p50, p95, p99, max of samples (phase, ms), percentiles by linear interpolation."""
    p = F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    rows = samples.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 6).alias("mean"), p.alias("p"), F.max("ms").alias("max"))
    return rows.select("phase", "n", "mean", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("p50", "p95", "p99"))], "max")
