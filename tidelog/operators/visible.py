"""Which events are visible: guards, lineage, tails, pages and seeks, as plain DataFrame transformations.

Events have stream, version, global_seq, ts_ms and, where named, data, event_type, commit_pos, ts_indexed; further columns pass
through. Control tables (trims, rollbacks, deletes, forks) are small next to events; their joins carry no hint, so the optimizer
broadcasts them by their measured size and shuffles both sides beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import TAIL, InvalidInput
from tidelog.session import settle


def bounds(lo: int | None = None, hi: int | None = None, lo_open: bool = False, hi_closed: bool = False) -> tuple[int, int]:
    """A half-open range [lo, hi) from ends that are included, excluded or absent."""
    low = 0 if lo is None else lo + bool(lo_open)
    high = TAIL if hi is None else min(TAIL, hi + bool(hi_closed))
    return max(0, low), high


def in_range(events: DataFrame, lo: int = 0, hi: int = TAIL) -> DataFrame:
    """Versions in [lo, hi); the predicate reaches the scan."""
    if lo >= hi:
        return events.where(F.lit(False))
    return events.where((F.col("version") >= lo) & (F.col("version") < hi))


def lww(events: DataFrame, order: str = "commit_pos") -> DataFrame:
    """The last write of each (stream, version)."""
    last = Window.partitionBy("stream", "version").orderBy(F.desc(order))
    return events.withColumn("__rank", F.row_number().over(last)).where("__rank = 1").drop("__rank")


def trimmed(events: DataFrame, trims: DataFrame) -> DataFrame:
    """Versions at or above the stream's trim floor."""
    floors = trims.select(F.col("stream"), F.col("floor").alias("__floor"))
    return events.join(floors, "stream", "left").where(F.col("version") >= F.coalesce("__floor", F.lit(0))).select(*events.columns)


def not_rolled_back(events: DataFrame, rollbacks: DataFrame) -> DataFrame:
    """Events outside every rollback window: version >= from_version and global_seq > txn hides one."""
    r = rollbacks.select(F.col("stream").alias("__s"), "from_version", "txn")
    return events.join(r, (F.col("stream") == F.col("__s")) & (F.col("version") >= F.col("from_version")) & (F.col("global_seq") > F.col("txn")), "left_anti")


def pins(forks: DataFrame, deletes: DataFrame, transitive: bool = False) -> DataFrame:
    """stream, ceiling: the highest version that a living direct child of the stream forked at; transitive: that any living descendant needs."""
    living = forks.join(deletes.select(F.col("stream").alias("child")), "child", "left_anti")
    if transitive:
        chain = lineage(forks, living.select(F.col("child").alias("root")))
        return chain.where("depth > 0").groupBy(F.col("seg").alias("stream")).agg((F.max("hi") - 1).alias("ceiling"))
    return living.groupBy(F.col("parent").alias("stream")).agg(F.max("at_version").alias("ceiling"))


def not_deleted(events: DataFrame, deletes: DataFrame, forks: DataFrame, transitive: bool = False) -> DataFrame:
    """A deleted stream shows what its pins hold, or nothing."""
    gone = deletes.select("stream", F.lit(True).alias("__gone"))
    caps = pins(forks, deletes, transitive).withColumnRenamed("ceiling", "__ceiling")
    marked = events.join(gone.join(caps, "stream", "left"), "stream", "left")
    return marked.where(F.col("__gone").isNull() | (F.col("version") <= F.col("__ceiling"))).select(*events.columns)


def guarded(events: DataFrame, trims: DataFrame, rollbacks: DataFrame, deletes: DataFrame, forks: DataFrame) -> DataFrame:
    return not_deleted(not_rolled_back(trimmed(events, trims), rollbacks), deletes, forks)


def ancestors(forks: DataFrame) -> DataFrame:
    """child, seg, at, steps: every ancestor of each fork, the versions up to `at` that it still sees there, and how many forks lie between.

    Paths are doubled: round k joins paths of up to 2^k forks with those of just 2^k, so a chain of n forks takes log2(n) rounds. The rounds'
    tables are written and read again; they hold the control table's closure, not events. A chain that is longer than there are forks is a cycle.
    """
    known = settle(forks.select("child", F.col("parent").alias("seg"), F.col("at_version").cast("long").alias("at"), F.lit(1).cast("long").alias("steps")), "lineage-forks")
    step, size, length = known, known.count(), 1
    join = lambda left: left.join(
        step.select(F.col("child").alias("seg"), F.col("seg").alias("__to"), F.col("at").alias("__at"), F.col("steps").alias("__steps")), "seg"
    ).select("child", F.col("__to").alias("seg"), F.least("at", "__at").alias("at"), (F.col("steps") + F.col("__steps")).alias("steps"))
    while size:
        longer = settle(join(known), "lineage-paths")
        if longer.isEmpty():
            return known
        if length >= size:  # paths of more forks than there are
            raise InvalidInput("the fork chain is a cycle")
        known, step, length = known.unionAll(longer), longer.where(F.col("steps") == 2 * length), 2 * length
    return known


def lineage(forks: DataFrame, roots: DataFrame) -> DataFrame:
    """root, seg, hi, depth: the streams whose events make up each root's history, with the versions below hi that count."""
    own = roots.select("root", F.col("root").alias("seg"), F.lit(TAIL).alias("hi"), F.lit(0).alias("depth"))
    up = ancestors(forks).select(F.col("child").alias("root"), "seg", (F.col("at") + 1).alias("hi"), F.col("steps").cast("int").alias("depth"))
    return own.unionAll(roots.select("root").join(up, "root"))


def history(guarded_events: DataFrame, chain: DataFrame, lo: int = 0, hi: int = TAIL) -> DataFrame:
    """Events of each root with root, depth: of every segment those below its hi. In order: root, depth descending, version."""
    at = chain.select("root", F.col("seg").alias("stream"), F.least("hi", F.lit(hi)).alias("__hi"), "depth")
    return in_range(guarded_events, lo, hi).join(at, "stream").where(F.col("version") < F.col("__hi")).drop("__hi")


def without_system(events: DataFrame) -> DataFrame:
    """What a reader's history shows: no event type that begins with $."""
    return events.where(~F.col("event_type").startswith("$"))


def tails(events: DataFrame, forks: DataFrame | None = None) -> DataFrame:
    """stream, version, ts_ms of each tail; a fresh fork's tail is its fork point with its parent's time."""
    own = events.groupBy("stream").agg(F.max("version").alias("version"), F.max_by("ts_ms", "version").alias("ts_ms"))
    if forks is None:
        return own
    parents = own.select(F.col("stream").alias("parent"), F.col("ts_ms").alias("parent_ts"))
    fresh = forks.join(parents, "parent", "left").select(F.col("child").alias("stream"), F.col("at_version").alias("version"), F.col("parent_ts").alias("ts_ms"))
    return own.unionAll(fresh).groupBy("stream").agg(F.max("version").alias("version"), F.max_by("ts_ms", "version").alias("ts_ms"))


def reader_version(guarded_events: DataFrame) -> DataFrame:
    """stream, version of the last visible local event."""
    return guarded_events.groupBy("stream").agg(F.max("version").alias("version"))


def list_streams(all_tails: DataFrame, deletes: DataFrame) -> DataFrame:
    return all_tails.join(deletes, "stream", "left_anti").select("stream")


def read_tail(guarded_events: DataFrame, all_tails: DataFrame, n: int) -> DataFrame:
    """What is visible of the last n versions below each tail."""
    at = all_tails.select("stream", F.greatest(F.col("version") + 1 - n, F.lit(0)).alias("__lo"))
    return guarded_events.join(at, "stream").where(F.col("version") >= F.col("__lo")).drop("__lo")


def read_page(guarded_events: DataFrame, start: int, max_count: int, max_bytes: int, data: str = "data") -> DataFrame:
    """Each stream's page from start: the first event always, more while count and bytes allow; with cursor (the next version, null when drained)."""
    order = Window.partitionBy("stream").orderBy("version")
    rows = guarded_events.where(F.col("version") >= start)
    rows = rows.withColumn("__rn", F.row_number().over(order)).withColumn("__sum", F.sum(F.octet_length(data)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__next", F.lead("version").over(order))
    fits = (F.col("__rn") == 1) | ((F.col("__rn") <= max_count) & (F.col("__sum") <= max_bytes))
    kept = rows.where(fits)
    end = Window.partitionBy("stream")
    last = F.max(F.struct("version", "__next")).over(end)
    return kept.withColumn("cursor", F.when(last["__next"].isNotNull(), last["version"] + 1)).drop("__rn", "__sum", "__next")


def seek_timestamp(raw_events: DataFrame, ts_ms: Column | int) -> DataFrame:
    """stream, version, ts_ms of the first index entry at or after ts_ms, whatever hides it."""
    at = F.lit(ts_ms) if isinstance(ts_ms, int) else ts_ms
    rows = raw_events.where("ts_indexed") if "ts_indexed" in raw_events.columns else raw_events
    first = rows.where(F.col("ts_ms") >= at).groupBy("stream").agg(F.min(F.struct("ts_ms", "version")).alias("f"))
    return first.select("stream", "f.version", "f.ts_ms")


def monotone_ts(events: DataFrame) -> DataFrame:
    """ts_ms raised to the highest of the stream so far."""
    order = Window.partitionBy("stream").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("ts_ms", F.max("ts_ms").over(order))


def purge_range(streams: DataFrame, forks: DataFrame, deletes: DataFrame, floor: int) -> DataFrame:
    """stream, lo, hi: versions that a purge below floor takes; what a living child pins stays."""
    caps = pins(forks, deletes)
    return streams.join(caps, "stream", "left").select("stream", F.coalesce(F.col("ceiling") + 1, F.lit(0)).alias("lo"), F.lit(floor).cast("long").alias("hi"))


def check_expected(requests: DataFrame, all_tails: DataFrame) -> DataFrame:
    """requests (stream, expected any/none/exact, expected_version) with actual and ok."""
    found = requests.join(all_tails.select("stream", F.col("version").alias("actual")), "stream", "left")
    ok = (F.col("expected") == "any") | ((F.col("expected") == "none") & F.col("actual").isNull()) | ((F.col("expected") == "exact") & F.col("actual").eqNullSafe(F.col("expected_version")))
    return found.withColumn("ok", F.coalesce(ok, F.lit(False)))


def check_fence(requests: DataFrame, fences: DataFrame) -> DataFrame:
    """requests (stream, token) with current and ok: a fenced stream takes its token or a plain append without one, an unfenced one any."""
    held = requests.join(fences.select("stream", F.col("token").alias("current")), "stream", "left")
    return held.withColumn("ok", F.col("token").isNull() | F.col("current").isNull() | (F.col("token") == F.col("current")))
