"""The event store: optimistic appends, transactions, fences, forks, retention, snapshots and jobs over a commit log."""

from __future__ import annotations

import random
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.operators import visible
from tidelog.sources.commitlog import CommitLog, State


#: Parts that streams are dealt over when a bulk append numbers its rows.
PARTS = 1024
#: Streams whose floors a purge sends to every executor; beyond it the floors are joined by a shuffle.
BROADCAST_SPANS = 100_000
#: New files, each of an append or a few, that one task reads for a view that follows.
FEW_FILES = 8


def _id(ms: int) -> str:
    return f"{ms:012x}{uuid.uuid4().hex[:14]}"


class _Reads:
    """What writer and reader share: DataFrames over the files that commits name, under the guards of the control tables."""

    spark: SparkSession
    log: CommitLog
    state: State

    def _sync(self) -> State:
        return self.log.refresh(self.state)

    def events_df(self, streams: list[str] | None = None) -> DataFrame:
        """All raw events, shadowed ones included; of the named streams only, if given (files without them are not opened)."""
        state = self._sync()
        names = [n for n, held in state.files.items() if streams is None or held is None or not set(held).isdisjoint(streams)]
        if not names:
            return self.spark.createDataFrame([], S.EVENTS)
        df = self._files(names)
        return df if streams is None else df.where(F.col("stream").isin(streams))

    def _files(self, names: Iterable[str]) -> DataFrame:
        return self.spark.read.schema(S.EVENTS).parquet(*[f"{self.log.root}/{n}" for n in names])

    def control_df(self, name: str) -> DataFrame:
        s = self._sync()
        rows, ddl = {
            "tails": ([(k, v, t) for k, (v, t) in s.tails.items()], S.TAILS),
            "fences": (list(s.fences.items()), S.FENCES),
            "trims": (list(s.trims.items()), S.TRIMS),
            "deletes": ([(x,) for x in sorted(s.deletes)], S.DELETES),
            "forks": ([(c, p, a) for c, (p, a) in s.forks.items()], S.FORKS),
            "rollbacks": ([(k, f, t) for (k, f), t in s.rollbacks.items()], S.ROLLBACKS),
            "snapshots": ([(x["stream"], i, x["through_version"], x["ts_ms"], bytes.fromhex(x["state"])) for i, x in enumerate(s.snapshots)], S.SNAPSHOTS),
            "compactions": ([(x["pos"], x["stream"], x["through_version"], x["events_compacted"], x.get("job_id"), x["ts_ms"]) for x in s.compactions], S.COMPACTIONS),
            "job_events": ([(x["pos"], x["type"], x["job_id"], x.get("stream"), x.get("worker"), x.get("error"), x["ts_ms"]) for x in s.jobs], S.JOB_EVENTS),
        }[name]
        return self.spark.createDataFrame(rows, ddl)

    def _guarded(self, streams: list[str], lo: int, hi: int, ordered: bool = False) -> DataFrame:
        """Guards as literals: a call names few streams, so the tables need no join, and an absent guard costs nothing. Ordered: dealt by ranges of versions, so that an order by version moves no data again."""
        s = self._sync()
        df = visible.in_range(self.events_df(streams), lo, hi)
        df = visible.lww(df.repartitionByRange("version") if ordered else df)
        pins = s.pins()
        for name in streams:
            here = F.col("stream") == name
            hide = F.lit(False)
            if name in s.trims:
                hide = hide | (F.col("version") < min(s.trims[name], S.TAIL))
            for (stream, start), txn in s.rollbacks.items():
                if stream == name:
                    hide = hide | ((F.col("version") >= start) & (F.col("global_seq") > txn))
            if name in s.deletes:
                hide = hide | (F.col("version") > pins.get(name, -1))
            df = df.where(~(here & hide))
        return df

    def read_stream(self, stream: str, lo: int = 0, hi: int = S.TAIL) -> DataFrame:
        return self._guarded([stream], lo, hi, ordered=True).orderBy("version")

    def lineage(self, stream: str) -> list[tuple[str, int]]:
        """(segment stream, upper end) from the oldest ancestor to the stream itself."""
        s, out, seen, hi = self._sync(), [(stream, S.TAIL)], {stream}, S.TAIL
        while stream in s.forks:
            stream, at = s.forks[stream]
            if stream in seen:
                raise S.InvalidInput("the fork chain is a cycle")
            seen.add(stream)
            hi = min(hi, at + 1)
            out.append((stream, hi))
        return out[::-1]

    def read_history(self, stream: str, lo: int = 0, hi: int = S.TAIL) -> DataFrame:
        """The history through forks; each segment under its own guards; the parent's copy of a version first."""
        chain = self.lineage(stream)
        if len(chain) == 1:
            return self._guarded([stream], lo, hi, ordered=True).orderBy("version")
        df = self._guarded([name for name, _ in chain], lo, hi)
        keep, depth = F.lit(False), F.lit(0)
        for i, (name, end) in enumerate(chain):
            keep = keep | ((F.col("stream") == name) & (F.col("version") < end))
            depth = F.when(F.col("stream") == name, i).otherwise(depth)
        return df.where(keep).withColumn("__depth", depth).orderBy("__depth", "version").drop("__depth")

    def read_since(self, stream: str, lo: int, seen: set[str]) -> tuple[DataFrame | None, set[str]]:
        """read_history from lo on, for one who has read all versions below it from the files of `seen`, and the files there are now. Only others are opened (None: no other holds the stream),
        and a few appends are read by one task; but forks and guards may show later what a seen file holds, so with them all files are read."""
        s = self._sync()
        files = set(s.files)
        if stream in s.forks or stream in s.trims or stream in s.deletes or any(name == stream for name, _ in s.rollbacks):
            return _Reads.read_history(self, stream, lo), files
        new = {n: held for n, held in s.files.items() if n not in seen and (held is None or stream in held)}
        if not new:
            return None, files
        df = visible.in_range(self._files(new).where(F.col("stream") == stream), lo)
        few = len(new) <= FEW_FILES and None not in new.values() and s.tails[stream][0] - lo < FEW_FILES * S.MAX_RECORDS
        return visible.lww(df.coalesce(1) if few else df.repartitionByRange("version")).orderBy("version"), files

    def compaction_records(self) -> list[dict]:
        return list(self._sync().compactions)


class EventStoreReader(_Reads):
    """A read-only handle: it sees the commits there were at open or at the last refresh, which is at most settings.poll_ms ago."""

    def __init__(self, spark: SparkSession, root: str, settings: S.Settings = S.Settings()):  # noqa: B008
        self.spark, self.log, self.settings = spark, CommitLog(spark, root), settings
        self.state = self.log.load()
        self.refresh()

    def _sync(self) -> State:
        if (time.monotonic() - self.seen) * 1000 >= self.settings.poll_ms:
            self.refresh()
        return self.state

    def refresh(self) -> int:
        self.seen = time.monotonic()
        return self.log.refresh(self.state).position

    def read_history(self, stream: str, lo: int = 0, hi: int = S.TAIL) -> DataFrame:
        return visible.without_system(super().read_history(stream, lo, hi))

    def stream_version(self, stream: str) -> int | None:
        """The last visible local event."""
        return self._guarded([stream], 0, S.TAIL).agg(F.max("version")).first()[0]


class Transaction:
    def __init__(self, store: EventStore):
        self.store, self.ops = store, []

    def append(self, stream: str, expected: S.Expected, events: list[S.NewEvent], token: str | None = None) -> Transaction:
        self.ops.append(("append", stream, None, expected, events, token, True))
        return self

    def fence(self, stream: str, token: str | None) -> Transaction:
        self.ops.append(("fence", stream, token))
        return self

    def commit(self) -> list[S.CommitInfo]:
        return self.store._append(self.ops)


class EventStore(_Reads):
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], int] | None = None, settings: S.Settings = S.Settings()):  # noqa: B008
        self.spark, self.log, self.settings = spark, CommitLog(spark, root), settings
        self.state = self.log.load()
        self.clock = clock or (lambda: int(time.time() * 1000))
        self.loose: list[str] = []  # files of lazy appends that are not yet durable
        self.durable = 0  # commits before this one are durable
        self.queries: list = []
        self._sync()

    @staticmethod
    def open_in_memory(spark: SparkSession, clock: Callable[[], int] | None = None) -> EventStore:
        """A store in a temporary folder, for tests on one machine."""
        return EventStore(spark, tempfile.mkdtemp(prefix="tidelog-store-"), clock)

    # -- writing ---------------------------------------------------------------------------------

    def _commit(self, build: Callable[[State], tuple[dict, object]], durable: bool = True, patience: int = 10_000) -> object:
        """Publish what build makes of the current state; on a collision read the winner and build again.

        A winner that wrote other streams is no conflict: some writer gets on with each collision. Lost MAX_RETRIES times to writers of the same streams, or `patience` times to any (builds that run jobs have little), it gives up.
        """
        if durable:
            self.flush()  # a commit is not durable before those it stands on
        lost = tries = 0
        while True:
            state = self._sync()
            commit, result = build(state)
            position, seen = state.position, {s: state.tails.get(s) for s in commit.get("tails", {})}
            if self.log.publish(position, commit, durable):
                break
            if any(self._sync().tails.get(s) != tail for s, tail in seen.items()):
                lost += 1
                if lost > S.MAX_RETRIES:
                    stream = next(s for s, tail in seen.items() if state.tails.get(s) != tail)
                    raise S.VersionConflict(stream, "no other writer", state.tails[stream][0])
            tries += 1
            if tries > patience:
                raise S.VersionConflict("the log", "no other writer", position)
            time.sleep(random.random() * 0.001 * min(32, 2**tries))
        if not durable:
            self.loose += [f"_commits/{position:020}.json", *[n for n, _ in commit.get("files", [])]]
        state.apply(commit)  # as it is read back; what others add is seen by the next call
        if state.position // self.settings.checkpoint_every > position // self.settings.checkpoint_every:
            self.log.save(state)
        return result

    def _plan(self, state: State, ops: list[tuple]) -> tuple[list[dict], dict, list[S.CommitInfo]]:
        """Rows, the commit's control part and the results of ops in order; later ops see earlier ones."""
        seq, now = state.seq, self.clock()
        rows, infos, touched, cleared = [], [], {}, {}
        for op in ops:
            if op[0] == "fence":
                _, stream, token = op
                cleared[stream] = token or ""
                continue
            _, stream, start, expected, events, token, index = op
            if len(events) > S.MAX_RECORDS or any(len(e.data) > S.MAX_RECORD_BYTES for e in events):
                raise S.InvalidInput(f"at most {S.MAX_RECORDS} records of {S.MAX_RECORD_BYTES} bytes")
            fence = cleared[stream] or None if stream in cleared else state.fences.get(stream)
            if token is not None and fence not in (None, token):
                raise S.FenceMismatch(stream, fence)
            tail = touched.get(stream) or state.tails.get(stream)
            if not expected.holds(tail[0] if tail else None):
                raise S.VersionConflict(stream, expected, tail[0] if tail else None)
            if not events:
                raise S.InvalidInput("an empty batch")
            first = start if start is not None else (tail[0] + 1 if tail else 0)
            ts = max(now, tail[1] if tail else 0)
            for i, e in enumerate(events):
                rows.append({"stream": stream, "version": first + i, "global_seq": seq + i + 1, "id": _id(ts), "event_type": e.event_type, "data": e.data, "metadata": [{"name": n, "value": v} for n, v in e.metadata], "ts_ms": ts, "ts_indexed": index, "commit_pos": state.position})
            infos.append(S.CommitInfo(first, first + len(events) - 1, seq + 1))
            seq += len(events)
            touched[stream] = (max(tail[0] if tail else -1, first + len(events) - 1), ts)
        return rows, {"seq": seq, "tails": touched, "fences": cleared}, infos

    def _append(self, ops: list[tuple], durable: bool = True) -> list[S.CommitInfo]:
        def build(state: State) -> tuple[dict, object]:
            rows, commit, infos = self._plan(state, ops)
            if rows:
                commit["files"] = [[self.log.write_rows(rows, durable, self.settings.compression), sorted({r["stream"] for r in rows})]]
            return commit, infos

        return self._commit(build, durable)

    def append(self, stream: str, expected: S.Expected, events: list[S.NewEvent]) -> S.CommitInfo:
        return self._append([("append", stream, None, expected, events, None, True)])[0]

    append_durable = append

    def append_at(self, stream: str, from_version: int, expected: S.Expected, events: list[S.NewEvent]) -> S.CommitInfo:
        return self._append([("append", stream, from_version, expected, events, None, True)])[0]

    def append_with_token(self, stream: str, expected: S.Expected, events: list[S.NewEvent], token: str) -> S.CommitInfo:
        return self._append([("append", stream, None, expected, events, token, True)])[0]

    append_with_token_durable = append_with_token

    def append_lazy(self, stream: str, expected: S.Expected, events: list[S.NewEvent]) -> S.CommitTicket:
        return self.append_with_token_lazy(stream, expected, events, None)

    def append_with_token_lazy(self, stream: str, expected: S.Expected, events: list[S.NewEvent], token: str | None, index_ts: bool = True) -> S.CommitTicket:
        """Published at once as a commit of its own, seen by every handle; flush, await_durable or the next durable commit makes it and all before it durable."""
        info = self._append([("append", stream, None, expected, events, token, index_ts)], durable=False)[0]
        return S.CommitTicket(info, self.state.seq, self.state.position)

    def flush(self) -> None:
        """Make every commit of this handle durable: one barrier for all lazy appends since the last one."""
        loose, self.loose = self.loose, []
        if loose:
            self.log.blobs.fsync(loose)
        self.durable = self.state.position

    def await_durable(self, ticket: S.CommitTicket) -> None:
        if ticket.position > self.durable:
            self.flush()

    def append_many(self, df: DataFrame) -> int:
        """Append a DataFrame (stream, event_type, data and a column `ord` that orders a stream's rows) as one commit; returns the number of rows.

        One Spark job numbers the versions from the tails and writes the files, sorted by stream and version, and one commit names them.
        """
        rows = df.select("stream", "event_type", F.col("data").cast("binary").alias("data"), "ord")
        n = rows.count()

        def build(state: State) -> tuple[dict, object]:
            tails = self.control_df("tails").select("stream", F.col("version").alias("__tail"), F.col("ts_ms").alias("__ts"))
            now = self.clock()
            order = Window.partitionBy("stream").orderBy("ord")
            numbered = rows.join(tails, "stream", "left").withColumn("version", F.coalesce(F.col("__tail"), F.lit(-1)) + F.row_number().over(order))
            sizes = rows.groupBy("stream").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.pmod(F.xxhash64("stream"), F.lit(PARTS)))
            parts = sizes.groupBy("part").agg(F.sum("n").alias("all"))
            before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))  # PARTS rows at most
            inside = F.sum("n").over(Window.partitionBy("part").orderBy("stream")) - F.col("n")
            first = sizes.withColumn("inside", inside).join(F.broadcast(before), "part").select("stream", (F.col("before") + F.col("inside")).alias("__first"))
            full = numbered.join(first, "stream").select(
                "stream",
                F.col("version").cast("long").alias("version"),
                (F.lit(state.seq) + F.col("__first") + F.col("version") - F.coalesce(F.col("__tail"), F.lit(-1))).cast("long").alias("global_seq"),
                F.concat(F.lit(f"{now:012x}"), F.substring(F.sha2(F.concat_ws("/", "stream", "version"), 256), 1, 14)).alias("id"),
                "event_type",
                "data",
                F.array().cast("array<struct<name:string,value:binary>>").alias("metadata"),
                F.greatest(F.lit(now), F.col("__ts")).cast("long").alias("ts_ms"),
                F.lit(True).alias("ts_indexed"),
                F.lit(state.position).cast("long").alias("commit_pos"),
            )
            name = f"data/{uuid.uuid4().hex}.parquet"
            full.repartitionByRange("stream").sortWithinPartitions("stream", "version").write.parquet(f"{self.log.root}/{name}", compression=self.settings.compression)
            ends = self.spark.read.parquet(f"{self.log.root}/{name}").groupBy("stream").agg(F.max("version"), F.max("ts_ms"))
            return {"seq": state.seq + n, "tails": {r[0]: (r[1], r[2]) for r in ends.toLocalIterator()}, "files": [[name, None]]}, n

        return self._commit(build, patience=S.MAX_RETRIES)

    def transaction(self) -> Transaction:
        return Transaction(self)

    def fence(self, stream: str, token: str | None) -> S.CommitInfo:
        self._append([("fence", stream, token)])
        tail = self.state.tails.get(stream, (0, 0))[0]
        return S.CommitInfo(tail, tail, 0)

    def fork(self, parent: str, at_version: int, child: str) -> None:
        def build(state: State) -> tuple[dict, object]:
            tail = state.tails.get(parent)
            if tail is None or tail[0] < at_version:
                raise S.InvalidInput(f"{parent} has no version {at_version}")
            if child in state.tails:
                raise S.VersionConflict(child, S.NO_STREAM, state.tails[child][0])
            return {"forks": [[child, parent, at_version]], "tails": {child: (at_version, tail[1])}}, None

        self._commit(build)

    def trim(self, stream: str, from_version: int, txn: int) -> None:
        """Hide versions from from_version on that were written after txn."""
        self._commit(lambda state: ({"rollbacks": [[stream, from_version, txn]]}, None))

    def trim_below(self, stream: str, floor: int) -> int:
        def build(state: State) -> tuple[dict, object]:
            most = state.tails[stream][0] + 1 if stream in state.tails else S.TAIL
            new = max(state.trims.get(stream, 0), min(floor, most, S.TAIL))
            return {"trims": {stream: new}}, new

        return self._commit(build)

    def purge_below(self, stream: str, floor: int) -> int:
        """Delete versions below floor that no living child pins; see purge_many."""
        return self.purge_many({stream: floor})

    def purge_many(self, floors: dict[str, int]) -> int:
        """Delete of each stream the versions below its floor that no living child pins, by one rewrite of the files that hold them; how many. The time index keeps its entries."""

        def build(state: State) -> tuple[dict, object]:
            pins = state.pins()
            spans = [(s, lo, floor) for s, floor in floors.items() if (lo := pins.get(s, -1) + 1) < floor]
            wanted = {s for s, _, _ in spans}
            names = {n: held for n, held in state.files.items() if held is None or not wanted.isdisjoint(held)}
            if not names or not spans:
                return {}, 0
            bounds = self.spark.createDataFrame(spans, "__stream string, __lo long, __floor long")
            bounds = F.broadcast(bounds) if len(spans) <= BROADCAST_SPANS else bounds
            gone = (F.col("stream") == F.col("__stream")) & (F.col("version") >= F.col("__lo")) & (F.col("version") < F.col("__floor"))
            low = F.col("version") < max(floor for _, _, floor in spans)
            hit = self._files(names).where(low & F.col("stream").isin(list(wanted)) if len(wanted) <= 100 else low).join(bounds, gone)
            paths = [r[0] for r in hit.select(F.col("_metadata.file_path")).distinct().toLocalIterator()]
            old = sorted({"data/" + p.rpartition("/data/")[2].split("/")[0] for p in paths})
            if not old:
                return {}, 0
            count = hit.select("stream", "version").distinct().count()
            kept = f"data/{uuid.uuid4().hex}.parquet"
            self._files(old).join(bounds, gone, "left_anti").sortWithinPartitions("stream", "version").write.parquet(f"{self.log.root}/{kept}", compression=self.settings.compression)
            held = None if any(names[n] is None for n in old) else sorted({x for n in old for x in names[n]})
            return {"files": [[kept, held]], "removed": old, "replaces": {kept: old}}, count

        return self._commit(build, patience=S.MAX_RETRIES)

    def merge_files(self, least: int = 2) -> int:
        """Rewrite the files of single appends as one sorted table, as many small files make reads slow; how many were merged. Shadowed versions stay."""

        def build(state: State) -> tuple[dict, object]:
            names = [n for n, held in state.files.items() if held is not None]
            if len(names) < least:
                return {}, 0
            name = f"data/{uuid.uuid4().hex}.parquet"
            self._files(names).repartitionByRange("stream", "version").sortWithinPartitions("stream", "version").write.parquet(f"{self.log.root}/{name}", compression=self.settings.compression)
            return {"files": [[name, None]], "removed": names, "replaces": {name: names}}, len(names)

        return self._commit(build, patience=S.MAX_RETRIES)

    def vacuum(self) -> int:
        """Delete data files that purges and merges have replaced; followers find merged events in the files that replace them."""
        return self.log.vacuum(self._sync())

    def delete_stream(self, stream: str) -> None:
        if stream in self._sync().tails:
            self._commit(lambda state: ({"deletes": [stream]}, None))

    # -- reading ---------------------------------------------------------------------------------

    def stream_version(self, stream: str) -> int | None:
        tail = self._sync().tails.get(stream)
        return tail[0] if tail else None

    def check_tail(self, stream: str) -> tuple[int, int] | None:
        return self._sync().tails.get(stream)

    def read_tail(self, stream: str, n: int) -> DataFrame:
        tail = self.stream_version(stream)
        return self.read_stream(stream, max(0, (-1 if tail is None else tail) + 1 - n), S.TAIL if n else 0)

    def read_page(self, stream: str, start: int, limit: S.PageLimit) -> tuple[list[Row], int | None]:
        rows = visible.read_page(self._guarded([stream], start, S.TAIL), start, limit.max_count, limit.max_bytes).orderBy("version").collect()  # max_count rows at most
        return rows, rows[0]["cursor"] if rows else None

    def seek_timestamp(self, stream: str, ts_ms: int) -> int | None:
        """The first version with an index entry at or after ts_ms, hidden ones included."""
        row = visible.seek_timestamp(self.events_df([stream]), ts_ms).first()
        return row["version"] if row else None

    def seek_visible(self, stream: str, ts_ms: int) -> int | None:
        row = visible.seek_timestamp(self._guarded([stream], 0, S.TAIL), ts_ms).first()
        return row["version"] if row else None

    def list_streams(self) -> list[str]:
        s = self._sync()
        return sorted(x for x in s.tails if x not in s.deletes)

    def durable_sequence(self) -> int:
        return self._sync().seq

    def follow(self, checkpoint: str, each: Callable[[DataFrame, int], None], streams: list[str] | None = None, start: int = 0, poll_ms: int = 500):
        """Follow streams (all if none are named) until the query or the store is stopped."""
        from tidelog.streaming import follow

        self.queries.append(follow.run(follow.follow_streams(self.spark, self.log.root, streams, start), checkpoint, each, poll_ms))
        return self.queries[-1]

    def close(self) -> None:
        """Make all commits durable and stop the queries that this handle has started."""
        self.flush()
        for q in self.queries:
            q.stop()
        self.queries = []

    # -- folds, snapshots, jobs ------------------------------------------------------------------

    def fold(self, stream: str, init: object, apply: Callable[[object, Row], object], lo: int = 0, hi: int = S.TAIL) -> tuple[object, int | None]:
        """The left fold over a stream's history, event by event as partitions arrive, and its last version."""
        state, last = init, None
        for event in self.read_history(stream, lo, hi).toLocalIterator():
            state, last = apply(state, event), event["version"]
        return state, last

    def latest_snapshot(self, stream: str) -> dict | None:
        return next((s for s in reversed(self._sync().snapshots) if s["stream"] == stream), None)

    def rehydrate(self, aggregate: type, stream: str) -> tuple[object, int | None]:
        snap = self.latest_snapshot(stream)
        start = aggregate.restore(bytes.fromhex(snap["state"])) if snap else aggregate()

        def step(state: object, event: Row) -> object:
            state.apply(event)
            return state

        state, last = self.fold(stream, start, step, snap["through_version"] + 1 if snap else 0)
        return state, last if last is not None else (snap["through_version"] if snap else None)

    def compact_with(self, stream: str, build: Callable[[Iterable[Row]], bytes], job_id: str | None = None) -> dict:
        seen = {"n": 0, "last": None}

        def counted() -> Iterable[Row]:
            for event in self.read_history(stream).toLocalIterator():
                seen["n"], seen["last"] = seen["n"] + 1, event["version"]
                yield event

        rows = counted()
        data = build(rows)
        for _ in rows:  # what build left
            pass
        if not seen["n"]:
            raise S.InvalidInput(f"{stream} has no events")
        return self.publish_snapshot(stream, seen["last"], seen["n"], data, job_id)

    def compact(self, aggregate: type, stream: str, job_id: str | None = None, from_zero: bool = False) -> dict:
        """A snapshot from the whole history; where a purge has left a gap, from the latest snapshot on unless from_zero."""
        snap = self.latest_snapshot(stream)
        first = self.read_history(stream).limit(1).first()
        lo = snap["through_version"] + 1 if snap and not from_zero and (first is None or first["version"] > 0) else 0
        count = [0]

        def step(state: object, event: Row) -> object:
            count[0] += 1
            state.apply(event)
            return state

        state, last = self.fold(stream, aggregate.restore(bytes.fromhex(snap["state"])) if lo else aggregate(), step, lo)
        if last is None:
            raise S.InvalidInput(f"{stream} has no events")
        return self.publish_snapshot(stream, last, count[0], state.snapshot(), job_id)

    def compact_job(self, job_id: str, aggregate: type, stream: str) -> dict:
        return self.compact(aggregate, stream, job_id)

    def publish_snapshot(self, stream: str, through_version: int, events_compacted: int, state: bytes, job_id: str | None = None) -> dict:
        """The snapshot and its announcement, in one commit."""
        record = {"stream": stream, "through_version": through_version, "events_compacted": events_compacted, "job_id": job_id, "ts_ms": self.clock()}
        self._commit(lambda s: ({"seq": s.seq + 1, "snapshots": [{"stream": stream, "through_version": through_version, "ts_ms": record["ts_ms"], "state": state.hex()}], "compactions": [record]}, None))
        return record

    def compaction_backlog(self, stream: str) -> int:
        tail, snap = self.stream_version(stream), self.latest_snapshot(stream)
        return max(0, (0 if tail is None else tail + 1) - (snap["through_version"] + 1 if snap else 0))

    def _journal(self, check: Callable[[State], None], **event: object) -> None:
        def build(state: State) -> tuple[dict, object]:
            check(state)
            return {"jobs": [event | {"ts_ms": self.clock()}]}, None

        self._commit(build)

    @staticmethod
    def _status(state: State, job_id: str) -> dict | None:
        if any(c.get("job_id") == job_id for c in state.compactions):
            return {"status": "completed"}
        last = next((j for j in reversed(state.jobs) if j["job_id"] == job_id), None)
        kinds = {"requested": "pending", "claimed": "claimed", "failed": "failed"}
        return last and {"status": kinds[last["type"]]} | {k: last[k] for k in ("worker", "error") if last.get(k)}

    def request_compaction(self, stream: str) -> str:
        job = _id(self.clock())
        self._journal(lambda s: None, type="requested", job_id=job, stream=stream)
        return job

    def claim_compaction(self, job_id: str, worker: str) -> None:
        def check(state: State) -> None:
            if (self._status(state, job_id) or {}).get("status") != "pending":
                raise S.InvalidInput(f"{job_id} is not pending")

        self._journal(check, type="claimed", job_id=job_id, worker=worker)

    def fail_compaction(self, job_id: str, error: str) -> None:
        self._journal(lambda s: None, type="failed", job_id=job_id, error=error)

    def job_status(self, job_id: str) -> dict | None:
        return self._status(self._sync(), job_id)
