"""Queries that work an event store: it is loaded from the tables, its own calls are made, and what it then holds is compared with SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.operators import visible
from tidelog.plans.registry import query, table
from tidelog.schema import ANY, NO_STREAM, NewEvent, exact
from tidelog.session import shared_dir
from tidelog.sources import envelope
from tidelog.sources.commitlog import CommitLog
from tidelog.sources.store import EventStore, EventStoreReader

NOW = 1_700_000_000_000


def new_store(spark: SparkSession, settings: S.Settings = S.Settings()) -> EventStore:  # noqa: B008
    return EventStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", lambda: NOW, settings)


def rows(spark: SparkSession, found: Iterable[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(list(found), ddl)


_KEPT: dict[tuple, object] = {}


def once(build: Callable) -> Callable:
    """One store (or what else is built) for an application and folder, for queries that only read it; that of the folder before is let go."""

    def get(spark: SparkSession, d: str):
        key = (build.__name__, spark.sparkContext.applicationId, d)
        if key not in _KEPT:
            for old in [k for k in _KEPT if k[0] == build.__name__]:
                del _KEPT[old]
            _KEPT[key] = build(spark, d)
        return _KEPT[key]

    return get


# -- a store of all events ---------------------------------------------------------------------------


def user_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.concat(F.lit("user-"), "user_id").alias("stream"), "event_type", F.col("props").alias("data"), F.struct("ts", "event_id").alias("ord"))


def loaded(spark: SparkSession, d: str) -> EventStore:
    store = new_store(spark)
    store.append_many(user_events(spark, d))
    return store


@once
def ruled(spark: SparkSession, d: str) -> EventStore:
    """All events, and forks, trims, rollbacks and deletions by the user's number, each by a call of its own."""
    store = loaded(spark, d)
    last = {u: store.stream_version(f"user-{u}") for u in sorted(int(s.split("-")[1]) for s in store.list_streams())}
    later = visible.in_range(store.events_df(), 30)
    number = F.substring_index("stream", "-", -1).cast("long")
    for child, parent, every, at, least in (("fork", "user", 3, 10, 10), ("fork2", "fork", 9, 12, 31)):
        for u, tail in last.items():
            if u % every == 0 and tail >= least:
                store.fork(f"{parent}-{u}", at, f"{child}-{u}")
        moved = later.where(number % every == 0).select(F.concat(F.lit(f"{child}-"), number).alias("stream"), "event_type", "data", F.col("version").alias("ord"))
        if child == "fork2":
            moved = moved.join(F.broadcast(rows(spark, [(c,) for c in store.state.forks if c.startswith("fork2-")] or [("",)], "stream string")), "stream")
        store.append_many(moved.where(F.col("stream").startswith("user-") | F.col("stream").isin(list(store.state.forks))))
    marks = {r["stream"]: r["global_seq"] for r in store.events_df().where("version = 24 and stream like 'user-%'").select("stream", "global_seq").toLocalIterator()}
    for u, tail in last.items():
        if u % 5 == 0:
            store.trim_below(f"user-{u}", 5)
        if u % 7 == 0 and tail >= 24:
            store.trim(f"user-{u}", 20, marks[f"user-{u}"])
    for u in last:
        if u % 11 == 0:
            store.delete_stream(f"user-{u}")
        if u % 33 == 0:
            store.delete_stream(f"fork-{u}")
    return store


RULED = """ev as (select 'user-' || user_id as stream, row_number() over (partition by user_id order by ts, event_id) - 1 as version, event_type, props as data, user_id as u from events),
users as (select user_id as u, count(*) as n from events group by user_id),
forks as (select 'fork-' || u as child, 'user-' || u as parent, 10::bigint as at_version from users where u % 3 = 0 and n > 10
  union all select 'fork2-' || u, 'fork-' || u, 12 from users where u % 9 = 0 and n > 31),
alls as (select stream, version, event_type, data from ev
  union all select 'fork-' || u, version - 30 + 11, event_type, data from ev where version >= 30 and u % 3 = 0
  union all select 'fork2-' || u, version - 30 + 13, event_type, data from ev join users using (u) where version >= 30 and u % 9 = 0 and n > 31),
trims as (select 'user-' || u as stream, least(5, n) as floor from users where u % 5 = 0),
deletes as (select 'user-' || u as stream from users where u % 11 = 0 union all select 'fork-' || u from users where u % 33 = 0 and n > 10),
rolled as (select 'user-' || u as stream from users where u % 7 = 0 and n > 24),
pins as (select parent as stream, max(at_version) as ceiling from forks where child not in (select stream from deletes) group by parent),
guarded as (select a.* from alls a where version >= coalesce((select floor from trims t where t.stream = a.stream), 0)
  and (version < 25 or a.stream not in (select stream from rolled))
  and (a.stream not in (select stream from deletes) or a.version <= (select ceiling from pins p where p.stream = a.stream))),
tails as (select stream, max(version) as version from (select stream, version from alls union all select child, at_version from forks) group by stream),
chain as (select stream as root, stream as seg, 9223372036854775807 as hi, 0 as depth from tails
  union all select c.root, f.parent, least(c.hi, f.at_version + 1), c.depth + 1 from chain c join forks f on f.child = c.seg)"""


def sql(body: str) -> str:
    return f"with recursive {RULED} {body}"


def controls(store: EventStore) -> tuple[DataFrame, ...]:
    return tuple(store.control_df(n) for n in ("trims", "rollbacks", "deletes", "forks"))


def guarded(store: EventStore) -> DataFrame:
    return visible.guarded(visible.lww(store.events_df()), *controls(store))


def shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("stream", "version", "event_type", F.col("data").cast("string").alias("data"), *more)


@query("store_append_many", sql("select stream, version, event_type, data from ev"))
def store_append_many(spark, d):
    return shown(loaded(spark, d).events_df())


@query("store_open", sql("select stream, version from tails"))
def store_open(spark, d):
    """What a new handle on the folder finds."""
    return EventStore(spark, ruled(spark, d).log.root).control_df("tails").select("stream", "version")


@query("store_raw_access", sql("select 'tails' as name, count(*) as n from tails union all select 'trims', count(*) from trims union all select 'deletes', count(*) from deletes union all select 'forks', count(*) from forks union all select 'rollbacks', count(*) from rolled union all select 'events', count(*) from alls"))
def store_raw_access(spark, d):
    store = ruled(spark, d)
    found = [(n, store.control_df(n).count()) for n in ("tails", "trims", "deletes", "forks", "rollbacks")]
    return rows(spark, [*found, ("events", store.events_df().count())], "name string, n long")


@query("store_object_root", sql("select stream, version from tails"))
def store_object_root(spark, d):
    """The same folder through Hadoop's file system instead of the local one."""
    root = ruled(spark, d).log.root
    log = CommitLog(spark, root if "://" in root else f"file://{root}", hadoop=True)
    state = log.refresh(log.load())
    return rows(spark, [(s, v) for s, (v, _) in state.tails.items()], "stream string, version long")


@query("store_global_seq", "select 'user-' || user_id as stream, count(*) as n, count(*) as seqs, true as monotone from events group by user_id")
def store_global_seq(spark, d):
    """Sequence numbers differ, and grow with the versions of a stream."""
    from pyspark.sql import Window

    events = loaded(spark, d).events_df()
    up = F.col("global_seq") > F.coalesce(F.lag("global_seq").over(Window.partitionBy("stream").orderBy("version")), F.lit(0))
    marked = events.withColumn("up", up).withColumn("own", F.count(F.lit(1)).over(Window.partitionBy("global_seq")) == 1)
    return marked.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("seqs"), F.min("up").alias("monotone"))


@query("store_durable_sequence", "select count(*) as seq, count(distinct user_id) as streams from events")
def store_durable_sequence(spark, d):
    store = loaded(spark, d)
    return rows(spark, [(EventStore(spark, store.log.root).durable_sequence(), len(store.list_streams()))], "seq long, streams long")


@query("store_list_streams", sql("select stream from tails where stream not in (select stream from deletes)"))
def store_list_streams(spark, d):
    return rows(spark, [(s,) for s in ruled(spark, d).list_streams()], "stream string")


@query("store_fork", sql("select child, parent, at_version, t.version as tail from forks join tails t on t.stream = child"))
def store_fork(spark, d):
    store = ruled(spark, d)
    return store.control_df("forks").join(store.control_df("tails").select(F.col("stream").alias("child"), F.col("version").alias("tail")), "child")


@query("store_pins", sql("select stream, ceiling from pins"))
def store_pins(spark, d):
    return rows(spark, ruled(spark, d).state.pins().items(), "stream string, ceiling long")


@query("store_read", sql("select stream, version, event_type, data from guarded"))
def store_read(spark, d):
    return shown(guarded(ruled(spark, d)))


@query("store_history", sql("select c.root, c.depth, g.stream, g.version, g.event_type, g.data from chain c join guarded g on g.stream = c.seg and g.version < c.hi"))
def store_history(spark, d):
    store = ruled(spark, d)
    chain = visible.lineage(store.control_df("forks"), store.control_df("tails").select(F.col("stream").alias("root")))
    return shown(visible.history(guarded(store), chain), "root", "depth")


DEEPEST = "(select child from forks order by length(child) desc, child limit 1)"


@query("store_read_history", sql(f"select g.stream, g.version, g.event_type, g.data from chain c join guarded g on g.stream = c.seg and g.version < c.hi where c.root = {DEEPEST}"))
def store_read_history(spark, d):
    """One call for one stream: that of the longest chain of forks."""
    store = ruled(spark, d)
    children = sorted(store.state.forks, key=lambda c: (-len(c), c))
    return shown(store.read_history(children[0])) if children else shown(store.events_df([]))


@query("store_trim_below", sql("select stream, min(version) as first, count(*) as n from alls a where version >= coalesce((select floor from trims t where t.stream = a.stream), 0) group by stream"))
def store_trim_below(spark, d):
    store = ruled(spark, d)
    return visible.trimmed(store.events_df(), store.control_df("trims")).groupBy("stream").agg(F.min("version").alias("first"), F.count(F.lit(1)).alias("n"))


@query("store_trim_window", sql("select stream, max(version) as last, count(*) as n from alls where version < 25 or stream not in (select stream from rolled) group by stream"))
def store_trim_window(spark, d):
    store = ruled(spark, d)
    return visible.not_rolled_back(store.events_df(), store.control_df("rollbacks")).groupBy("stream").agg(F.max("version").alias("last"), F.count(F.lit(1)).alias("n"))


@query("store_delete", sql("select stream, count(*) as n from alls a where stream not in (select stream from deletes) or version <= (select ceiling from pins p where p.stream = a.stream) group by stream"))
def store_delete(spark, d):
    store = ruled(spark, d)
    return visible.not_deleted(store.events_df(), store.control_df("deletes"), store.control_df("forks")).groupBy("stream").agg(F.count(F.lit(1)).alias("n"))


@query("store_purge", sql("select a.stream, count(*) as n, cast(sum(a.version) as bigint) as versions from ev a where not (u % 25 = 0 and version < 4) group by a.stream"))
def store_purge(spark, d):
    store = loaded(spark, d)
    store.purge_many({s: 4 for s in store.list_streams() if int(s.split("-")[1]) % 25 == 0})
    return store.events_df().groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.sum("version").alias("versions"))


@query("store_merge_and_vacuum", "select n_regionkey as region, count(*) as n, 1 as files from nation group by n_regionkey")
def store_merge_and_vacuum(spark, d):
    """Files of single appends become one; a new handle reads it."""
    store, _ = regions_store(spark, d)
    store.merge_files()
    store.vacuum()
    again = EventStore(spark, store.log.root)
    return again.events_df().groupBy(F.substring_index("stream", "-", -1).cast("int").alias("region")).agg(F.count(F.lit(1)).alias("n"), F.lit(len(again.log.blobs.names("data"))).alias("files"))


@query("store_follow", "select 'user-' || user_id as stream, count(*) as n, count(*) - 1 as last from events group by user_id union all select 'region-' || n_regionkey, count(*), count(*) - 1 from nation group by n_regionkey")
def store_follow(spark, d):
    """A follower that starts after a bulk append, single appends, a merge and a vacuum."""
    from tidelog.streaming.follow import follow_streams

    store, _ = regions_store(spark, d)
    store.append_many(user_events(spark, d))
    store.merge_files()
    store.vacuum()
    return drained(follow_streams(spark, store.log.root)).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("last"))


def drained(stream: DataFrame) -> DataFrame:
    """What a streaming DataFrame gives now, by way of a file sink."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/drained-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


# -- a store of the nations, one append each ---------------------------------------------------------


def regions_store(spark: SparkSession, d: str, settings: S.Settings = S.Settings()) -> tuple[EventStore, list]:  # noqa: B008
    """Streams by region, a nation an event, appended one by one with the tail each expects; and the nations (key, name, region)."""
    store = new_store(spark, settings)
    nations = [tuple(r) for r in table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").toLocalIterator()]
    for key, name, region in nations:
        tail = store.stream_version(f"region-{region}")
        store.append(f"region-{region}", NO_STREAM if tail is None else exact(tail), [NewEvent.json("nation", {"key": key, "name": name})])
    return store, nations


NAT = "nat as (select 'region-' || n_regionkey as stream, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as version, cast(n_nationkey as bigint) as key, n_name as name, n_regionkey as region from nation), sizes as (select stream, count(*) as n from nat group by stream)"


def nat(body: str) -> str:
    return f"with {NAT} {body}"


def named(df: DataFrame, *more: str) -> DataFrame:
    body = F.from_json(F.col("data").cast("string"), "key long, name string")
    return df.withColumn("b", body).select("stream", "version", F.col("b.key").alias("key"), F.col("b.name").alias("name"), *more)


@query("store_append", nat("select stream, version, key, name, row_number() over (order by key) as global_seq from nat"))
def store_append(spark, d):
    store, _ = regions_store(spark, d)
    return named(store.events_df(), "global_seq")


@query("store_append_durable", nat("select stream, version, key, name from nat"))
def store_append_durable(spark, d):
    """Read by a handle that was opened before."""
    store = new_store(spark)
    other = EventStore(spark, store.log.root)
    for key, name, region in [tuple(r) for r in table(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name", "n_regionkey").toLocalIterator()]:
        store.append_durable(f"region-{region}", ANY, [NewEvent.json("nation", {"key": key, "name": name})])
    return named(other.events_df())


@query("store_in_memory", nat("select stream, version, key, name from nat"))
def store_in_memory(spark, d):
    store, made = EventStore.open_in_memory(spark), regions_store(spark, d)[1]
    by: dict[int, list] = {}
    for key, name, region in made:
        by.setdefault(region, []).append(NewEvent.json("nation", {"key": key, "name": name}))
    for region, events in by.items():
        store.append(f"region-{region}", NO_STREAM, events)
    found = [r for s in store.list_streams() for r in named(store.read_stream(s)).collect()]  # a few rows
    return rows(spark, [tuple(r) for r in found], "stream string, version long, key long, name string")


@query("store_append_lazy", nat("select stream, version, key, name, true as loose, true as seen from nat"))
def store_append_lazy(spark, d):
    """Lazy appends are seen by another handle before they are durable, and durable after the wait for the last."""
    store, nations = new_store(spark), regions_store(spark, d)[1]
    other, out = EventStore(spark, store.log.root), []
    for key, name, region in nations:
        ticket = store.append_lazy(f"region-{region}", ANY, [NewEvent.json("nation", {"key": key, "name": name})])
        out.append((f"region-{region}", ticket.info.last_version, key, name, ticket.position > store.durable, other.stream_version(f"region-{region}") == ticket.info.last_version))
    store.await_durable(ticket)
    assert store.durable >= ticket.position and not store.loose
    return rows(spark, out, "stream string, version long, key long, name string, loose boolean, seen boolean")


@query("store_await_durable", nat("select stream, n, true as durable from sizes"))
def store_await_durable(spark, d):
    store, nations = new_store(spark), regions_store(spark, d)[1]
    tickets = {f"region-{region}": store.append_lazy(f"region-{region}", ANY, [NewEvent.json("nation", name)]) for _, name, region in nations}
    for ticket in tickets.values():
        store.await_durable(ticket)
    return rows(spark, [(s, store.stream_version(s) + 1, t.position <= store.durable) for s, t in tickets.items()], "stream string, n long, durable boolean")


@query("store_lazy_conflicts", nat("select stream, version, key, name from nat where region <> 1 or version = 0"))
def store_lazy_conflicts(spark, d):
    """Region 1 is written with a stale expectation: its later appends are refused and take no other's with them."""
    store, nations = new_store(spark), regions_store(spark, d)[1]
    for key, name, region in nations:
        try:
            store.append_lazy(f"region-{region}", NO_STREAM if region == 1 else ANY, [NewEvent.json("nation", {"key": key, "name": name})])
        except S.VersionConflict:
            pass
    store.close()
    return named(EventStore(spark, store.log.root).events_df())


@query("store_unindexed", nat("select stream, min(case when key % 2 = 0 then version end) as first from nat group by stream"))
def store_unindexed(spark, d):
    """Appends of nations with odd keys write no time index, so a seek finds the first even one."""
    store, nations = new_store(spark), regions_store(spark, d)[1]
    for key, name, region in nations:
        store.append_with_token_lazy(f"region-{region}", ANY, [NewEvent.json("nation", name)], None, index_ts=key % 2 == 0)
    return rows(spark, [(s, store.seek_timestamp(s, 0)) for s in store.list_streams()], "stream string, first long")


@query("store_append_at", nat("select stream, version, key, case when version >= n - 2 then upper(name) || '!' else name end as name from nat join sizes using (stream)"))
def store_append_at(spark, d):
    """The last two versions of each stream are written again; the last write counts."""
    store, nations = regions_store(spark, d)
    for s in store.list_streams():
        tail = store.stream_version(s)
        last = [(k, n) for k, n, r in nations if f"region-{r}" == s][-2:]
        store.append_at(s, max(0, tail - 1), exact(tail), [NewEvent.json("nation", {"key": k, "name": n.upper() + "!"}) for k, n in last])
    return named(visible.lww(store.events_df()))


@query("store_append_with_token", nat("select stream, case when region % 2 = 0 then n + 1 else n end as n, case when region % 2 = 0 then 'appended' else 'fenced by w' || region end as said from sizes join (select distinct stream, region from nat) using (stream)"))
def store_append_with_token(spark, d):
    """Fences by region; writers of even regions bring the token, the others an old one."""
    store, _ = regions_store(spark, d)
    said = {}
    for s in store.list_streams():
        region = int(s.split("-")[1])
        store.fence(s, f"w{region}")
        try:
            store.append_with_token(s, ANY, [NewEvent("late", b"")], f"w{region}" if region % 2 == 0 else "old")
            said[s] = "appended"
        except S.FenceMismatch as e:
            said[s] = f"fenced by {e.current}"
    return rows(spark, [(s, store.stream_version(s) + 1, x) for s, x in said.items()], "stream string, n long, said string")


@query("store_fence", nat("select stream, case when region % 3 = 0 then null else 'second-' || region end as token from (select distinct stream, region from nat)"))
def store_fence(spark, d):
    """A second fence takes the place of the first; none lifts it."""
    store, _ = regions_store(spark, d)
    for s in store.list_streams():
        region = int(s.split("-")[1])
        store.fence(s, "first")
        store.fence(s, f"second-{region}" if region % 3 else None)
    return store.control_df("tails").select("stream").join(store.control_df("fences"), "stream", "left")


@query("store_transactions", nat("select stream, version, key, name from nat union all select 'all', row_number() over (order by key) - 1, key, name from nat where region % 2 = 0"))
def store_transactions(spark, d):
    """A transaction a nation, on its region's stream and a common one; those of odd regions append only the former, for the latter's expectation fails and they try again without."""
    store, nations = new_store(spark), regions_store(spark, d)[1]
    for key, name, region in nations:
        event = [NewEvent.json("nation", {"key": key, "name": name})]
        try:
            store.transaction().append(f"region-{region}", ANY, event).append("all", ANY if region % 2 == 0 else exact(10**6), event).commit()
        except S.VersionConflict:
            store.transaction().append(f"region-{region}", ANY, event).commit()
    return named(store.events_df())


@query("store_commit_retry", nat("select stream, version, key, name from nat"))
def store_commit_retry(spark, d):
    """Two handles write in turns, each behind by the other's commit: it reads the winner and commits after it."""
    store, nations = new_store(spark), regions_store(spark, d)[1]
    handles = [store, EventStore(spark, store.log.root, lambda: NOW)]
    for i, (key, name, region) in enumerate(nations):
        handle = handles[i % 2]
        rows_, commit, _ = handle._plan(handle.state, [("append", f"region-{region}", None, ANY, [NewEvent("lost", b"")], None, True)])
        assert rows_ and (handle.state.position == i or not handle.log.publish(handle.state.position, commit))  # the place is taken
        handle.append(f"region-{region}", ANY, [NewEvent.json("nation", {"key": key, "name": name})])
    return named(store.events_df())


@query("store_serial_isolation", nat("select stream, n, n - 1 as conflicts from sizes"))
def store_serial_isolation(spark, d):
    """Every nation's writer expects an empty stream or, once refused, the tail it is told: one success each, one conflict for each that is not first."""
    store, nations = new_store(spark), regions_store(spark, d)[1]
    refused: dict[str, int] = {}
    for _, name, region in nations:
        s = f"region-{region}"
        try:
            store.append(s, NO_STREAM, [NewEvent.json("nation", name)])
        except S.VersionConflict as e:
            refused[s] = refused.get(s, 0) + 1
            store.append(s, exact(e.actual), [NewEvent.json("nation", name)])
    return rows(spark, [(s, store.stream_version(s) + 1, refused.get(s, 0)) for s in store.list_streams()], "stream string, n long, conflicts long")


@query("store_errors", nat("select stream, 'VersionConflict' as error, n - 1 as actual from sizes union all select stream, 'FenceMismatch', null from sizes union all select stream, 'InvalidInput', null from sizes"))
def store_errors(spark, d):
    store, _ = regions_store(spark, d)
    out = []
    for s in store.list_streams():
        store.fence(s, "held")
        event = [NewEvent("e", b"")]
        for call in (lambda s=s: store.append(s, exact(10**6), event), lambda s=s: store.append_with_token(s, ANY, event, "other"), lambda s=s: store.append(s, ANY, [])):
            try:
                call()
            except S.StoreError as e:
                out.append((s, type(e).__name__, getattr(e, "actual", None)))
    return rows(spark, out, "stream string, error string, actual long")


@query("store_settings", nat("select count(*) as commits, count(*) // 4 as kept, 'SNAPPY' as codec from nat"))
def store_settings(spark, d):
    import pyarrow as pa
    import pyarrow.parquet as pq

    store, _ = regions_store(spark, d, S.Settings(checkpoint_every=4, compression="snappy"))
    blobs = store.log.blobs
    codecs = {pq.ParquetFile(pa.BufferReader(blobs.read(f"data/{n}"))).metadata.row_group(0).column(0).compression for n in blobs.names("data")}
    return rows(spark, [(store.state.position, len(blobs.names("_checkpoints")), "+".join(codecs))], "commits long, kept long, codec string")


@query("store_close", nat("select stream, n from sizes"))
def store_close(spark, d):
    """Lazy appends and a follower, then close: all is durable and the query has stopped."""
    store, nations = new_store(spark), regions_store(spark, d)[1]
    for _, name, region in nations:
        store.append_lazy(f"region-{region}", ANY, [NewEvent.json("nation", name)])
    at = f"{shared_dir(spark)}/closing-{uuid.uuid4().hex}"
    q = store.follow(at, lambda df, _: df.count())
    store.close()
    assert not q.isActive and not store.loose
    again = EventStore(spark, store.log.root)
    return rows(spark, [(s, v + 1) for s, (v, _) in again.state.tails.items()], "stream string, n long")


@query("store_metered", nat("select stream, n * 2 as created, n as names from sizes"))
def store_metered(spark, d):
    """Calls to the file system by phase: each append creates a data file and a commit."""
    store, nations = new_store(spark), regions_store(spark, d)[1]
    out = []
    for region in sorted({r for _, _, r in nations}):
        store.log.blobs.meter.reset()
        for _, name, r in nations:
            if r == region:
                store.append(f"region-{region}", ANY, [NewEvent.json("nation", name)])
        figures = store.log.blobs.meter.reset()
        out.append((f"region-{region}", figures["create"][0], figures["create"][0] // 2))
    return rows(spark, out, "stream string, created long, names long")


@query("reader_handle", nat("select 'slow' as handle, stream, 1 as n from sizes union all select 'quick', stream, n from sizes union all select 'refreshed', stream, n from sizes"))
def reader_handle(spark, d):
    """A reader sees what there was when it last looked, which its poll interval bounds."""
    store, nations = new_store(spark), regions_store(spark, d)[1]
    later = []
    for _, name, region in nations:
        event = [NewEvent.json("nation", name)]
        if store.stream_version(f"region-{region}") is None:
            store.append(f"region-{region}", ANY, event)
        else:
            later.append((f"region-{region}", event))
    slow, quick = (EventStoreReader(spark, store.log.root, S.Settings(poll_ms=ms)) for ms in (3_600_000, 0))
    for s, event in later:
        store.append(s, ANY, event)
    count = lambda handle, name: [(name, r["stream"], r["n"]) for r in handle.events_df().groupBy("stream").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]
    found = [*count(slow, "slow"), *count(quick, "quick")]
    slow.refresh()
    return rows(spark, [*found, *count(slow, "refreshed")], "handle string, stream string, n long")


# -- folds, snapshots and jobs -----------------------------------------------------------------------


class Keys:
    """An aggregate: the sum of the keys, and how many there were."""

    def __init__(self, total: int = 0, n: int = 0):
        self.total, self.n = total, n

    def apply(self, event) -> None:
        import json

        self.total, self.n = self.total + json.loads(bytes(event.data))["key"], self.n + 1

    def snapshot(self) -> bytes:
        return f"{self.total},{self.n}".encode()

    @classmethod
    def restore(cls, data: bytes) -> Keys:
        return cls(*map(int, data.decode().split(",")))


KEYS = "cast(sum(key) as bigint) || ',' || count(*)"


def snapshots(store: EventStore) -> DataFrame:
    """stream, through, state of the last snapshot of each stream."""
    last = [(s, x["through_version"], bytes.fromhex(x["state"]).decode()) for s in sorted(store.state.tails) if (x := store.latest_snapshot(s))]
    return rows(store.spark, last, "stream string, through long, state string")


@query("store_fold", nat("select stream, max(version) as version, cast(sum(key) as bigint) as total from nat group by stream"))
def store_fold(spark, d):
    import json

    store, _ = regions_store(spark, d)
    found = [(s, *store.fold(s, 0, lambda x, e: x + json.loads(bytes(e["data"]))["key"])[::-1]) for s in store.list_streams()]
    return rows(spark, found, "stream string, version long, total long")


@query("store_rehydrate", nat("select stream, max(version) as version, cast(sum(key) as bigint) as total, count(*) as n from nat group by stream"))
def store_rehydrate(spark, d):
    """From a snapshot of the first half for even regions, from nothing for odd ones."""
    store, nations = regions_store(spark, d)
    out = []
    for s in store.list_streams():
        mine = [k for k, _, r in nations if f"region-{r}" == s]
        half = len(mine) // 2
        if int(s.split("-")[1]) % 2 == 0 and half:
            store.publish_snapshot(s, half - 1, half, Keys(sum(mine[:half]), half).snapshot())
        state, version = store.rehydrate(Keys, s)
        out.append((s, version, state.total, state.n))
    return rows(spark, out, "stream string, version long, total long, n long")


@query("store_aggregate", nat(f"select stream, {KEYS} as state, max(version) as version from nat group by stream"))
def store_aggregate(spark, d):
    """The same aggregate for all streams at once, a task a group of streams."""
    from tidelog.operators.fold import python_fold

    store, _ = regions_store(spark, d)
    return python_fold(guarded(store), Keys).select("stream", F.col("state").cast("string").alias("state"), "version")


@query("store_compact", nat(f"select stream, max(version) as through, {KEYS} as state from nat group by stream"))
def store_compact(spark, d):
    store, _ = regions_store(spark, d)
    for s in store.list_streams():
        store.compact(Keys, s)
    return snapshots(store)


@query("store_compact_after_purge", nat(f"select stream, max(version) as through, {KEYS} as state from nat group by stream"))
def store_compact_after_purge(spark, d):
    """A snapshot of the first events, these purged, and a compaction that goes on from it."""
    store, nations = regions_store(spark, d)
    for s in store.list_streams():
        mine = [k for k, _, r in nations if f"region-{r}" == s]
        half = len(mine) // 2
        if half:
            store.publish_snapshot(s, half - 1, half, Keys(sum(mine[:half]), half).snapshot())
            store.purge_below(s, half)
        store.compact(Keys, s)
    return snapshots(store)


@query("store_compact_with", nat("select stream, max(version) as through, string_agg(name, '|' order by version) as state from nat group by stream"))
def store_compact_with(spark, d):
    import json

    store, _ = regions_store(spark, d)
    for s in store.list_streams():
        store.compact_with(s, lambda events: "|".join(json.loads(bytes(e["data"]))["name"] for e in events).encode())
    return snapshots(store)


@query("store_publish_snapshot", nat("select stream, n // 2 as through, 'at ' || (n // 2) as state from sizes"))
def store_publish_snapshot(spark, d):
    """The last one published counts, though it reaches less far."""
    store, _ = regions_store(spark, d)
    for s in store.list_streams():
        n = store.stream_version(s) + 1
        for through in (n - 1, n // 2):
            store.publish_snapshot(s, through, through + 1, f"at {through}".encode())
    return snapshots(store)


@query("store_flatten", sql(f"select c.root as stream, max(g.version) as through, cast(count(*) as varchar) as state from chain c join guarded g on g.stream = c.seg and g.version < c.hi where c.root = {DEEPEST} group by c.root"))
def store_flatten(spark, d):
    """A fork's whole lineage becomes one snapshot of the fork, so that it no longer needs its ancestors."""
    store = ruled(spark, d)
    children = sorted(store.state.forks, key=lambda c: (-len(c), c))
    out = []
    for child in children[:1]:
        record = store.compact_with(child, lambda events: str(sum(1 for _ in events)).encode())
        out.append((child, record["through_version"], bytes.fromhex(store.latest_snapshot(child)["state"]).decode()))
    return rows(spark, out, "stream string, through long, state string")


@query("store_compaction_records", nat("select row_number() over (order by stream) as nth, stream, n - 1 as through, n as events from sizes"))
def store_compaction_records(spark, d):
    store, _ = regions_store(spark, d)
    for s in store.list_streams():
        store.compact(Keys, s)
    return rows(spark, [(i, c["stream"], c["through_version"], c["events_compacted"]) for i, c in enumerate(store.compaction_records(), 1)], "nth long, stream string, through long, events long")


@query("store_follow_compactions", nat("select stream, n - 1 as through_version, n as events_compacted from sizes"))
def store_follow_compactions(spark, d):
    from tidelog.streaming.follow import follow_compactions

    store, _ = regions_store(spark, d)
    for s in store.list_streams():
        store.compact(Keys, s)
    return drained(follow_compactions(spark, store.log.root)).select("stream", "through_version", "events_compacted")


@query("store_backlog", nat("select stream, n - case when region % 2 = 0 then n // 2 else 0 end as backlog from sizes join (select distinct stream, region from nat) using (stream)"))
def store_backlog(spark, d):
    store, _ = regions_store(spark, d)
    for s in store.list_streams():
        half = (store.stream_version(s) + 1) // 2
        if int(s.split("-")[1]) % 2 == 0 and half:
            store.publish_snapshot(s, half - 1, half, b"")
    return rows(spark, [(s, store.compaction_backlog(s)) for s in store.list_streams()], "stream string, backlog long")


@once
def jobs(spark: SparkSession, d: str) -> list[tuple]:
    """A job a region and what becomes of it by the region's number: left, claimed, failed, completed; a second claim is refused."""
    store, out = regions_store(spark, d)[0], []
    for s in store.list_streams():
        region, job = int(s.split("-")[1]), store.request_compaction(s)
        refused = False
        if region % 4:
            store.claim_compaction(job, f"worker {region}")
            try:
                store.claim_compaction(job, "another")
            except S.InvalidInput:
                refused = True
        if region % 4 == 2:
            store.fail_compaction(job, f"no room for {s}")
        if region % 4 == 3:
            store.compact_job(job, Keys, s)
        found = EventStore(spark, store.log.root).job_status(job)
        out.append((s, found["status"], found.get("worker"), found.get("error"), refused))
    return out


REGIONS = "(select distinct stream, region from nat)"


@query("store_request_compaction", nat(f"select stream, 'pending' as status from {REGIONS} where region % 4 = 0"))
def store_request_compaction(spark, d):
    return rows(spark, [(s, x) for s, x, *_ in jobs(spark, d) if int(s.split("-")[1]) % 4 == 0], "stream string, status string")


@query("store_claim_compaction", nat(f"select stream, case when region % 4 = 1 then 'worker ' || region end as worker, region % 4 > 0 as refused from {REGIONS}"))
def store_claim_compaction(spark, d):
    return rows(spark, [(s, w, r) for s, _, w, _, r in jobs(spark, d)], "stream string, worker string, refused boolean")


@query("store_fail_compaction", nat(f"select stream, case when region % 4 = 2 then 'no room for ' || stream end as error from {REGIONS}"))
def store_fail_compaction(spark, d):
    return rows(spark, [(s, e) for s, _, _, e, _ in jobs(spark, d)], "stream string, error string")


@query("store_compact_job", nat(f"select stream, ['pending', 'claimed', 'failed', 'completed'][1 + region % 4] as status from {REGIONS}"))
def store_compact_job(spark, d):
    return rows(spark, [(s, x) for s, x, *_ in jobs(spark, d)], "stream string, status string")


# -- records of older logs, and small helpers --------------------------------------------------------


@query("legacy_envelopes", "select 'user-' || user_id as stream, event_id as version, event_id + 1 as global_seq, event_type, props as data, 'k=' || user_id as metadata from events")
def legacy_envelopes(spark, d):
    """Events written as the JSON envelopes of an older log, and read."""
    e = table(spark, d, "events")
    body = F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"), F.col("event_id").alias("version"), (F.col("event_id") + 1).alias("seq"), F.base64(F.col("props").cast("binary")).alias("data"), F.array(F.array(F.lit("k"), F.base64(F.col("user_id").cast("string").cast("binary")))).alias("metadata"), F.lit(NOW).alias("ts_ms"))
    found = envelope.events(e.select(F.concat(F.lit("user-"), "user_id").alias("stream"), F.to_json(body).cast("binary").alias("value")))
    pair = F.col("metadata")[0]
    return shown(found, "global_seq", F.concat(pair["name"], F.lit("="), pair["value"].cast("string")).alias("metadata"))


@query("new_events", nat("select stream, version, 'nation' as event_type, name, 'n' || key as note from nat"))
def new_events(spark, d):
    """Events with metadata, and JSON bodies from any value."""
    store, nations = new_store(spark), regions_store(spark, d)[1]
    for key, name, region in nations:
        store.append(f"region-{region}", ANY, [NewEvent.json("nation", [name, {"deep": None}], (("note", f"n{key}".encode()), ("note", b"twice")))])
    body = F.from_json(F.col("data").cast("string"), "array<string>")[0]
    return store.events_df().select("stream", "version", "event_type", body.alias("name"), F.col("metadata")[0]["value"].cast("string").alias("note"))


@query("now_ms", nat("select stream, n, 0::bigint as off from sizes"))
def now_ms(spark, d):
    """Times come from the clock unless a stream's last is later."""
    now = [NOW]
    store, nations = EventStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", lambda: now[0]), regions_store(spark, d)[1]
    want: dict[str, list[int]] = {}
    for i, (_, name, region) in enumerate(nations):
        now[0] = NOW + (i * 37) % 100
        store.append(f"region-{region}", ANY, [NewEvent.json("nation", name)])
        mine = want.setdefault(f"region-{region}", [])
        mine.append(max([now[0], *mine]))
    found = store.events_df().groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("version", "ts_ms"))).alias("t")).select("stream", "t.ts_ms")
    return rows(spark, [(r["stream"], len(r["ts_ms"]), sum(a != b for a, b in zip(r["ts_ms"], want[r["stream"]], strict=True))) for r in found.toLocalIterator()], "stream string, n long, off long")


@query("base64_helpers", "select event_id, props as data, octet_length(encode(props)) as n from events")
def base64_helpers(spark, d):
    """Bytes inside JSON deltas, there and back."""
    from tidelog.functions import fsimage

    def run(batches):
        import pandas as pd

        for pdf in batches:
            found = [fsimage.decode(fsimage.encode({"op": "write", "inline": p.encode()}))["inline"] for p in pdf["props"]]
            yield pd.DataFrame({"event_id": pdf["event_id"], "data": [x.decode() for x in found], "n": [len(x) for x in found]})

    return table(spark, d, "events").select("event_id", "props").mapInPandas(run, "event_id long, data string, n long")
