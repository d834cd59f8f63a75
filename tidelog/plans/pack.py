"""The query pack: each operator of the event log over the synthetic tables, with DuckDB SQL beside it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import files, pages
from tidelog.operators import fold, visible
from tidelog.plans.registry import query, table
from tidelog.session import settle

class Log:
    """The event log read from `events`, and control tables by formula on the user's number."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        e = table(spark, sf_dir, "events")
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        # every use reads the numbered events, so the window over them runs once
        self.ev = settle(e.select(
            F.concat(F.lit("user-"), F.col("user_id")).alias("stream"),
            (F.row_number().over(order) - 1).cast("long").alias("version"),
            (F.col("event_id") + 1).alias("global_seq"),
            "event_type",
            F.col("props").alias("data"),
            F.round(F.col("value") * 100).cast("long").alias("cents"),
            F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ts_ms"),
            F.col("user_id").alias("u"),
        ), "pack-events")
        self.users = self.ev.select("u").distinct()
        name = lambda prefix: F.concat(F.lit(prefix), F.col("u"))
        self.trims = self.users.where("u % 5 = 0").select(name("user-").alias("stream"), F.lit(5).cast("long").alias("floor"))
        self.deletes = self.users.where("u % 11 = 0").select(name("user-").alias("stream")).unionAll(self.users.where("u % 33 = 0").select(name("fork-").alias("stream")))
        at = lambda v: F.lit(v).cast("long").alias("at_version")
        self.forks = self.users.where("u % 3 = 0").select(name("fork-").alias("child"), name("user-").alias("parent"), at(10)).unionAll(self.users.where("u % 9 = 0").select(name("fork2-").alias("child"), name("fork-").alias("parent"), at(12)))
        self.rollbacks = self.ev.where("u % 7 = 0 and version = 24").select("stream", F.lit(20).cast("long").alias("from_version"), F.col("global_seq").alias("txn"))
        moved = lambda prefix, keep, first, shift: self.ev.where(f"version >= 30 and {keep}").withColumn("stream", F.concat(F.lit(prefix), F.col("u"))).withColumn("version", F.col("version") - 30 + first).withColumn("global_seq", F.col("global_seq") + shift)
        self.all = self.ev.unionAll(moved("fork-", "u % 3 = 0", 11, 10**9)).unionAll(moved("fork2-", "u % 9 = 0", 13, 2 * 10**9))
        snap = self.ev.where("version <= 19").groupBy("stream").agg(F.sum("cents").alias("state"), F.max("version").alias("through_version"))
        self.snapshots = snap.select("stream", F.lit(1).cast("long").alias("snap_seq"), "through_version", "state")

    def guarded(self, events: DataFrame) -> DataFrame:
        return visible.guarded(events, self.trims, self.rollbacks, self.deletes, self.forks)

    def chain(self) -> DataFrame:
        return visible.lineage(self.forks, visible.tails(self.all).select(F.col("stream").alias("root")))


EV = """ev as (select 'user-' || user_id as stream, row_number() over (partition by user_id order by ts, event_id) - 1 as version,
  event_id + 1 as global_seq, event_type, props as data, cast(round(value * 100) as bigint) as cents, epoch_us(ts) // 1000 as ts_ms, user_id as u from events),
users as (select distinct user_id as u from events),
trims as (select 'user-' || u as stream, 5 as floor from users where u % 5 = 0),
deletes as (select 'user-' || u as stream from users where u % 11 = 0 union all select 'fork-' || u from users where u % 33 = 0),
forks as (select 'fork-' || u as child, 'user-' || u as parent, 10 as at_version from users where u % 3 = 0
  union all select 'fork2-' || u, 'fork-' || u, 12 from users where u % 9 = 0),
rollbacks as (select stream, 20 as from_version, global_seq as txn from ev where u % 7 = 0 and version = 24),
alls as (select * from ev
  union all select 'fork-' || u, version - 30 + 11, global_seq + 1000000000, event_type, data, cents, ts_ms, u from ev where version >= 30 and u % 3 = 0
  union all select 'fork2-' || u, version - 30 + 13, global_seq + 2000000000, event_type, data, cents, ts_ms, u from ev where version >= 30 and u % 9 = 0),
pins as (select parent as stream, max(at_version) as ceiling from forks where child not in (select stream from deletes) group by parent),
guarded as (select a.* from alls a where version >= coalesce((select floor from trims t where t.stream = a.stream), 0)
  and not exists (select 1 from rollbacks r where r.stream = a.stream and a.version >= r.from_version and a.global_seq > r.txn)
  and (a.stream not in (select stream from deletes) or a.version <= (select ceiling from pins p where p.stream = a.stream))),
snaps as (select stream, max(version) as through_version, cast(sum(cents) as bigint) as state from ev where version <= 19 group by stream),
tails as (select stream, max(version) as version, arg_max(ts_ms, version) as ts_ms from alls group by stream)"""

CHAIN = """chain as (
  select distinct stream as root, stream as seg, 9223372036854775807 as hi, 0 as depth from alls
  union all select c.root, f.parent, least(c.hi, f.at_version + 1), c.depth + 1 from chain c join forks f on f.child = c.seg)"""

COLS = "stream, version, global_seq, event_type, data, cents, ts_ms"
C = COLS.split(", ")


def sql(body: str, chain: bool = False) -> str:
    return f"with recursive {EV}" + (f", {CHAIN}" if chain else "") + f" {body}"


@query("event_log", sql(f"select {COLS} from ev"))
def event_log(spark, d):
    return Log(spark, d).ev.select(*C)


@query("json_payload", sql("select stream, version, cast(json_extract(data, '$.k') as bigint) as k from ev"))
def json_payload(spark, d):
    return Log(spark, d).ev.select("stream", "version", F.from_json("data", "k long")["k"].alias("k"))


@query("ts_monotone", sql("select stream, version, max(ts_ms) over (partition by stream order by version) as ts_ms from ev"))
def ts_monotone(spark, d):
    return visible.monotone_ts(Log(spark, d).ev).select("stream", "version", "ts_ms")


@query("read_range", sql(f"select {COLS} from ev where version >= 10 and version < 25"))
def read_range(spark, d):
    return visible.in_range(Log(spark, d).ev, *visible.bounds(10, 24, hi_closed=True)).select(*C)


@query("read_trimmed", sql(f"select {COLS} from ev where version >= coalesce((select floor from trims t where t.stream = ev.stream), 0)"))
def read_trimmed(spark, d):
    log = Log(spark, d)
    return visible.trimmed(log.ev, log.trims).select(*C)


@query("read_rollback", sql(f"select {COLS} from ev where not exists (select 1 from rollbacks r where r.stream = ev.stream and ev.version >= r.from_version and ev.global_seq > r.txn)"))
def read_rollback(spark, d):
    log = Log(spark, d)
    return visible.not_rolled_back(log.ev, log.rollbacks).select(*C)


@query("read_deleted", sql(f"select {COLS} from alls a where a.stream not in (select stream from deletes) or a.version <= (select ceiling from pins p where p.stream = a.stream)"))
def read_deleted(spark, d):
    log = Log(spark, d)
    return visible.not_deleted(log.all, log.deletes, log.forks).select(*C)


@query("read_guarded", sql(f"select {COLS} from guarded"))
def read_guarded(spark, d):
    log = Log(spark, d)
    return log.guarded(log.all).select(*C)


SHADOW = "shadow as (select *, global_seq as commit_pos from ev union all select stream, version, global_seq + 3000000000, event_type || '!', data, cents + 1, ts_ms, u, global_seq + 3000000000 from ev where u % 4 = 0 and version >= 15)"


@query("shadow_lww", f"with {EV}, {SHADOW} select {COLS} from shadow qualify row_number() over (partition by stream, version order by commit_pos desc) = 1")
def shadow_lww(spark, d):
    ev = Log(spark, d).ev.withColumn("commit_pos", F.col("global_seq"))
    again = ev.where("u % 4 = 0 and version >= 15").withColumns({"global_seq": F.col("global_seq") + 3 * 10**9, "commit_pos": F.col("commit_pos") + 3 * 10**9, "event_type": F.concat("event_type", F.lit("!")), "cents": F.col("cents") + 1})
    return visible.lww(ev.unionAll(again)).select(*C)


@query("lineage", sql("select root, seg, hi, depth from chain", True))
def lineage(spark, d):
    return Log(spark, d).chain()


HISTORY = "select c.root, c.depth, g.stream, g.version, g.global_seq, g.event_type, g.cents from chain c join guarded g on g.stream = c.seg and g.version < c.hi"


@query("history", sql(HISTORY, True))
def history(spark, d):
    log = Log(spark, d)
    return visible.history(log.guarded(log.all), log.chain()).select("root", "depth", "stream", "version", "global_seq", "event_type", "cents")


@query("history_range", sql(HISTORY + " where g.version >= 8 and g.version < 16", True))
def history_range(spark, d):
    log = Log(spark, d)
    return visible.history(log.guarded(log.all), log.chain(), 8, 16).select("root", "depth", "stream", "version", "global_seq", "event_type", "cents")


@query("reader_history", sql(HISTORY.replace("g.event_type", "case when g.event_type = 'error' then '$error' else g.event_type end as event_type", 1) + " where g.event_type <> 'error'", True))
def reader_history(spark, d):
    log = Log(spark, d)
    marked = log.all.withColumn("event_type", F.when(F.col("event_type") == "error", "$error").otherwise(F.col("event_type")))
    return visible.without_system(visible.history(log.guarded(marked), log.chain())).select("root", "depth", "stream", "version", "global_seq", "event_type", "cents")


@query("stream_version_writer", sql("select stream, version from tails"))
def stream_version_writer(spark, d):
    return visible.tails(Log(spark, d).all).select("stream", "version")


@query("stream_version_reader", sql("select stream, max(version) as version from guarded group by stream"))
def stream_version_reader(spark, d):
    log = Log(spark, d)
    return visible.reader_version(log.guarded(log.all))


@query("check_tail", sql("select stream, version, ts_ms from tails"))
def check_tail(spark, d):
    return visible.tails(Log(spark, d).all)


@query("list_streams", sql("select stream from tails where stream not in (select stream from deletes)"))
def list_streams(spark, d):
    log = Log(spark, d)
    return visible.list_streams(visible.tails(log.all), log.deletes)


@query("read_tail", sql("select g.stream, g.version, g.cents from guarded g join tails t on t.stream = g.stream where g.version >= greatest(t.version + 1 - 7, 0)"))
def read_tail(spark, d):
    log = Log(spark, d)
    return visible.read_tail(log.guarded(log.all), visible.tails(log.all), 7).select("stream", "version", "cents")


@query(
    "read_page",
    sql("""select stream, version, case when last < final then last + 1 end as cursor from (
      select *, max(version) over (partition by stream) as last from (
        select *, max(version) over (partition by stream) as final, row_number() over (partition by stream order by version) as rn,
               sum(octet_length(encode(data))) over (partition by stream order by version) as size from guarded where version >= 3)
      where rn = 1 or (rn <= 12 and size <= 90))"""),
)
def read_page(spark, d):
    log = Log(spark, d)
    return visible.read_page(log.guarded(log.all), 3, 12, 90).select("stream", "version", "cursor")


@query("seek_timestamp", sql("select stream, arg_min(version, (ts_ms, version)) as version, min(ts_ms) as ts_ms from ev, (select (min(epoch_us(ts) // 1000) + max(epoch_us(ts) // 1000)) // 2 as mid from events) where ts_ms >= mid group by stream"))
def seek_timestamp(spark, d):
    log = Log(spark, d)
    mid = log.ev.agg(F.expr("(min(ts_ms) + max(ts_ms)) div 2")).first()[0]
    return visible.seek_timestamp(log.ev, mid)


@query("balance_fold", sql("select root as stream, cast(sum(cents) as bigint) as state, max(version) as version from (" + HISTORY + ") group by root", True))
def balance_fold(spark, d):
    log = Log(spark, d)
    rows = visible.history(log.guarded(log.all), log.chain())
    return fold.sum_fold(rows, F.col("cents"), "root").withColumnRenamed("root", "stream")


DELTA = "case when event_type in ('purchase', 'error') then -2 * cents else cents end"


@query("ordered_fold", sql(f"select stream, list_reduce(list({DELTA} order by version), lambda s, x: greatest(0::bigint, s + x), 0::bigint) as state, max(version) as version from guarded group by stream"))
def ordered_fold(spark, d):
    log = Log(spark, d)
    rows = log.guarded(log.all).withColumn("delta", F.expr(DELTA))
    return fold.ordered_fold(rows, F.lit(0).cast("long"), lambda s, x: F.greatest(F.lit(0).cast("long"), s + x["delta"]), ["delta"])


@query("rehydrate", sql("select e.stream, cast(any_value(s.state) + coalesce(sum(e.cents) filter (e.version > s.through_version), 0) as bigint) as state, max(e.version) as version from ev e join snaps s on s.stream = e.stream group by e.stream"))
def rehydrate(spark, d):
    log = Log(spark, d)
    return fold.rehydrate_sum(log.snapshots, log.ev, F.col("cents"))


@query("backlog", sql("select t.stream, greatest(t.version + 1 - coalesce(s.through_version + 1, 0), 0) as backlog from tails t left join snaps s on s.stream = t.stream"))
def backlog(spark, d):
    log = Log(spark, d)
    return fold.backlog(visible.tails(log.all), log.snapshots)


PUBLISHED = "published as (select stream, global_seq as snap_seq, version as through_version, cents as state from ev where event_type = 'signup')"


@query("latest_snapshot", f"with {EV}, {PUBLISHED} select stream, max(snap_seq) as snap_seq, arg_max(through_version, snap_seq) as through_version, arg_max(state, snap_seq) as state from published group by stream")
def latest_snapshot(spark, d):
    rows = Log(spark, d).ev.where("event_type = 'signup'").select("stream", F.col("global_seq").alias("snap_seq"), F.col("version").alias("through_version"), F.col("cents").alias("state"))
    return fold.latest_snapshots(rows)


JOURNAL = """journal as (select event_id as pos, 'job-' || (event_id % 997) as job_id, case event_type when 'click' then 'claimed' when 'error' then 'failed' else 'requested' end as type,
  'w' || user_id as worker, props as error from events), done as (select distinct 'job-' || (event_id % 997) as job_id from events where event_type = 'signup' and user_id % 4 = 0)"""


@query(
    "job_status",
    f"""with {JOURNAL}, last as (select job_id, max(pos) as pos, arg_max(type, pos) as type, arg_max(worker, pos) as worker, arg_max(error, pos) as error from journal group by job_id),
    states as (select l.*, case when d.job_id is not null then 'completed' when type = 'requested' then 'pending' else type end as status from last l left join done d on d.job_id = l.job_id)
    select job_id, status, case when status = 'claimed' then worker end as worker, case when status = 'failed' then error end as error from states""",
)
def job_status(spark, d):
    e = table(spark, d, "events").withColumn("job_id", F.concat(F.lit("job-"), F.col("event_id") % 997))
    kind = F.when(F.col("event_type") == "click", "claimed").when(F.col("event_type") == "error", "failed").otherwise("requested")
    journal = e.select(F.col("event_id").alias("pos"), "job_id", kind.alias("type"), F.concat(F.lit("w"), F.col("user_id")).alias("worker"), F.col("props").alias("error"))
    return fold.job_status(journal, e.where("event_type = 'signup' and user_id % 4 = 0").select("job_id"))


REQUESTS = "requests as (select 'user-' || u as stream, ['any', 'none', 'exact'][1 + u % 3] as expected, case when u % 3 = 2 then 50 + u % 37 end as expected_version from users union all select 'new-' || u, ['any', 'none', 'exact'][1 + u % 3], case when u % 3 = 2 then 0 end from users)"


@query("occ_check", f"with {EV}, {REQUESTS} select r.stream, expected, expected_version, t.version as actual, coalesce(expected = 'any' or (expected = 'none' and t.version is null) or (expected = 'exact' and t.version is not distinct from expected_version), false) as ok from requests r left join tails t on t.stream = r.stream")
def occ_check(spark, d):
    log = Log(spark, d)
    kind = F.element_at(F.array(F.lit("any"), F.lit("none"), F.lit("exact")), (F.col("u") % 3 + 1).cast("int")).alias("expected")
    at = lambda v: F.when(F.col("u") % 3 == 2, v).cast("long").alias("expected_version")
    requests = log.users.select(F.concat(F.lit("user-"), F.col("u")).alias("stream"), kind, at(50 + F.col("u") % 37)).unionAll(log.users.select(F.concat(F.lit("new-"), F.col("u")).alias("stream"), kind, at(F.lit(0))))
    return visible.check_expected(requests, visible.tails(log.all))


@query("fence_check", f"with {EV} select 'user-' || u as stream, case when u % 5 > 0 then 'w' || (u % 8) end as token, case when u % 4 = 0 then 'w' || (u % 16) end as current, (u % 5 = 0 or u % 4 > 0 or u % 8 = u % 16) as ok from users")
def fence_check(spark, d):
    users = Log(spark, d).users
    name = F.concat(F.lit("user-"), F.col("u")).alias("stream")
    fences = users.where("u % 4 = 0").select(name, F.concat(F.lit("w"), F.col("u") % 16).alias("token"))
    return visible.check_fence(users.select(name, F.when(F.col("u") % 5 > 0, F.concat(F.lit("w"), F.col("u") % 8)).alias("token")), fences)


@query("batch_caps", sql("select stream, version // 40 as batch, count(*) as records, max(octet_length(encode(data))) as largest, count(*) <= 39 and max(octet_length(encode(data))) <= 9 as ok from ev group by all"))
def batch_caps(spark, d):
    batches = Log(spark, d).ev.groupBy("stream", F.expr("version div 40").alias("batch"))
    rows = batches.agg(F.count(F.lit(1)).alias("records"), F.max(F.octet_length("data")).cast("long").alias("largest"))
    return rows.withColumn("ok", (F.col("records") <= 39) & (F.col("largest") <= 9))


@query("purge_preview", sql("select t.stream, cast(coalesce(p.ceiling + 1, 0) as bigint) as lo, 15::bigint as hi, (select count(*) from alls a where a.stream = t.stream and a.version >= coalesce(p.ceiling + 1, 0) and a.version < 15) as purged from tails t left join pins p on p.stream = t.stream"))
def purge_preview(spark, d):
    log = Log(spark, d)
    spans = visible.purge_range(visible.tails(log.all).select("stream"), log.forks, log.deletes, 15)
    hit = log.all.join(spans, "stream").where("version >= lo and version < hi").groupBy("stream").agg(F.count(F.lit(1)).alias("purged"))
    return spans.join(hit, "stream", "left").select("stream", "lo", "hi", F.coalesce("purged", F.lit(0)).alias("purged"))


@query("blocks", "select doc_id, i as block, sha256(array_slice(encode(text), i * 1024 + 1, (i + 1) * 1024)) as hash, least(1024, octet_length(encode(text)) - i * 1024) as len from documents, unnest(range((octet_length(encode(text)) + 1023) // 1024)) as t(i)")
def blocks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return files.split_blocks(docs, "doc_id", "content", 1024).select("doc_id", "block", "hash", "len")


@query("block_dedup", "select hash, any_value(len) as len, count(*) as refs from (select sha256(array_slice(encode(text), i * 1024 + 1, (i + 1) * 1024)) as hash, least(1024, octet_length(encode(text)) - i * 1024) as len from documents, unnest(range((octet_length(encode(text)) + 1023) // 1024)) as t(i)) group by hash")
def block_dedup(spark, d):
    return blocks(spark, d).groupBy("hash").agg(F.first("len").alias("len"), F.count(F.lit(1)).alias("refs"))


@query("range_overlap", "select doc_id, i as block from documents, unnest(range((octet_length(encode(text)) + 1023) // 1024)) as t(i) where least((i + 1) * 1024, octet_length(encode(text))) > 1500 and i * 1024 < 1500 + 2000")
def range_overlap(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return files.overlapping(files.split_blocks(docs, "doc_id", "content", 1024), "doc_id", 1500, 2000).select("doc_id", "block")


PATHS = r"""files as (select '/' || rtrim(regexp_extract(url, '://([^?#]*)', 1), '/') as path, page_id, cast(octet_length(encode(html)) as bigint) as size from pages),
image as (select path, max(page_id) as version, arg_max(size, page_id) as size, false as is_dir from files group by path),
parts as (select distinct path from files),
dirs as (select distinct '/' || array_to_string(string_split(path[2:], '/')[1:n], '/') as path from parts, unnest(range(1, len(string_split(path[2:], '/')))) as t(n)
  where '/' || array_to_string(string_split(path[2:], '/')[1:n], '/') not in (select path from image)),
nodes as (select * from image union all select path, null, null, true from dirs union all select '/', null, null, true)"""


def _nodes(spark, d):
    path = F.concat(F.lit("/"), F.rtrim(F.regexp_extract("url", r"://([^?#]*)", 1), F.lit("/")))
    rows = table(spark, d, "pages").select(path.alias("path"), F.col("page_id").alias("version"), F.octet_length("html").cast("long").alias("size"))
    return files.tree(rows)


@query("fs_image", f"with {PATHS} select * from nodes")
def fs_image(spark, d):
    return _nodes(spark, d)


PARENT = "case when path = '/' then null when strpos(path[2:], '/') = 0 then '/' else path[1:len(path) - strpos(reverse(path), '/')] end"


@query("children", f"with {PATHS} select {PARENT} as parent, count(*) as children from nodes where path <> '/' group by 1")
def children(spark, d):
    return files.children(_nodes(spark, d)).groupBy("parent").agg(F.count(F.lit(1)).alias("children"))


@query("nlink", f"with {PATHS}, sub as (select {PARENT} as parent, count(*) as n from nodes where is_dir and path <> '/' group by 1) select path, case when is_dir then 2 + coalesce(n, 0) else 1 end as nlink, coalesce((size + 511) // 512, 0) as blocks from nodes left join sub on parent = path")
def nlink(spark, d):
    return files.attributes(_nodes(spark, d)).select("path", "nlink", "blocks")


@query("mirror_diff", f"with {PATHS}, old as (select path, case when version % 10 = 1 then size + 1 else size end as size, version from image where version % 10 <> 3 union all select path || '.old', size, version from image where version % 10 = 7) select coalesce(i.path, o.path) as path, case when o.path is null then 'add' when i.path is null then 'delete' when i.size is distinct from o.size or i.version is distinct from o.version then 'update' else 'keep' end as action from image i full join old o on i.path = o.path")
def mirror_diff(spark, d):
    image = _nodes(spark, d).where("not is_dir").select("path", "size", "version")
    old = image.where("version % 10 <> 3").withColumn("size", F.when(F.col("version") % 10 == 1, F.col("size") + 1).otherwise(F.col("size")))
    old = old.unionAll(image.where("version % 10 = 7").withColumn("path", F.concat("path", F.lit(".old"))))
    return files.diff(image, old, ["size", "version"])


@query("verify_stats", f"with {PATHS} select count(*) as nodes, count(*) filter (size > 0) as files, cast(sum(size) as bigint) as bytes from nodes")
def verify_stats(spark, d):
    return files.verify(_nodes(spark, d))


LOGS = "log as (select event_id % 3 as db, event_id + 1 as txid, user_id % 16 + 1 as pgno, 0 as frame_idx, props || ':' || event_id as data from events)"


def _page_log(spark, d):
    return table(spark, d, "events").select((F.col("event_id") % 3).alias("db"), (F.col("event_id") + 1).alias("txid"), (F.col("user_id") % 16 + 1).alias("pgno"), F.lit(0).alias("frame_idx"), F.concat("props", F.lit(":"), F.col("event_id")).alias("data"))


@query("page_image", f"with {LOGS} select db, pgno, max(txid) as txid, arg_max(data, txid) as data from log group by db, pgno")
def page_image(spark, d):
    return pages.newest(_page_log(spark, d))


@query("restore_at", f"with {LOGS} select db, pgno, max(txid) as txid, arg_max(data, txid) as data from log where txid <= (select max(txid) // 2 from log) group by db, pgno")
def restore_at(spark, d):
    log = _page_log(spark, d)
    target = log.agg(F.expr("max(txid) div 2")).first()[0]
    sealed = pages.seal(log, 1000)
    return pages.restore_at(sealed, log, target)


@query("segment_coalesce", f"with {LOGS}, sealed as (select db, txid // 1000 as seg, pgno, max(txid) as txid, arg_max(data, txid) as data from log group by all) select db, pgno, max(txid) as txid, arg_max(data, txid) as data, count(*) as merged from sealed group by db, pgno having pgno <= 12")
def segment_coalesce(spark, d):
    return pages.coalesce(pages.seal(_page_log(spark, d), 1000), 12)


@query("logical_equal", f"with {LOGS}, image as (select db, pgno, arg_max(data, txid) as data from log group by db, pgno), other as (select db, pgno, case when pgno % 5 = 0 then data || '!' else data end as data from image where pgno % 7 > 0) select (select count(*) from image) = 0 as equal, (select count(*) from image where pgno % 5 = 0 or pgno % 7 = 0) as missing, (select count(*) from other where pgno % 5 = 0) as extra")
def logical_equal(spark, d):
    """The newest image against one from sealed segments in which some pages are changed and some left out."""
    log = _page_log(spark, d)
    sealed = pages.newest(pages.seal(log, 1000).select("db", "txid", "pgno", F.lit(0).alias("frame_idx"), "data"))
    other = sealed.where("pgno % 7 > 0").withColumn("data", F.when(F.col("pgno") % 5 == 0, F.concat("data", F.lit("!"))).otherwise(F.col("data")))
    return pages.logical_equal(pages.newest(log), other)


@query("churn_report", "select event_type as phase, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, max(value) as max from events group by event_type")
def churn_report(spark, d):
    return pages.report(table(spark, d, "events").select(F.col("event_type").alias("phase"), F.col("value").alias("ms")))


@query("conversation_fold", "select cast(conv_id as varchar) as stream, md5(string_agg(role || ':' || text, chr(10) order by turn)) as state, max(turn) as version from conversations group by conv_id")
def conversation_fold(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("stream"), F.col("turn").alias("version"), F.concat("role", F.lit(":"), "text").alias("line"))
    joined = fold.ordered_fold(rows, F.lit(None).cast("string"), lambda s, x: F.concat_ws("\n", s, x["line"]), ["line"])
    return joined.select("stream", F.md5("state").alias("state"), "version")


@query("follow_available_now", "select cast(conv_id as varchar) as stream, turn as version, text as data from conversations where turn >= 2")
def follow_available_now(spark, d):
    """A follower from version 2 on over conversations as streams, drained once; the result is what it forwarded."""
    from tidelog.session import shared_dir
    from tidelog.streaming.follow import follow_table

    schema = table(spark, d, "conversations").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/conversation[s].parquet")  # a pattern, as the table may be one file
    rows = raw.select(F.col("conv_id").cast("string").alias("stream"), F.col("turn").alias("version"), F.lit(0).cast("long").alias("global_seq"), F.col("role").alias("event_type"), F.col("text").cast("binary").alias("data"), F.lit(0).cast("long").alias("ts_ms"), F.lit(0).cast("long").alias("commit_pos"))
    at = f"{shared_dir(spark)}/follow-{uuid.uuid4().hex}"
    q = follow_table(rows, 2).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").select("stream", "version", F.col("data").cast("string").alias("data"))
