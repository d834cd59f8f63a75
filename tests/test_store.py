"""The event store: random runs against a plain model of its rules, and small cases of what a run does not reach."""

import random
import threading

import pytest

from tidelog import schema as S
from tidelog.schema import ANY, NO_STREAM, NewEvent, Settings, exact
from tidelog.sources.commitlog import CommitLog
from tidelog.sources.store import EventStore, EventStoreReader


class Model:
    """The store's rules on lists: rows are (stream, version, global_seq, body) in order of commit."""

    def __init__(self):
        self.rows, self.tails, self.trims, self.deleted, self.forks, self.rolled, self.fences, self.seq = [], {}, {}, set(), {}, {}, {}, 0

    def append(self, stream, bodies, start=None):
        first = self.tails.get(stream, -1) + 1 if start is None else start
        for i, b in enumerate(bodies):
            self.seq += 1
            self.rows.append((stream, first + i, self.seq, b))
        self.tails[stream] = max(self.tails.get(stream, -1), first + len(bodies) - 1)

    def pin(self, stream):
        return max([at for c, (p, at) in self.forks.items() if p == stream and c not in self.deleted], default=-1)

    def visible(self, stream):
        newest = {v: (q, b) for s, v, q, b in self.rows if s == stream}
        hidden = lambda v, q: v < self.trims.get(stream, 0) or any(s == stream and v >= f and q > t for (s, f), t in self.rolled.items()) or (stream in self.deleted and v > self.pin(stream))
        return {v: b for v, (q, b) in sorted(newest.items()) if not hidden(v, q)}

    def history(self, stream):
        chain, hi = [(stream, 2**63)], 2**63
        while stream in self.forks:
            stream, at = self.forks[stream]
            hi = min(hi, at + 1)
            chain.append((stream, hi))
        return [(v, b) for name, end in reversed(chain) for v, b in self.visible(name).items() if v < end]


def pairs(df):
    return [(r["version"], bytes(r["data"]).decode()) for r in df.collect()]


def events(*bodies):
    return [NewEvent("note", b.encode()) for b in bodies]


@pytest.fixture
def store(spark):
    return EventStore.open_in_memory(spark)


@pytest.mark.parametrize("seed", range(4))
def test_random_runs_follow_the_model(spark, seed):
    rng, store, model, n = random.Random(seed), EventStore.open_in_memory(spark), Model(), 0
    names = ["oak", "elm", "fir", "yew"]
    for step in range(45):
        stream = rng.choice(names + list(model.forks))
        tail = model.tails.get(stream)
        kind = rng.choice(["append"] * 5 + ["lazy"] * 3 + ["at", "fork", "trim", "roll", "delete", "merge", "purge", "vacuum", "stale"])
        n += 1
        if kind in ("append", "lazy"):
            bodies = [f"{n}.{i}" for i in range(rng.randint(1, 4))]
            expected = rng.choice([ANY, NO_STREAM if tail is None else exact(tail)])
            (store.append if kind == "append" else store.append_lazy)(stream, expected, events(*bodies))
            model.append(stream, bodies)
        elif kind == "at" and tail is not None:
            start = rng.randint(0, tail)
            store.append_at(stream, start, exact(tail), events(f"{n}!"))
            model.append(stream, [f"{n}!"], start)
        elif kind == "fork" and tail is not None and len(model.forks) < 5:
            at, child = rng.randint(0, tail), f"fork{n}"
            store.fork(stream, at, child)
            model.forks[child], model.tails[child] = (stream, at), at
        elif kind == "trim":
            floor = rng.randint(0, 4)
            assert store.trim_below(stream, floor) == max(model.trims.get(stream, 0), min(floor, tail + 1) if tail is not None else floor)
            model.trims[stream] = store.state.trims[stream]
        elif kind == "roll" and tail is not None:
            at, txn = rng.randint(0, tail), rng.randint(0, model.seq)
            store.trim(stream, at, txn)
            model.rolled[stream, at] = txn
        elif kind == "delete" and step > 25:
            store.delete_stream(stream)
            model.deleted |= {stream} & set(model.tails)
        elif kind == "merge":
            store.merge_files()
        elif kind == "purge" and step > 20:
            floor, pin = rng.randint(0, 3), model.pin(stream)
            gone = {v for s, v, *_ in model.rows if s == stream and pin < v < floor}
            assert store.purge_below(stream, floor) == len(gone)
            model.rows = [r for r in model.rows if r[0] != stream or r[1] not in gone]
        elif kind == "vacuum":
            store.vacuum()
        elif kind == "stale" and tail is not None:
            with pytest.raises(S.VersionConflict) as e:
                store.append(stream, exact(tail + 1), events("no"))
            assert e.value.actual == tail
    reader = EventStoreReader(spark, store.log.root)
    for handle in (store, reader, EventStore(spark, store.log.root)):
        for stream in model.tails:
            assert pairs(handle.read_stream(stream)) == list(model.visible(stream).items()), stream
            assert pairs(handle.read_history(stream)) == model.history(stream), stream
    for stream, tail in model.tails.items():
        assert store.stream_version(stream) == store.check_tail(stream)[0] == tail
        assert reader.stream_version(stream) == max(model.visible(stream), default=None)
        assert pairs(store.read_tail(stream, 2)) == [(v, b) for v, b in model.visible(stream).items() if v > tail - 2]
        assert store.fold(stream, "", lambda s, e: s + bytes(e["data"]).decode()) == ("".join(b for _, b in model.history(stream)), next((v for v, _ in reversed(model.history(stream))), None))
    assert store.list_streams() == sorted(set(model.tails) - model.deleted)
    assert store.durable_sequence() == model.seq


def test_what_a_writer_is_refused(store):
    store.append("rim", NO_STREAM, events("x"))
    for expected, actual in ((NO_STREAM, 0), (exact(3), 0)):
        with pytest.raises(S.VersionConflict) as e:
            store.append("rim", expected, events("y"))
        assert (e.value.stream, e.value.actual) == ("rim", actual)
    with pytest.raises(S.VersionConflict):
        store.append_at("rim", 0, exact(7), events("y"))
    big = b"." * (S.MAX_RECORD_BYTES + 1)
    for refused in ([], [NewEvent("note", b"")] * (S.MAX_RECORDS + 1), [NewEvent("note", big)]):
        with pytest.raises(S.InvalidInput):
            store.append("rim", ANY, refused)
    assert store.append("rim", ANY, [NewEvent("note", b"")] * S.MAX_RECORDS).last_version == S.MAX_RECORDS
    for parent, at in (("rim", S.MAX_RECORDS + 1), ("nowhere", 0)):
        with pytest.raises(S.InvalidInput):
            store.fork(parent, at, "twig")
    store.fork("rim", 0, "twig")
    with pytest.raises(S.VersionConflict):
        store.fork("rim", 0, "twig")
    before = store.state.position
    store.delete_stream("nowhere")
    assert store.state.position == before


def test_a_floor_beyond_the_tail_hides_no_later_write(store):
    store.append("bay", ANY, events("a", "b", "c"))
    assert store.trim_below("bay", 2**80) == 3 and pairs(store.read_stream("bay")) == []
    store.append("bay", ANY, events("d"))
    assert store.trim_below("bay", 1) == 3 and pairs(store.read_stream("bay")) == [(3, "d")]


def test_fences_and_transactions(store):
    put = lambda token: store.append_with_token("gate", ANY, events("t"), token)
    put("red")  # no fence yet
    store.fence("gate", "red")
    put("red")
    with pytest.raises(S.FenceMismatch) as e:
        put("blue")
    assert (e.value.stream, e.value.current) == ("gate", "red")
    store.append("gate", ANY, events("plain"))  # a write without a token passes
    infos = store.transaction().append("left", NO_STREAM, events("l", "m")).append("left", exact(1), events("n")).fence("gate", "blue").append("right", ANY, events("r")).commit()
    assert [(i.first_version, i.last_version) for i in infos] == [(0, 1), (2, 2), (0, 0)] and [i.start_seq for i in infos] == [4, 6, 7]
    with pytest.raises(S.FenceMismatch):
        put("red")
    tip = store.durable_sequence()
    for bad in (store.transaction().append("new", ANY, events("x")).append("left", exact(9), events("y")), store.transaction().append("new", ANY, events("x")).append("left", ANY, [])):
        with pytest.raises(S.StoreError):
            bad.commit()
    assert store.stream_version("new") is None and store.durable_sequence() == tip
    store.fence("gate", None)
    put("any")


def test_lazy_appends_stand_alone(spark, store):
    other = EventStore(spark, store.log.root)
    first = store.append_lazy("p", NO_STREAM, events("p0"))
    assert pairs(other.read_stream("p")) == [(0, "p0")]  # seen at once, by every handle
    q = store.append_lazy("q", ANY, events("q0"))
    other.append("p", exact(0), events("p1"))
    with pytest.raises(S.VersionConflict):
        store.append_lazy("p", exact(0), events("p1 too"))
    assert pairs(other.read_stream("q")) == [(0, "q0")]  # the conflict takes nothing else with it
    assert store.loose and q.position > first.position > store.durable
    store.await_durable(first)
    assert not store.loose and store.durable >= q.position
    store.log.blobs.meter.reset()
    store.await_durable(q)  # already is
    assert "fsync" not in store.log.blobs.meter.reset()
    store.append_lazy("q", ANY, events("q1"))
    store.append("r", ANY, events("r0"))  # a durable commit makes those before it durable
    assert not store.loose


def test_time_seeks_see_the_index_not_the_guards(spark):
    now = [0]
    store = EventStore.open_in_memory(spark, clock=lambda: now[0])
    for ms, body in ((50, "a"), (40, "b"), (70, "c"), (95, "d")):
        now[0] = ms
        store.append("clock", ANY, events(body))
    assert [r["ts_ms"] for r in store.read_stream("clock").collect()] == [50, 50, 70, 95]  # time never runs back in a stream
    store.trim_below("clock", 3)
    assert [store.seek_timestamp("clock", t) for t in (0, 51, 71, 96)] == [0, 2, 3, None]
    assert store.seek_visible("clock", 0) == 3 and store.check_tail("clock") == (3, 95)
    store.append_with_token_lazy("dark", ANY, events("x"), None, index_ts=False)
    assert store.seek_timestamp("dark", 0) is None
    store.append("dark", ANY, events("y"))
    assert store.seek_timestamp("dark", 0) == 1


def test_pages_follow_cursors(store):
    rng = random.Random(0)
    bodies = ["z" * rng.randint(1, 40) for _ in range(23)]
    store.append("book", ANY, events(*bodies))
    for count, size in ((1, 10), (4, 60), (100, 100), (7, 10**6)):
        seen, at = [], 0
        while at is not None:
            rows, cursor = store.read_page("book", at, S.PageLimit(count, size))
            assert rows and len(rows) <= count and (len(rows) == 1 or sum(len(r["data"]) for r in rows) <= size)
            seen += [(r["version"], bytes(r["data"]).decode()) for r in rows]
            at = cursor
        assert seen == list(enumerate(bodies))
    assert store.read_page("book", 23, S.PageLimit(5, 5)) == ([], None)
    assert store.read_tail("book", 0).count() == 0 and store.read_tail("book", 99).count() == 23


class Words:
    """An aggregate: how often each word came."""

    def __init__(self, seen=None):
        self.seen = seen or {}

    def apply(self, event):
        word = bytes(event["data"]).decode()
        self.seen[word] = self.seen.get(word, 0) + 1

    def snapshot(self):
        return repr(self.seen).encode()

    @classmethod
    def restore(cls, data):
        import ast

        return cls(ast.literal_eval(data.decode()))


def test_snapshots_shorten_a_rehydration(store):
    rng, said = random.Random(7), []
    assert store.compaction_backlog("talk") == 0 and store.latest_snapshot("talk") is None
    for _ in range(6):
        more = rng.choices(["hey", "ho", "hum"], k=5)
        store.append("talk", ANY, events(*more))
        said += more
        want = {w: said.count(w) for w in set(said)}
        state, last = store.rehydrate(Words, "talk")
        assert (state.seen, last) == (want, len(said) - 1)
        if rng.random() < 0.5:
            record = store.compact(Words, "talk")
            assert (record["through_version"], record["events_compacted"]) == (len(said) - 1, len(said)) and store.compaction_backlog("talk") == 0
    store.compact(Words, "talk")
    store.purge_below("talk", len(said))
    assert store.rehydrate(Words, "talk")[0].seen == want and store.compact_with is not None
    store.append("talk", ANY, events("hey"))
    assert store.compact(Words, "talk")["events_compacted"] == 1  # from the snapshot on, where a purge has left a gap
    assert store.rehydrate(Words, "talk")[0].seen == want | {"hey": want["hey"] + 1}
    store.publish_snapshot("talk", 2, 3, b"{}")
    assert bytes.fromhex(store.latest_snapshot("talk")["state"]) == b"{}"  # the last published, not the furthest
    store.append("sum", ANY, events("3", "4"))
    store.compact_with("sum", lambda rows: str(sum(int(bytes(r["data"])) for r in rows)).encode())
    assert bytes.fromhex(store.latest_snapshot("sum")["state"]) == b"7"
    with pytest.raises(S.InvalidInput):
        store.compact(Words, "silence")
    assert [c["stream"] for c in store.compaction_records()][-1] == "sum"


def test_jobs_go_through_their_states(store):
    store.append("work", ANY, events("w"))
    assert store.job_status("no such") is None
    a, b, c = (store.request_compaction("work") for _ in range(3))
    store.claim_compaction(a, "anna")
    with pytest.raises(S.InvalidInput):
        store.claim_compaction(a, "otto")
    with pytest.raises(S.InvalidInput):
        store.claim_compaction("no such", "otto")
    store.fail_compaction(b, "no room")
    assert [store.job_status(j) for j in (a, b, c)] == [{"status": "claimed", "worker": "anna"}, {"status": "failed", "error": "no room"}, {"status": "pending"}]
    store.compact_job(a, Words, "work")
    assert store.job_status(a) == {"status": "completed"}


def test_readers_lag_by_their_interval_and_hide_system_events(spark, store):
    store.append("r", ANY, [NewEvent("$mark", b"1"), NewEvent("note", b"2")])
    slow = EventStoreReader(spark, store.log.root, Settings(poll_ms=3_600_000))
    quick = EventStoreReader(spark, store.log.root, Settings(poll_ms=0))
    assert [r["event_type"] for r in slow.read_history("r").collect()] == ["note"] and store.read_history("r").count() == 2
    store.append("r", ANY, events("3"))
    store.fork("r", 2, "fresh")
    assert (slow.stream_version("r"), quick.stream_version("r")) == (1, 2)
    assert slow.refresh() == 3 and slow.stream_version("r") == 2
    assert quick.stream_version("fresh") is None and store.stream_version("fresh") == 2


def test_writers_of_other_streams_do_not_conflict(spark, store):
    errors = []

    def write(i):
        mine = EventStore(spark, store.log.root)
        try:
            for k in range(12):
                mine.append(f"lane{i}", NO_STREAM if k == 0 else exact(k - 1), events(str(k)))
        except S.StoreError as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and [store.stream_version(f"lane{i}") for i in range(6)] == [11] * 6
    assert sorted(r["global_seq"] for r in store.events_df().collect()) == list(range(1, 73))


def test_a_writer_that_always_loses_gives_up(spark, store, monkeypatch):
    """Every time it has read the log, another writer of its stream is quicker; one of another stream does not count."""
    other = EventStore(spark, store.log.root)
    stream, publish, n = ["busy"], store.log.publish, [0]

    def late(position, commit, durable=True):
        n[0] += 1
        if n[0] <= 30:
            other.append(stream[0], ANY, events("first"))
        return publish(position, commit, durable)

    monkeypatch.setattr(store.log, "publish", late)
    with pytest.raises(S.VersionConflict) as e:
        store.append("busy", ANY, events("late"))
    assert n[0] == S.MAX_RETRIES + 1 and e.value.stream == "busy"
    stream[0], n[0] = "elsewhere", 0
    assert store.append("busy", ANY, events("late")).first_version == S.MAX_RETRIES + 1 and n[0] == 31


def test_bulk_appends_go_on_from_the_tails(store, spark):
    store.append("k1", ANY, events("first"))
    rows = [(f"k{i % 50}", "note", f"d{i}".encode(), -i) for i in range(400)]
    assert store.append_many(spark.createDataFrame(rows, "stream string, event_type string, data binary, ord long")) == 400
    for k in (0, 1, 49):
        want = (["first"] if k == 1 else []) + [f"d{i}" for i in reversed(range(400)) if i % 50 == k]
        assert pairs(store.read_stream(f"k{k}")) == list(enumerate(want))
    found = store.events_df().select("stream", "version", "global_seq").collect()
    assert sorted(r["global_seq"] for r in found) == list(range(1, 402))
    by = sorted((r["stream"], r["version"], r["global_seq"]) for r in found)
    assert all(a[2] < b[2] for a, b in zip(by, by[1:]) if a[0] == b[0])
    assert store.append("k0", exact(7), events("next")).start_seq == 402


def test_kept_control_tables_and_the_hadoop_form(spark, tmp_path):
    settings = Settings(checkpoint_every=4, compression="snappy")
    store = EventStore(spark, str(tmp_path / "s"), settings=settings)
    for i in range(9):
        store.append(f"m{i % 2}", ANY, events(str(i)))
    store.append_at("m0", 1, ANY, events("z"))
    store.fork("m0", 1, "mf")
    store.trim("m1", 2, 0)
    assert store.merge_files() == 10 and store.merge_files() == 0
    assert store.purge_below("m1", 1) == 1 and store.vacuum() == 11 and store.vacuum() == 0
    assert store.log.load().position == 12
    again = EventStore(spark, store.log.root)
    assert again.state == store.state and pairs(again.read_history("mf")) == [(0, "0"), (1, "z")] and pairs(again.read_stream("m1")) == [(1, "3")]
    far = CommitLog(spark, f"file://{tmp_path}/s", hadoop=True)  # the same folder through Hadoop's file system
    assert far.refresh(far.load()) == store.state
    assert far.publish(store.state.position, {"seq": store.state.seq}) and not far.publish(store.state.position, {"seq": 0})
    assert far.read(store.state.position) is not None and far.read(99) is None
    blobs = far.blobs
    blobs.put("blocks/x", b"\x00\xff" * 3)
    blobs.put("blocks/x", b"new")
    assert blobs.read("blocks/x") == b"new" and blobs.exists("blocks/x") and blobs.names("blocks") == ["x"] and blobs.names("none") == []
    blobs.delete("blocks/x")
    assert blobs.read("blocks/x") is None and not blobs.exists("blocks/x")
    figures = blobs.meter.reset()
    assert figures["put"][:2] == (2, 9) and figures["create"][0] == 2 and blobs.meter.reset() == {}
    name = far.write_rows([{"stream": "m0", "version": 9, "global_seq": 99, "id": "i", "event_type": "note", "data": b"far", "metadata": [], "ts_ms": 1, "ts_indexed": True, "commit_pos": 1}])
    assert spark.read.parquet(f"{far.root}/{name}").count() == 1 and far.vacuum(store.state) == 1


def test_closing_stops_queries(spark, store, tmp_path):
    store.append("s", ANY, events("a"))
    seen = []
    q = store.follow(str(tmp_path / "c"), lambda df, _: seen.extend(r["version"] for r in df.collect()), ["s"])
    q.processAllAvailable()
    store.append_lazy("s", ANY, events("b"))
    store.close()
    assert not q.isActive and seen[:1] == [0] and not store.loose


def test_many_streams_are_purged_by_one_rewrite(spark, monkeypatch):
    """As one by one, with and without a broadcast: pins of living children, floors of zero, unknown streams and files of single appends; one new file, and followers find the rest."""
    def filled():
        store = EventStore.open_in_memory(spark, lambda: 5)
        store.append_many(spark.range(600).selectExpr("concat('s-', id % 120) as stream", "'x' as event_type", "cast(id as string) as data", "id as ord"))
        store.append("s-1", S.ANY, [S.NewEvent("x", b"late")])
        store.append("other", S.ANY, [S.NewEvent("x", b"kept")])
        store.fork("s-2", 1, "child")
        return store

    floors = {f"s-{k}": k % 4 for k in range(110)} | {"s-1": 6, "s-2": 3, "none": 9}
    seen = lambda store: sorted((r["stream"], r["version"], bytes(r["data"]), r["global_seq"]) for r in store.events_df().collect())
    for limit in (100_000, 3):
        monkeypatch.setattr("tidelog.sources.store.BROADCAST_SPANS", limit)
        store = filled()
        before, position, n = seen(store), store.state.position, len(store.state.files)
        gone = {(s, v) for s, v, _, _ in before if v < floors.get(s, 0) and not (s == "s-2" and v <= 1)}
        assert store.purge_many(floors) == len(gone) and store.state.position == position + 1
        assert seen(store) == [r for r in before if r[:2] not in gone] and len(store.state.files) == n - 1
        assert seen(EventStore(spark, store.log.root)) == seen(store) and store.purge_many({}) == 0 and store.purge_many(floors) == 0
    one = filled()
    assert sum(one.purge_below(s, floors[s]) for s in ("s-1", "s-2", "s-3")) == 6 + 1 + 3
