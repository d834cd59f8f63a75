from tidelog.schema import ANY, NewEvent, exact
from tidelog.sources.store import EventStore
from tidelog.streaming.follow import drain, follow_compactions, follow_streams


def test_follower_shows_each_version_once_and_resumes(spark, tmp_path):
    store = EventStore.open_in_memory(spark)
    store.append("f", ANY, [NewEvent("e", f"a{i}".encode()) for i in range(4)])
    store.append("g", ANY, [NewEvent("e", b"g0")])
    seen = []
    each = lambda df, _: seen.extend((r["stream"], r["version"], bytes(r["data"]).decode()) for r in df.collect())
    go = lambda: drain(follow_streams(spark, store.log.root, start=1), str(tmp_path / "c"), each)
    go()
    assert sorted(seen) == [("f", 1, "a1"), ("f", 2, "a2"), ("f", 3, "a3")]
    store.append_at("f", 2, exact(3), [NewEvent("e", b"b2"), NewEvent("e", b"b3"), NewEvent("e", b"b4")])
    store.trim_below("f", 99)
    seen.clear()
    go()
    assert seen == [("f", 4, "b4")]  # the rewrites lie behind the cursor, and no guard hides the new one


def test_compactions_are_announced(spark, tmp_path):
    store = EventStore.open_in_memory(spark)
    store.append("s", ANY, [NewEvent("e", b"1")])
    store.publish_snapshot("s", 0, 1, b"x")
    seen = []
    drain(follow_compactions(spark, store.log.root), str(tmp_path / "c"), lambda df, _: seen.extend(r["stream"] for r in df.collect()))
    assert seen == ["s"]


def test_wal_stream_goes_on_and_starts_over(spark, tmp_path):
    import sqlite3

    from tidelog.streaming.follow import follow_wal

    c = sqlite3.connect(tmp_path / "a.db", isolation_level=None)
    c.execute("pragma journal_mode=wal")
    c.execute("create table t(v)")
    seen = []
    go = lambda: drain(follow_wal(spark, str(tmp_path / "a.db-wal")), str(tmp_path / "c"), lambda df, _: seen.extend((r["salt1"], r["frame_idx"]) for r in df.collect()))
    go()
    first = len(seen)
    assert first >= 2
    c.execute("insert into t values (1)")
    go()
    assert [k for _, k in sorted(seen)] == list(range(first + 1))
    c.execute("pragma wal_checkpoint(truncate)")
    c.execute("insert into t values (2)")
    go()
    assert len({s for s, _ in seen}) == 2 and len(seen) == first + 2
    c.close()


def test_many_volumes_fold_in_parallel(spark):
    from tidelog.functions.files import fold_volumes

    names = "vol version ts_ms op path offset inline from to".split()
    rows = []
    for v in ("x", "y"):
        rows += [(v, 0, 5, "mkdir", "/a", None, None, None, None), (v, 1, 6, "write", "/a/f", 2, b"hi", None, None), (v, 2, 7, "rename", None, None, None, "/a", "/b")]
    rows += [("y", 3, 8, "remove", "/b/f", None, None, None, None)]
    df = spark.createDataFrame(rows, "vol string, version long, ts_ms long, op string, path string, offset long, inline binary, from string, to string").select(*[f"`{n}`" for n in names])
    got = {(r["vol"], r["path"]): r["content"] and bytes(r["content"]) for r in fold_volumes(df).collect()}
    assert got == {("x", "/b"): None, ("x", "/b/f"): b"\0\0hi", ("y", "/b"): None}


def test_a_late_follower_misses_nothing_that_was_not_purged(spark, tmp_path):
    """Merges, purges and vacuums move events to other files; followers from 0 and from the middle still see each once."""
    store = EventStore.open_in_memory(spark)
    seen: dict[str, list] = {"early": [], "late": []}

    def go(who):
        drain(follow_streams(spark, store.log.root), str(tmp_path / who), lambda df, _: seen[who].extend((r["stream"], r["version"], bytes(r["data"]).decode()) for r in df.collect()))

    for i in range(4):
        store.append(f"s{i % 2}", ANY, [NewEvent("e", f"a{i}".encode())])
    go("early")
    for i in range(4):
        store.append(f"s{i % 2}", ANY, [NewEvent("e", f"b{i}".encode())])
    bulk = spark.createDataFrame([("s2", "e", f"c{i}".encode(), i) for i in range(30)], "stream string, event_type string, data binary, ord long")
    store.append_many(bulk)
    assert store.merge_files() == 8 and store.vacuum() == 8
    store.append("s0", ANY, [NewEvent("e", b"d")])
    assert store.purge_below("s1", 1) == 1
    store.merge_files()
    store.vacuum()
    go("early")
    go("late")
    want = [("s0", v, x) for v, x in enumerate(["a0", "a2", "b0", "b2", "d"])] + [("s1", v, x) for v, x in enumerate(["a1", "a3", "b1", "b3"])] + [("s2", i, f"c{i}") for i in range(30)]
    assert sorted(seen["early"]) == sorted(want)
    assert sorted(seen["late"]) == sorted(w for w in want if w != ("s1", 0, "a1"))


def test_a_missing_file_is_an_error(spark, tmp_path):
    import os

    import pytest

    store = EventStore.open_in_memory(spark)
    store.append("s", ANY, [NewEvent("e", b"1")])
    (name,) = os.listdir(f"{store.log.root}/data")
    os.unlink(f"{store.log.root}/data/{name}")
    with pytest.raises(Exception, match="is gone"):
        drain(follow_streams(spark, store.log.root), str(tmp_path / "c"), lambda df, _: df.collect())


def test_a_replica_follows_as_a_stream(spark, tmp_path):
    from tidelog.operators.volume import Replica, Volume

    store = EventStore.open_in_memory(spark)
    v = Volume(store, "v")
    v.write("/a", 0, b"1")
    v.commit()
    r = Replica(store, "v")
    q = r.follow(str(tmp_path / "c"), 100)
    try:
        v.write("/b", 0, b"2")
        v.commit()
        q.processAllAvailable()
        assert r.read_file("/b") == b"2"
    finally:
        q.stop()
