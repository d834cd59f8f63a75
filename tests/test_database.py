import sqlite3

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidelog import schema as S
from tidelog.operators.database import Database, decode, encode, logical_rows
from tidelog.sources.store import EventStore
from tidelog.sources.wal import Cursor, Delta, frames_df, transactions


@pytest.fixture
def store(spark):
    return EventStore.open_in_memory(spark)


def facts(db, n, lo=0):
    for i in range(lo, lo + n):
        db.connection.execute("insert or replace into facts values (?, ?)", (f"fact {i % 37}", f"it is {i}"))


def test_round_trip_and_point_in_time(store, tmp_path):
    db = Database(store, "db", str(tmp_path / "a.db"))
    db.connection.execute("create table facts(k text primary key, v text not null)")
    facts(db, 6)
    assert db.sync() == 1 and db.txid == 7 and db.sync() == 0
    db.connection.execute(f"vacuum into '{tmp_path}/copy.db'")
    target = db.txid
    facts(db, 4, 3)
    db.sync(coalesce=True)
    assert db.txid == 11 and store.stream_version("db") == 1
    assert db.restore_at(target, str(tmp_path / "old.db")) == target
    assert logical_rows(str(tmp_path / "old.db")) == logical_rows(str(tmp_path / "copy.db"))
    db.checkpoint()
    facts(db, 1, 90)
    db.sync()
    facts(db, 1, 91)  # committed, never synced: lost in the crash
    want = logical_rows(str(tmp_path / "a.db"))
    db.close()
    again = Database(store, "db", str(tmp_path / "b.db"))
    got = logical_rows(str(tmp_path / "b.db"))
    assert ("fact 16", "it is 90") in got["facts"] and ("fact 17", "it is 91") not in got["facts"] and ("fact 17", "it is 91") in want["facts"]
    with pytest.raises(S.InvalidInput):
        again.restore_at(99, str(tmp_path / "x.db"))
    again.close()


def test_coalescing_retirement_and_purge(store, tmp_path):
    db = Database(store, "c", str(tmp_path / "c.db"))
    db.connection.execute("create table facts(k text primary key, v text not null)")
    for i in range(5):
        facts(db, 2, 2 * i)
        db.checkpoint(coalesce_at=3, purge=True)
        assert len(db.manifest()["segments"]) <= 3
    txid = db.txid
    want = logical_rows(str(tmp_path / "c.db"))
    assert store.read_stream("c").count() == 0
    assert db.restore_at(txid, str(tmp_path / "r.db")) == txid
    assert logical_rows(str(tmp_path / "r.db")) == want
    with pytest.raises(S.InvalidInput):
        db.restore_at(txid - 1, str(tmp_path / "s.db"))
    assert db.checkpoint() is None
    db.close()
    other = Database(store, "c", str(tmp_path / "d.db"))
    assert logical_rows(str(tmp_path / "d.db")) == want
    with pytest.raises(S.FenceMismatch):
        store.append_with_token("c", S.ANY, [S.NewEvent("txb", b"")], "stale")
    other.close()


def test_frames_of_a_log_file(spark, tmp_path):
    c = sqlite3.connect(tmp_path / "w.db", isolation_level=None)
    c.execute("pragma journal_mode=wal")
    c.execute("create table t(id integer primary key, v text)")
    c.execute("insert into t values (1, 'x')")
    rows = frames_df(spark, str(tmp_path / "w.db-wal")).collect()
    assert {r["txid"] for r in rows} == {1, 2} and all(len(r["data"]) == r["page_size"] for r in rows)
    data = (tmp_path / "w.db-wal").read_bytes()
    first, cursor = transactions(data, Cursor())
    assert len(first) == 2 and transactions(data, cursor) == ([], cursor)
    assert transactions(data[:-10], Cursor())[1].frame < cursor.frame
    assert transactions(b"junk" * 20, Cursor()) == ([], Cursor())
    c.close()


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 9), st.lists(st.tuples(st.integers(1, 99), st.binary(min_size=512, max_size=512)), min_size=1, max_size=4)), max_size=8))
def test_codec(deltas):
    numbered = [(i + 1, Delta(512, n, tuple(f))) for i, (n, f) in enumerate(deltas)]
    assert [d for c in encode(numbered) for d in decode(c)] == numbered
    with pytest.raises(S.Encoding):
        decode(b"\x00")


@pytest.mark.parametrize("coalesce", [False, True])
def test_a_transaction_larger_than_a_record(store, tmp_path, monkeypatch, coalesce):
    """Its parts, more than a batch takes, come in one commit under one number, between transactions that share chunks; points in time hold on both sides."""
    monkeypatch.setattr("tidelog.operators.database.MAX_RECORDS", 2)
    db = Database(store, "large", str(tmp_path / "a.db"))
    db.connection.execute("create table t(id integer primary key, v blob)")
    db.connection.execute("insert into t values (0, x'00')")
    assert db.sync() == 1
    before, commits = db.txid, store.state.position
    db.connection.execute("with recursive n(i) as (values(1) union all select i + 1 from n where i < 40) insert into t select i, randomblob(90000) from n")
    db.connection.execute("insert into t values (99, x'01')")
    assert db.sync(coalesce=coalesce) > 6 and store.state.position == commits + 1
    want = logical_rows(str(tmp_path / "a.db"))
    assert len(want["t"]) == 42
    assert db.restore_at(db.txid, str(tmp_path / "b.db")) == before + 2 and logical_rows(str(tmp_path / "b.db")) == want
    assert db.restore_at(before, str(tmp_path / "c.db")) == before and len(logical_rows(str(tmp_path / "c.db"))["t"]) == 1
    db.checkpoint()
    first = db.manifest()["segments"][0]
    db.connection.execute("update t set v = randomblob(90000)")
    db.checkpoint()
    want = logical_rows(str(tmp_path / "a.db"))
    assert [(s["txid_start"], s["txid_end"]) for s in db.manifest()["segments"]] == [(1, first["txid_end"]), (before + 3, before + 3)]
    db.checkpoint(purge=True)
    db.close()
    Database(store, "large", str(tmp_path / "d.db")).close()
    assert logical_rows(str(tmp_path / "d.db")) == want


def test_old_page_events_are_replayed(store, tmp_path):
    """Events that an older log wrote as JSON, one transaction each, before packed ones; a damaged one and other types carry nothing."""
    import base64
    import zlib

    page = lambda c: c * 512
    old = lambda txid, pages: S.NewEvent.json("tx", {"txid": txid, "page_size": 512, "db_size": 2, "pages": [{"pgno": p, "data": base64.b64encode(d).decode()} for p, d in pages]})
    raw = zlib.compress(encode_raw(3, 512, [(2, page(b"n"))]))
    store.append("old", S.ANY, [old(1, [(1, page(b"a")), (2, page(b"b"))]), S.NewEvent("tx", b"{broken"), S.NewEvent("note", b"x"), old(2, [(1, page(b"c"))]), S.NewEvent("txb", raw)])
    db = Database.__new__(Database)
    db.store, db.name = store, "old"
    for target, want in ((1, page(b"a") + page(b"b")), (2, page(b"c") + page(b"b")), (3, page(b"c") + page(b"n"))):
        assert db.restore_at(target, str(tmp_path / "x.db")) == target
        assert (tmp_path / "x.db").read_bytes() == want


def encode_raw(txid, size, pages):
    import struct

    return struct.pack(">QIII", txid, size, 2, len(pages)) + b"".join(struct.pack(">I", p) + d for p, d in pages)


def test_envelopes_are_imported(spark):
    import base64
    import json

    from tidelog.sources import envelope

    b64 = lambda b: base64.b64encode(b).decode()
    one = {"id": "01", "type": "note", "version": 3, "seq": 9, "data": b64(b"\x00\xffx"), "metadata": [["k", b64(b"v")], ["k", b64(b"")]], "ts_ms": 5}
    plain = {k: v for k, v in one.items() if k != "metadata"} | {"version": 4, "data": ""}
    df = spark.createDataFrame([("s", json.dumps(x).encode()) for x in (one, plain)], "stream string, value binary")
    rows = envelope.events(df).orderBy("version").collect()
    assert (rows[0]["stream"], rows[0]["version"], rows[0]["global_seq"], rows[0]["id"], rows[0]["event_type"], bytes(rows[0]["data"]), rows[0]["ts_ms"]) == ("s", 3, 9, "01", "note", b"\x00\xffx", 5)
    assert [(m["name"], bytes(m["value"])) for m in rows[0]["metadata"]] == [("k", b"v"), ("k", b"")] and rows[1]["metadata"] == [] and bytes(rows[1]["data"]) == b""
    for bad in (b"\x01binary", b"{broken", b'{"id": "x"}'):
        with pytest.raises(Exception, match="envelope"):
            envelope.events(spark.createDataFrame([("s", bytearray(bad))], "stream string, value binary")).collect()
