"""Replicated SQLite databases: pages captured from the WAL go to a stream, are sealed into segments and restored, as of now or of a transaction.

Images are DataFrames (newest page wins, see functions.pages); the database file itself is the driver's, as SQLite needs it.
"""

from __future__ import annotations

import base64
import json
import os
import sqlite3
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import pages
from tidelog.schema import ANY, MAX_RECORDS, Encoding, InvalidInput, NewEvent, exact
from tidelog.session import settle
from tidelog.sources.store import EventStore
from tidelog.sources.wal import Cursor, Delta, tail

CHUNK = 512 << 10
#: Fixed value: how a zstd frame begins.
ZSTD = b"\x28\xb5\x2f\xfd"
LOG = "db string, txid long, frame_idx int, pgno long, data binary"


def pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(data: bytes) -> bytes:
    """zstd, or the zlib of stores written before it."""
    try:
        return zstandard.ZstdDecompressor().decompressobj().decompress(data) if data[:4] == ZSTD else zlib.decompress(data)
    except (zstandard.ZstdError, zlib.error) as e:
        raise Encoding(str(e)) from e


def chunks(deltas: Iterable[tuple[int, Delta]]) -> Iterator[tuple[bytes, bool]]:
    """Transactions in chunks of about CHUNK bytes before compression, and whether a transaction ends with the chunk.

    One that is larger travels in parts under one txid, each a chunk of its own with other pages: of a page that it wrote again only the last copy, as no reader can see the ones before.
    """
    parts, size = [], 0
    for txid, d in deltas:
        frames, most = d.frames, max(1, CHUNK // (d.page_size + 4))
        if len(frames) > most:
            frames = folded([d]).frames
        for lo in range(0, len(frames) or 1, most):
            some = frames[lo : lo + most]
            raw = struct.pack(">QIII", txid, d.page_size, d.db_size, len(some)) + b"".join(struct.pack(">I", p) + data for p, data in some)
            if parts and size + len(raw) > CHUNK:
                yield pack(b"".join(parts)), lo == 0
                parts, size = [], 0
            parts.append(raw)
            size += len(raw)
    if parts:
        yield pack(b"".join(parts)), True


def encode(deltas: Iterable[tuple[int, Delta]]) -> list[bytes]:
    return [data for data, _ in chunks(deltas)]


def decode(data: bytes) -> list[tuple[int, Delta]]:
    try:
        raw, at, out = unpack(data), 0, []
        while at < len(raw):
            txid, size, db_size, n = struct.unpack(">QIII", raw[at : at + 20])
            at += 20
            frames = []
            for _ in range(n):
                frames.append((struct.unpack(">I", raw[at : at + 4])[0], raw[at + 4 : at + 4 + size]))
                at += 4 + size
            out.append((txid, Delta(size, db_size, tuple(frames))))
        return out
    except struct.error as e:
        raise Encoding(str(e)) from e


def delta_events(event_type: str, data: bytes) -> list[tuple[int, Delta]]:
    """The transactions that an event carries: all of a packed batch, one of an old JSON event (type tx; a damaged one has none), none of other types."""
    if event_type == "txb":
        return decode(data)
    if event_type != "tx":
        return []
    try:
        d = json.loads(data)
        return [(int(d["txid"]), Delta(int(d["page_size"]), int(d["db_size"]), tuple((int(f["pgno"]), base64.b64decode(f["data"])) for f in d["pages"])))]
    except (ValueError, KeyError, TypeError):
        return []


def _unpacked(db: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(x.split()[0] for x in LOG.split(", ")), "page_size", "db_size"]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows = [(db, txid, i, p, raw, d.page_size, d.db_size) for txid, d in delta_events(kind, data) for i, (p, raw) in enumerate(d.frames)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names)

    return run


def folded(deltas: list[Delta]) -> Delta:
    """One transaction with the newest copy of each page and the last one's sizes."""
    newest = {p: data for d in deltas for p, data in d.frames}
    return Delta(deltas[-1].page_size, deltas[-1].db_size, tuple(sorted(newest.items())))


class Database:
    def __init__(self, store: EventStore, name: str, path: str):
        self.store, self.name, self.path = store, name, path
        self.token = uuid.uuid4().hex
        store.fence(name, self.token)
        self.txid, self.header = 0, (0, 0)
        self.cursor = Cursor()
        image, self.txid, self.header = self._image(None)
        snapshot = store.latest_snapshot(name)
        version = store.stream_version(name)
        self.tail = version if version is not None else (snapshot["through_version"] if snapshot else None)
        if self.txid:
            write_image(image, path, *self.header)
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        self.connection = sqlite3.connect(path, isolation_level=None)
        self.connection.execute("pragma journal_mode=wal")
        self.connection.execute("pragma wal_autocheckpoint=0")

    def manifest(self) -> dict:
        snapshot = self.store.latest_snapshot(self.name)
        return json.loads(bytes.fromhex(snapshot["state"])) if snapshot else {"segments": [], "retire": []}

    def sync(self, coalesce: bool = False) -> int:
        """Ship committed transactions (folded into one if coalesce); how many events. The cursor moves only after the append."""
        try:
            found, cursor = tail(self.path + "-wal", self.cursor)
        except FileNotFoundError:
            return 0
        if not found:
            return 0
        last = self.txid + len(found)
        numbered = [(last, folded(found))] if coalesce else list(enumerate(found, self.txid + 1))
        events, n = [], 0
        for data, ends in chunks(numbered):
            events.append(NewEvent("txb", data))
            if ends and len(events) >= MAX_RECORDS:
                n += self._ship(events)
                events = []
        n += self._ship(events)
        self.cursor, self.txid, self.header = cursor, last, (found[-1].page_size, found[-1].db_size)
        return n

    def _ship(self, events: list[NewEvent]) -> int:
        """One commit, however many batches it takes, so that all parts of a transaction are there or none."""
        if events:
            expected, commit = ANY if self.tail is None else exact(self.tail), self.store.transaction()
            for lo in range(0, len(events), MAX_RECORDS):
                commit.append(self.name, expected if lo == 0 else ANY, events[lo : lo + MAX_RECORDS], self.token)
            self.tail = commit.commit()[-1].last_version
        return len(events)

    def _backlog(self, lo: int, hi: int | None = None) -> tuple[DataFrame, int, tuple[int, int], int | None]:
        """Page log of the events from lo on, transactions up to hi; the last txid, its sizes and the last event's version. Events are unpacked by executors, so no page passes the driver."""
        events = self.store.read_history(self.name, lo).select("version", "event_type", "data")
        version = events.agg(F.max("version")).first()[0]
        found = settle(events.mapInArrow(_unpacked(self.name), f"{LOG}, page_size int, db_size long"), "database-backlog")
        log = found if hi is None else found.where(F.col("txid") <= hi)
        last = log.agg(F.max(F.struct("txid", "page_size", "db_size")).alias("l")).first()["l"]
        return log.drop("page_size", "db_size"), last["txid"] if last else 0, (last["page_size"], last["db_size"]) if last else (0, 0), version

    def _image(self, target: int | None) -> tuple[DataFrame, int, tuple[int, int]]:
        m, snapshot = self.manifest(), self.store.latest_snapshot(self.name)
        chosen = []
        for s in m["segments"]:
            if target is not None and s["txid_end"] > target:
                break
            chosen.append(s)
        base = chosen[-1]["txid_end"] if chosen else 0
        sizes = (chosen[-1]["page_size"], chosen[-1]["db_size"]) if chosen else (0, 0)
        start = snapshot["through_version"] + 1 if snapshot and len(chosen) == len(m["segments"]) else 0
        log, last, new, _ = self._backlog(start, target)
        reached = max(base, last)
        if target is not None and reached < target:
            raise InvalidInput(f"transaction {target} is not reconstructable")
        if chosen and not start:
            log = log.where(f"txid > {base}")
        if target is not None and last > base and chosen and start == 0:
            have = {r[0] for r in log.select("txid").distinct().toLocalIterator()}
            if set(range(base + 1, target + 1)) - have:
                raise InvalidInput(f"transaction {target} is not reconstructable")
        df = log
        for s in chosen:
            df = df.unionByName(self.store.spark.read.schema(LOG).parquet(f"{self.store.log.root}/{s['path']}"))
        return pages.newest(df), reached, new if last > base else sizes

    def restore_at(self, target: int, path: str) -> int:
        image, txid, sizes = self._image(target)
        write_image(image, path, *sizes)
        return txid

    def checkpoint(self, coalesce_at: int = 8, purge: bool = False) -> dict | None:
        """Seal the backlog into a segment; merge segments beyond coalesce_at; drop what the previous manifest retired; publish."""
        self.sync()
        snapshot = self.store.latest_snapshot(self.name)
        start = snapshot["through_version"] + 1 if snapshot else 0
        log, last, sizes, version = self._backlog(start)
        if version is None:
            return None
        m = self.manifest()
        first = m["segments"][-1]["txid_end"] + 1 if m["segments"] else 1
        old_retire, m["retire"] = m["retire"], []
        m["segments"].append(self._seal(pages.newest(log), first, last, sizes))
        if len(m["segments"]) > coalesce_at:
            parts = None
            for s in m["segments"]:
                df = self.store.spark.read.schema(LOG).parquet(f"{self.store.log.root}/{s['path']}")
                parts = df if parts is None else parts.unionByName(df)
            whole = pages.newest(parts).where(f"pgno <= {sizes[1]}")
            merged = self._seal(whole, m["segments"][0]["txid_start"], last, sizes)
            m["retire"] = [s["path"] for s in m["segments"]]
            m["segments"] = [merged]
        record = self.store.publish_snapshot(self.name, version, version - start + 1, json.dumps(m).encode())
        for name in old_retire:  # only now, for the manifest before this one still named what it retired
            self.store.log.blobs.delete(name)
        if purge:
            self.store.purge_below(self.name, version + 1)
        self.connection.execute("pragma wal_checkpoint(truncate)")
        self.cursor = Cursor()
        return record

    def _seal(self, image: DataFrame, first: int, last: int, sizes: tuple[int, int]) -> dict:
        name = f"segments/{uuid.uuid4().hex}.parquet"
        rows = image.select(F.lit(self.name).alias("db"), "txid", F.lit(0).alias("frame_idx"), "pgno", "data")
        rows.repartitionByRange("pgno").sortWithinPartitions("pgno").write.parquet(f"{self.store.log.root}/{name}", compression="zstd")
        return {"path": name, "txid_start": first, "txid_end": last, "page_size": sizes[0], "db_size": sizes[1]}

    def close(self) -> None:
        self.connection.close()


def write_image(image: DataFrame, path: str, page_size: int, db_size: int) -> None:
    """Page i at (i - 1) * page_size, missing ones zero, nothing beyond db_size; an old WAL beside the file goes."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    for suffix in ("-wal", "-shm"):
        if os.path.exists(path + suffix):
            os.unlink(path + suffix)
    with open(path + ".tmp", "wb") as f:
        f.truncate(page_size * db_size)
        for r in image.where(f"pgno <= {db_size}").orderBy("pgno").toLocalIterator():
            f.seek((r["pgno"] - 1) * page_size)
            f.write(bytes(r["data"]))
    os.replace(path + ".tmp", path)


def logical_rows(path: str) -> dict[str, list[tuple]]:
    """Every table's rows in order, after an integrity check; what logical equality compares."""
    with sqlite3.connect(path) as c:
        assert c.execute("pragma integrity_check").fetchone()[0] == "ok"
        names = [r[0] for r in c.execute("select name from sqlite_master where type = 'table' order by 1")]
        return {n: sorted(c.execute(f'select * from "{n}"').fetchall(), key=repr) for n in names}
