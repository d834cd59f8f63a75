"""SQLite write-ahead logs as a source: committed transactions after a cursor, and a DataFrame of frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The two magics, and sizes of the file's and a frame's header.
MAGICS, HEADER, FRAME = (0x377F0682, 0x377F0683), 32, 24


@dataclass(frozen=True)
class Cursor:
    salts: tuple[int, int] = (0, 0)
    frame: int = 0


@dataclass(frozen=True)
class Delta:
    """One transaction's pages in frame order."""

    page_size: int
    db_size: int
    frames: tuple[tuple[int, bytes], ...]


def header(data: bytes) -> tuple[int, tuple[int, int]] | None:
    """Page size and salts, if these are the first bytes of a log."""
    if len(data) < HEADER:
        return None
    magic, _, size, _, s1, s2 = struct.unpack(">6I", data[:24])
    return (65536 if size == 1 else size, (s1, s2)) if magic in MAGICS else None


def transactions(data: bytes, cursor: Cursor) -> tuple[list[Delta], Cursor]:
    """Committed transactions after the cursor, and the cursor after them; other salts mean a new log, an uncommitted end stays."""
    head = header(data)
    if head is None:
        return [], cursor
    size, salts = head
    at = cursor.frame if cursor.salts == salts else 0
    done, out, frames = at, [], []
    while HEADER + (at + 1) * (FRAME + size) <= len(data):
        base = HEADER + at * (FRAME + size)
        pgno, db_size, s1, s2 = struct.unpack(">4I", data[base : base + 16])
        if (s1, s2) != salts:
            break
        frames.append((pgno, data[base + FRAME : base + FRAME + size]))
        at += 1
        if db_size:
            out.append(Delta(size, db_size, tuple(frames)))
            done, frames = at, []
    return out, Cursor(salts, done)


def tail(path: str, cursor: Cursor) -> tuple[list[Delta], Cursor]:
    """transactions() of a log file, reading its header and what lies past the cursor only."""
    with open(path, "rb") as f:
        first = f.read(HEADER)
        head = header(first)
        if head is None:
            return [], cursor
        size, salts = head
        skip = cursor.frame if cursor.salts == salts else 0
        f.seek(HEADER + skip * (FRAME + size))
        found, end = transactions(first + f.read(), Cursor(salts, 0))
    return found, Cursor(salts, skip + end.frame)


def frames_df(spark: SparkSession, path: str) -> DataFrame:
    """db (the file), txid (its number in the file), frame_idx, pgno, page_size, db_size, data of all committed frames of the logs at path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(name, t + 1, i, p, d.page_size, d.db_size, raw) for t, d in enumerate(transactions(data, Cursor())[0]) for i, (p, raw) in enumerate(d.frames)]
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["db", "txid", "frame_idx", "pgno", "page_size", "db_size", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "db string, txid long, frame_idx int, pgno long, page_size long, db_size long, data binary")
