"""Schemas, limits and errors of the event log."""

from __future__ import annotations

from dataclasses import dataclass

#: Limits of a batch, retries, purge and file blocks.
MAX_RECORDS, MAX_RECORD_BYTES, MAX_RETRIES, PURGE_CHUNK, FILE_BLOCK, TAIL = 1000, 1 << 20, 8, 1024, 1 << 20, (1 << 63) - 1

EVENTS = "stream string, version long, global_seq long, id string, event_type string, data binary, metadata array<struct<name:string,value:binary>>, ts_ms long, ts_indexed boolean, commit_pos long"
TAILS = "stream string, version long, ts_ms long"
FENCES = "stream string, token string"
TRIMS = "stream string, floor long"
DELETES = "stream string"
FORKS = "child string, parent string, at_version long"
ROLLBACKS = "stream string, from_version long, txn long"
SNAPSHOTS = "stream string, snap_seq long, through_version long, ts_ms long, state binary"
COMPACTIONS = "pos long, stream string, through_version long, events_compacted long, job_id string, ts_ms long"
JOB_EVENTS = "pos long, type string, job_id string, stream string, worker string, error string, ts_ms long"


class StoreError(Exception):
    """Any error of the store."""


class VersionConflict(StoreError):
    def __init__(self, stream: str, expected: object, actual: int | None):
        super().__init__(f"{stream}: expected {expected}, found {actual}")
        self.stream, self.expected, self.actual = stream, expected, actual


class FenceMismatch(StoreError):
    def __init__(self, stream: str, current: str | None):
        super().__init__(f"{stream}: fenced by {current}")
        self.stream, self.current = stream, current


class InvalidInput(StoreError, ValueError):
    """A request that cannot be carried out at all."""


class Encoding(StoreError):
    """Bytes that cannot be decoded."""


class Backend(StoreError):
    """The file system failed."""


@dataclass(frozen=True)
class Expected:
    """What the writer expects of a stream's tail: ANY, NO_STREAM or exact(version)."""

    kind: str
    version: int | None = None

    def holds(self, tail: int | None) -> bool:
        return self.kind == "any" or (tail is None if self.kind == "none" else tail == self.version)


ANY, NO_STREAM = Expected("any"), Expected("none")


def exact(version: int) -> Expected:
    return Expected("exact", version)


@dataclass(frozen=True)
class NewEvent:
    event_type: str
    data: bytes
    metadata: tuple[tuple[str, bytes], ...] = ()

    @staticmethod
    def json(event_type: str, value: object, metadata: tuple[tuple[str, bytes], ...] = ()) -> NewEvent:
        import json

        return NewEvent(event_type, json.dumps(value, separators=(",", ":")).encode(), metadata)


@dataclass(frozen=True)
class CommitInfo:
    first_version: int
    last_version: int
    start_seq: int


@dataclass(frozen=True)
class CommitTicket:
    """A lazy append that is published; position: the commit whose durability await_durable waits for."""

    info: CommitInfo
    seq: int
    position: int


@dataclass(frozen=True)
class Settings:
    """How a store writes: commits between kept control tables, codec of data files, and how old a reader's view may get."""

    checkpoint_every: int = 256
    compression: str = "zstd"
    poll_ms: int = 10_000


@dataclass(frozen=True)
class PageLimit:
    max_count: int
    max_bytes: int
