"""Followers as Structured Streaming: a source over the commit log, cursors as state, replays and replicas in micro-batches.

The source's offset is the number of commits seen, so a restart from the checkpoint goes on where it stopped, and files that no commit
names are never read. A follower shows a stream's raw versions from its start on, each once and in order of arrival: a rewrite of a version that is
already behind the cursor is not shown again, and no guard applies.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.schema import COMPACTIONS, EVENTS
from tidelog.sources.commitlog import ARROW


class _File(InputPartition):
    """The events of some commits in a file that holds them now."""

    def __init__(self, path: str, positions: list[int]):
        self.path, self.positions = path, positions


class _Commit(InputPartition):
    def __init__(self, position: int, raw: str):
        self.position, self.raw = position, raw


class _LogReader(DataSourceStreamReader):
    """Offsets count commits. A commit's events are read from where they are now: merges and purges say which file replaces which, so nothing that was not purged is missed."""

    def __init__(self, root: str, compactions: bool):
        self.root, self.compactions = root, compactions
        self.read_to, self.moved = 0, {}  # commits looked through for replaced files, and by which file each was replaced

    def _fs(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        files, root = self._fs()
        found = files.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True))
        names = [f.base_name for f in found if f.base_name.endswith(".json")]
        return {"commit": int(max(names).split(".")[0]) + 1 if names else 0}

    def _commits(self, start: int, end: int) -> Iterator[tuple[int, str]]:
        files, root = self._fs()
        for n in range(start, end):
            with files.open_input_file(f"{root}/_commits/{n:020}.json") as f:
                yield n, f.read().decode()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        wanted = list(self._commits(start["commit"], end["commit"]))
        if self.compactions:
            return [_Commit(n, raw) for n, raw in wanted if json.loads(raw).get("compactions")]
        now = self.latestOffset()["commit"]
        for _, raw in self._commits(self.read_to, now):
            for new, old in json.loads(raw).get("replaces", {}).items():
                self.moved |= dict.fromkeys(old, new)
        self.read_to = now
        places: dict[str, list[int]] = {}
        for n, raw in wanted:
            commit = json.loads(raw)
            for name, _ in commit.get("files", []) if not commit.get("replaces") else ():
                while name in self.moved:
                    name = self.moved[name]
                places.setdefault(name, []).append(n)
        files, root = self._fs()
        out: list[InputPartition] = []
        for name, positions in places.items():
            info = files.get_file_info(f"{root}/{name}")
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(f"{name}, which holds events of the commits {positions[:5]}, is gone")
            parts = [f.path for f in files.get_file_info(fs.FileSelector(f"{root}/{name}")) if f.path.endswith(".parquet")] if info.type == fs.FileType.Directory else [info.path]
            out += [_File(p, positions) for p in parts]
        return out

    def read(self, partition: InputPartition) -> Iterator:
        if isinstance(partition, _Commit):
            for c in json.loads(partition.raw)["compactions"]:
                yield (partition.position + 1, c["stream"], c["through_version"], c["events_compacted"], c.get("job_id"), c["ts_ms"])
            return
        files, _ = self._fs()
        positions = pa.array(partition.positions, pa.int64())
        with files.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=10_000):
                rows = pa.Table.from_batches([batch]).select(ARROW.names).cast(ARROW)
                yield from rows.filter(pc.is_in(rows["commit_pos"], positions)).to_batches()


class LogSource(DataSource):
    """format("tidelog").option("path", root): the raw events of a store, or its compactions with option kind=compactions."""

    @classmethod
    def name(cls) -> str:
        return "tidelog"

    def schema(self) -> str:
        return COMPACTIONS if self.options.get("kind") == "compactions" else EVENTS

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _LogReader(self.options["path"].removeprefix("file://").rstrip("/"), self.options.get("kind") == "compactions")


def _stream(spark: SparkSession, root: str, kind: str) -> DataFrame:
    spark.dataSource.register(LogSource)
    return spark.readStream.format("tidelog").option("path", root).option("kind", kind).load()


def follow_log(spark: SparkSession, root: str) -> DataFrame:
    """A streaming DataFrame of every raw event, in commit order across micro-batches."""
    return _stream(spark, root, "events")


def follow_compactions(spark: SparkSession, root: str) -> DataFrame:
    return _stream(spark, root, "compactions")


_SEEN = "stream string, version long, global_seq long, event_type string, data binary, ts_ms long"


def _forward(start: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cursor = state.get[0] if state.exists else start - 1
        rows = pd.concat(list(batches)).sort_values(["version", "commit_pos"])
        rows = rows[rows["version"] > cursor].drop_duplicates("version", keep="last")
        if len(rows):
            state.update((int(rows["version"].max()),))
        yield rows[["stream", "version", "global_seq", "event_type", "data", "ts_ms"]]

    return run


def follow_streams(spark: SparkSession, root: str, streams: list[str] | None = None, start: int = 0) -> DataFrame:
    """A streaming DataFrame of new versions from `start` on, each version of a stream once; the cursor is state per stream."""
    events = follow_log(spark, root)
    if streams is not None:
        events = events.where(events["stream"].isin(streams))
    return events.groupBy("stream").applyInPandasWithState(_forward(start), _SEEN, "cursor long", "append", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run what there is now through `each`, batch by batch, and stop; the next call goes on from the checkpoint."""
    q = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], poll_ms: int = 500):
    """Follow until stopped; a failed batch fails the query, and a restart repeats it."""
    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{poll_ms} milliseconds").start()


def sync_on_commit(spark: SparkSession, root: str, checkpoint: str, action: Callable[[], object], poll_ms: int = 2000):
    """Run action (a replica's sync, a mirror's materialize) after each batch of commits; an error is logged and tried again with the next."""

    def each(batch: DataFrame, _: int) -> None:
        try:
            action()
        except Exception as e:
            print(f"sync failed, will retry: {e}")

    return run(follow_log(spark, root), checkpoint, each, poll_ms)


def follow_table(events: DataFrame, start: int = 0) -> DataFrame:
    """follow_streams over any streaming DataFrame with stream, version, global_seq, event_type, data, ts_ms, commit_pos."""
    return events.groupBy("stream").applyInPandasWithState(_forward(start), _SEEN, "cursor long", "append", GroupStateTimeout.NoTimeout)


class WalSource(DataSource):
    """format("tidelog-wal").option("path", file): committed pages of a SQLite write-ahead log; the offset is its salts and next frame."""

    @classmethod
    def name(cls) -> str:
        return "tidelog-wal"

    def schema(self) -> str:
        return "salt1 long, salt2 long, frame_idx long, pgno long, page_size long, db_size long, data binary"

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _WalReader(self.options["path"])


class _WalReader(DataSourceStreamReader):
    def __init__(self, path: str):
        from tidelog.sources.wal import Cursor

        self.path, self.cursor = path, Cursor()  # a poll reads what lies past the cursor only

    def _head(self) -> tuple[int, tuple[int, int]] | None:
        from tidelog.sources.wal import HEADER, header

        try:
            with open(self.path, "rb") as f:
                return header(f.read(HEADER))
        except FileNotFoundError:
            return None

    def initialOffset(self) -> dict:
        return {"salt1": 0, "salt2": 0, "frame": 0}

    def latestOffset(self) -> dict:
        from tidelog.sources.wal import tail

        if self._head() is None:
            return self.initialOffset()
        _, self.cursor = tail(self.path, self.cursor)
        return {"salt1": self.cursor.salts[0], "salt2": self.cursor.salts[1], "frame": self.cursor.frame}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        same = (start["salt1"], start["salt2"]) == (end["salt1"], end["salt2"])
        return [_Frames(self.path, start["frame"] if same else 0, end["frame"], (end["salt1"], end["salt2"]))]

    def read(self, partition: _Frames) -> Iterator[tuple]:
        from tidelog.sources.wal import FRAME, HEADER

        head = self._head()
        if head is None or head[1] != partition.salts:
            return
        size = head[0]
        with open(self.path, "rb") as f:
            f.seek(HEADER + partition.lo * (FRAME + size))
            for k in range(partition.lo, partition.hi):
                raw = f.read(FRAME + size)
                yield (*partition.salts, k, int.from_bytes(raw[:4], "big"), size, int.from_bytes(raw[4:8], "big"), raw[FRAME:])


class _Frames(InputPartition):
    def __init__(self, path: str, lo: int, hi: int, salts: tuple[int, int]):
        self.path, self.lo, self.hi, self.salts = path, lo, hi, salts


def follow_wal(spark: SparkSession, path: str) -> DataFrame:
    """A streaming DataFrame of a WAL file's committed frames; a reset of the log (other salts) starts it over, an uncommitted end waits."""
    spark.dataSource.register(WalSource)
    return spark.readStream.format("tidelog-wal").option("path", path).load()
