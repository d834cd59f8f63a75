"""Whole small files under a root, on a local disk or any file system that Hadoop knows; what is done to them is metered."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import BinaryIO

from pyspark.sql import SparkSession

from tidelog.schema import Backend

#: Bytes of a remote file that are read at a time.
PIECE = 4 << 20


@dataclass
class Meter:
    """How often, how many bytes and how long (seconds) for each kind of call since the last reset."""

    calls: dict[str, list] = field(default_factory=dict)

    @contextmanager
    def __call__(self, kind: str) -> Iterator[list]:
        row, start = self.calls.setdefault(kind, [0, 0, 0.0]), time.perf_counter()
        row[0] += 1
        try:
            yield row
        finally:
            row[2] += time.perf_counter() - start

    def reset(self) -> dict[str, tuple[int, int, float]]:
        """The figures so far; counting starts anew."""
        out, self.calls = {k: tuple(v) for k, v in self.calls.items()}, {}
        return out


class Blobs:
    """read, put, create (put if absent), exists, names, delete; names are paths under the root. A local write is durable if asked for, a remote one always."""

    def __init__(self, spark: SparkSession, root: str, hadoop: bool | None = None):
        self.spark, self.meter = spark, Meter()
        self.hadoop = "://" in root.removeprefix("file://") if hadoop is None else hadoop
        self.root = root.rstrip("/") if self.hadoop else root.removeprefix("file://").rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> bytes | None:
        with self.meter("get") as row:
            raw = None
            if not self.hadoop:
                try:
                    with open(self.at(name), "rb") as f:
                        raw = f.read()
                except FileNotFoundError:
                    pass
            else:
                path, fs = self._fs()
                if fs.exists(path(self.at(name))):
                    stream = fs.open(path(self.at(name)))
                    try:
                        raw = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
                    finally:
                        stream.close()
            row[1] += len(raw or b"")
            return raw

    @contextmanager
    def opened(self, name: str) -> Iterator[BinaryIO]:
        with self.open(name) as f:
            yield f

    def open(self, name: str) -> BinaryIO:
        """The file, to be read in parts; a remote one is first copied to the driver's disk, a piece at a time."""
        with self.meter("get") as row:
            if not self.hadoop:
                try:
                    f = open(self.at(name), "rb")
                except FileNotFoundError as e:
                    raise Backend(f"{name} is missing") from e
            else:
                path, fs = self._fs()
                if not fs.exists(path(self.at(name))):
                    raise Backend(f"{name} is missing")
                f, stream = tempfile.TemporaryFile(prefix="tidelog-"), fs.open(path(self.at(name)))
                try:
                    while raw := bytes(stream.readNBytes(PIECE)):
                        f.write(raw)
                finally:
                    stream.close()
            row[1] += f.seek(0, os.SEEK_END)
            f.seek(0)
        return f

    def _write(self, name: str, pieces: Iterable[bytes], durable: bool) -> int:
        n = 0
        if not self.hadoop:
            with self._in_folder(name, lambda at: open(at, "wb")) as f:
                for raw in pieces:
                    n += f.write(raw)
                if durable:
                    f.flush()
                    os.fsync(f.fileno())
            return n
        path, fs = self._fs()
        out = fs.create(path(self.at(name)), True)
        try:
            for raw in pieces:
                out.write(bytearray(raw))
                n += len(raw)
        finally:
            out.close()
        return n

    def _in_folder(self, name: str, do: Callable[[str], object]):
        """do at the name's place; its folder is made if that is why it fails."""
        try:
            return do(self.at(name))
        except FileNotFoundError:
            os.makedirs(os.path.dirname(self.at(name)), exist_ok=True)
            return do(self.at(name))

    def put(self, name: str, raw: bytes | Iterable[bytes], durable: bool = True) -> None:
        """The file's content, or pieces of it. Readers see the old file or the whole new one."""
        with self.meter("put") as row:
            temporary = f"_staging/{uuid.uuid4().hex}"
            row[1] += self._write(temporary, [raw] if isinstance(raw, bytes) else raw, durable)
            if not self.hadoop:
                self._in_folder(name, lambda at: os.replace(self.at(temporary), at))
                return
            self._rename(temporary, name, "OVERWRITE")

    def take(self, other: Blobs, name: str) -> None:
        """Put another root's file under the same name. On one local disk both are the same file, as no file is ever changed in place."""
        if not self.hadoop and not other.hadoop:
            temporary = f"_staging/{uuid.uuid4().hex}"
            with contextlib.suppress(OSError), self.meter("put"):  # another disk, or one without links
                self._in_folder(temporary, lambda at: os.link(other.at(name), at))
                self._in_folder(name, lambda at: os.replace(self.at(temporary), at))
                if os.path.exists(self.at(temporary)):  # replace leaves both if they are the same file already
                    os.unlink(self.at(temporary))
                return
        raw = other.read(name)
        if raw is None:
            raise Backend(f"{name} is missing")
        self.put(name, raw)

    def create(self, name: str, raw: bytes, durable: bool = True) -> bool:
        """Put the file unless there is one of that name; whether it was put."""
        with self.meter("create") as row:
            row[1] += len(raw)
            temporary = f"_staging/{uuid.uuid4().hex}"
            self._write(temporary, [raw], durable)
            if self.hadoop:
                return self._rename(temporary, name, "NONE")
            try:
                self._in_folder(name, lambda at: os.link(self.at(temporary), at))
                return True
            except FileExistsError:
                return False
            except OSError as e:
                raise Backend(str(e)) from e
            finally:
                os.unlink(self.at(temporary))

    def _rename(self, old: str, new: str, option: str) -> bool:
        path, fs = self._fs()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = getattr(hadoop.Options.Rename, option)
        try:
            fs.mkdirs(path(self.at(new)).getParent())
            context.rename(path(self.at(old)), path(self.at(new)), options)
            return True
        except Exception as e:
            fs.delete(path(self.at(old)), False)
            if option == "NONE" and "FileAlreadyExists" in str(e):
                return False
            raise Backend(str(e)) from e

    def exists(self, name: str) -> bool:
        with self.meter("head"):
            if not self.hadoop:
                return os.path.exists(self.at(name))
            path, fs = self._fs()
            return bool(fs.exists(path(self.at(name))))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it is not there."""
        with self.meter("list"):
            if not self.hadoop:
                try:
                    return sorted(x for x in os.listdir(self.at(folder)) if not x.startswith("."))
                except FileNotFoundError:
                    return []
            path, fs = self._fs()
            if not fs.exists(path(self.at(folder))):
                return []
            return sorted(s.getPath().getName() for s in fs.listStatus(path(self.at(folder))) if not s.getPath().getName().startswith("."))

    def delete(self, name: str) -> None:
        with self.meter("delete"):
            if self.hadoop:
                path, fs = self._fs()
                fs.delete(path(self.at(name)), True)
            elif os.path.isdir(self.at(name)):
                shutil.rmtree(self.at(name))
            elif os.path.exists(self.at(name)):
                os.unlink(self.at(name))

    def fsync(self, names: list[str]) -> None:
        """Make files durable that were written without (and their folders)."""
        if self.hadoop:
            return
        with self.meter("fsync"):
            for at in {self.at(n) for n in names} | {os.path.dirname(self.at(n)) for n in names}:
                if os.path.exists(at):
                    fd = os.open(at, os.O_RDONLY)
                    try:
                        os.fsync(fd)
                    finally:
                        os.close(fd)
