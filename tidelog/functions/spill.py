"""Contents in little room: compressed, and those of a view on the driver's disk, so that its memory holds nodes and not what the files contain."""

from __future__ import annotations

import os
import tempfile
import threading

import zstandard

from tidelog.schema import Backend

#: Fixed value: how a zstd frame begins.
ZSTD = b"\x28\xb5\x2f\xfd"
#: Contents below this many bytes stay as they are.
SMALL = 256
#: Least bytes of a temporary file; later ones grow with what was kept, so that their number stays low.
CHUNK = 16 << 20
#: Of each thread, as making one costs more than a small content does.
_own = threading.local()


def shrink(raw: bytes) -> bytes | None:
    """As a zstd frame, if that is worth it."""
    if len(raw) < SMALL:
        return None
    if not hasattr(_own, "compressor"):
        _own.compressor = zstandard.ZstdCompressor(level=1)
    out = _own.compressor.compress(raw)
    return out if len(out) < len(raw) else None


def grow(raw: bytes) -> bytes:
    if not hasattr(_own, "decompressor"):
        _own.decompressor = zstandard.ZstdDecompressor()
    return _own.decompressor.decompress(raw)


class Held:
    """A content in a file of the driver's, a temporary or a sealed one: bytes() reads it, len() is known. A temporary file goes with the last content that it holds."""

    __slots__ = ("at", "file", "n", "stored")

    def __init__(self, file, at: int, n: int, stored: int):
        self.file, self.at, self.n, self.stored = file, at, n, stored

    def __len__(self) -> int:
        return self.n

    def frame(self) -> bytes:
        """As it is stored."""
        raw = os.pread(self.file.fileno(), self.stored, self.at)
        if len(raw) != self.stored:
            raise Backend(f"a file of contents has {len(raw)} of {self.stored} bytes")
        return raw

    def __bytes__(self) -> bytes:
        raw = self.frame()
        return raw if self.stored == self.n else grow(raw)

    def same(self, other: Held) -> bool:
        """Whether both are stored alike, and so equal; equal ones need not be."""
        return (self.n, self.stored) == (other.n, other.stored) and self.frame() == other.frame()

    def __eq__(self, other: object) -> bool:
        return bytes(self) == bytes(other) if isinstance(other, (bytes, Held)) else NotImplemented

    __hash__ = None


class Spill:
    def __init__(self) -> None:
        self.file, self.at, self.total = None, 0, 0

    def keep(self, raw: bytes | Held) -> bytes | Held:
        if isinstance(raw, Held) or len(raw) < SMALL:
            return raw
        if self.file is None or self.at >= max(CHUNK, self.total // 32):
            self.file, self.at = tempfile.TemporaryFile(prefix="tidelog-"), 0
        stored = shrink(raw) or raw
        self.file.write(stored)
        self.file.flush()
        held = Held(self.file, self.at, len(raw), len(stored))
        self.at, self.total = self.at + len(stored), self.total + len(stored)
        return held
