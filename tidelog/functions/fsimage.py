"""The file system image as a fold over deltas, one volume at a time; plain Python, also the body of a grouped fold."""

from __future__ import annotations

import base64
import contextlib
import errno
import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace
from typing import BinaryIO

import zstandard

from tidelog.functions import repeats
from tidelog.functions.spill import ZSTD, Held, grow, shrink
from tidelog.schema import FILE_BLOCK, Backend, Encoding

#: Default permission bits.
FILE_MODE, DIR_MODE, LINK_MODE = 0o644, 0o755, 0o777


@dataclass
class Node:
    kind: str  # file, dir or symlink
    mode: int
    mtime_ms: int
    uid: int = 0
    gid: int = 0
    inline: bytes | Held | None = None
    blocks: list[tuple[str, int]] | None = None
    target: str | None = None
    xattrs: dict[str, bytes] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return sum(n for _, n in self.blocks) if self.blocks is not None else len(self.inline or b"")

    def to_json(self, place: tuple[int, int, int] | None = None) -> str:
        """place: where the content is in the file beside, if it is there."""
        d = asdict(replace(self, inline=None))
        d["inline"] = {"at": place} if place else None if self.inline is None else text_of(bytes(self.inline))
        d["xattrs"] = {k: base64.b64encode(v).decode() for k, v in self.xattrs.items()}
        return json.dumps(d, separators=(",", ":"))

    @staticmethod
    def from_json(text: str, beside: Callable[[], BinaryIO] | None = None) -> Node:
        """beside: gives the file of contents that to_json had places in."""
        d = json.loads(text)
        if isinstance(d["inline"], dict) and "at" in d["inline"]:
            at, stored, n = d["inline"]["at"]
            d["inline"] = Held(beside(), at, n, stored)
        else:
            d["inline"] = None if d["inline"] is None else bytes_of(d["inline"])
        d["blocks"] = None if d["blocks"] is None else [tuple(b) for b in d["blocks"]]
        d["xattrs"] = {k: base64.b64decode(v) for k, v in d["xattrs"].items()}
        return Node(**d)


def splice(content: bytes, offset: int, data: bytes) -> bytes:
    return content[:offset].ljust(offset, b"\0") + data + content[offset + len(data) :]


def text_of(raw: bytes) -> str | dict[str, str]:
    """base64, or that of a zstd frame under its name."""
    small = shrink(raw)
    return base64.b64encode(raw).decode() if small is None else {"zstd": base64.b64encode(small).decode()}


def bytes_of(found: str | dict[str, str]) -> bytes:
    return grow(base64.b64decode(found["zstd"])) if isinstance(found, dict) else base64.b64decode(found)


def encode(delta: dict) -> bytes:
    def plain(v: object) -> object:
        return v if not isinstance(v, bytes) else t if isinstance(t := text_of(v), dict) else {"b64": t}

    return json.dumps({k: plain(v) for k, v in delta.items()}, separators=(",", ":")).encode()


def decode(data: bytes) -> dict:
    try:
        found = json.loads(data)
        return {k: bytes_of(v.get("b64", v)) if isinstance(v, dict) and set(v) in ({"b64"}, {"zstd"}) else v for k, v in found.items()}
    except (ValueError, AttributeError, TypeError, zstandard.ZstdError) as e:
        raise Encoding(str(e)) from e


class FsImage:
    """path -> Node; `changed` collects touched paths (None value: tombstone) for the next segment. Nodes are never changed in place, so a copy of an image shares them.
    What `keep` makes of a content is what its node holds; a copy holds what it is given."""

    def __init__(self, blocks=None, keep: Callable[[bytes], bytes | Held] | None = None) -> None:
        self.nodes: dict[str, Node] = {}
        self.changed: dict[str, Node | None] = {}
        self.fetch = blocks  # how to read a block, for extents written into a block-backed file
        self.keep = keep or (lambda raw: raw)
        self.kids: dict[str, dict[str, None]] | None = None  # folder -> what is directly in it, folders without a node too; built when first asked for

    def copy(self) -> FsImage:
        other = FsImage(self.fetch)
        other.nodes = dict(self.nodes)
        return other

    def below(self, path: str) -> list[str]:
        """All nodes under a folder, at a cost of their number."""
        if self.kids is None:
            self.kids = {}
            for p in self.nodes:
                self._link(p)
        out, open_ = [], [path.rstrip("/")]
        while open_:
            for p in self.kids.get(open_.pop(), ()):
                open_.append(p)
                if p in self.nodes:
                    out.append(p)
        return out

    def _link(self, path: str) -> None:
        while "/" in path:
            up = path.rpartition("/")[0]
            here = self.kids.setdefault(up, {})
            if path in here:
                return
            here[path] = None
            path = up

    def _put(self, path: str, node: Node) -> None:
        if self.kids is not None and path not in self.nodes:
            self._link(path)
        self.nodes[path] = node

    def _take(self, paths: list[str]) -> list[str]:
        """Remove nodes; those that were there."""
        gone = [p for p in paths if self.nodes.pop(p, None) is not None]
        for p in gone if self.kids is not None else ():
            while "/" in p and p not in self.nodes and not self.kids.get(p):
                up = p.rpartition("/")[0]
                if p not in self.kids.get(up, ()):
                    break
                del self.kids[up][p]
                self.kids.pop(p, None)
                p = up
        return gone

    def _set(self, path: str, node: Node) -> None:
        self._put(path, node)
        self.changed[path] = node

    def _drop(self, path: str) -> None:
        self.changed |= dict.fromkeys(self._take([path, *self.below(path)]))
        self.changed[path] = None

    def content(self, node: Node) -> bytes:
        if node.blocks is None:
            return bytes(node.inline or b"")
        return b"".join(self.fetch(h) for h, _ in node.blocks) if self.fetch else b""

    def apply(self, d: dict, ts_ms: int = 0) -> None:
        op, path = d["op"], d.get("path")
        old = self.nodes.get(path) if path else None
        is_file = old is not None and old.kind == "file"
        if op == "write":
            node = Node("file", old.mode if is_file else FILE_MODE, ts_ms, *((old.uid, old.gid) if is_file else (0, 0)), xattrs=dict(old.xattrs) if is_file else {})
            if d.get("blocks") is not None:
                node.blocks = [tuple(b) for b in d["blocks"]]
            else:
                node.inline = self.keep(splice(self.content(old) if is_file and not d.get("whole") else b"", d.get("offset", 0), d["inline"]))
            self._set(path, node)
        elif op == "mkdir":
            if old is None:
                self._set(path, Node("dir", d.get("mode", DIR_MODE), ts_ms))
        elif op == "remove":
            self._drop(path)
        elif op == "rename":
            a, b = d["from"], d["to"]
            if a in self.nodes and a != b:
                moved = {b + p[len(a) :]: self.nodes[p] for p in [a, *self.below(a)]}
                self._drop(b)
                self._drop(a)
                for p, node in moved.items():
                    self._set(p, node)
        elif op == "symlink":
            self._set(path, Node("symlink", LINK_MODE, ts_ms, target=d["target"]))
        elif op == "set_attr":
            if old is not None:
                self._set(path, replace(old, **{k: d[k] for k in ("mode", "uid", "gid", "mtime_ms") if d.get(k) is not None}))
        elif op == "set_xattr":
            if old is not None:
                kept = {k: v for k, v in old.xattrs.items() if k != d["name"]}
                self._set(path, replace(old, xattrs=kept if d.get("value") is None else kept | {d["name"]: d["value"]}))

    def check(self, d: dict) -> None:
        """Raise the POSIX error that a file system gives for the operation; a path's folder must be there."""
        kind = lambda p: "dir" if p == "/" else getattr(self.nodes.get(p), "kind", None)
        parent = lambda p: p.rpartition("/")[0] or "/"

        def need(bad: bool, code: int, at: str) -> None:
            if bad:
                raise OSError(code, os.strerror(code), at)

        op, path = d["op"], d.get("path") or d.get("to") or ""
        if op in ("write", "mkdir", "symlink", "rename"):
            need(kind(parent(path)) is None, errno.ENOENT, path)
            need(kind(parent(path)) != "dir", errno.ENOTDIR, path)
        if op == "write":
            need(kind(path) == "dir", errno.EISDIR, path)
            need(kind(path) == "symlink", errno.EEXIST, path)
            need(d.get("offset", 0) < 0, errno.EINVAL, path)
        elif op in ("mkdir", "symlink"):
            need(kind(path) is not None, errno.EEXIST, path)
        elif op in ("remove", "unlink", "rmdir"):
            need(kind(path) is None, errno.ENOENT, path)
            need(op == "unlink" and kind(path) == "dir", errno.EISDIR, path)
            need(op == "rmdir" and kind(path) != "dir", errno.ENOTDIR, path)
            need(op == "rmdir" and bool(self.below(path)), errno.ENOTEMPTY, path)
        elif op == "rename":
            a, b = kind(d["from"]), kind(path)
            need(a is None, errno.ENOENT, d["from"])
            need(a != "dir" and b == "dir", errno.EISDIR, path)
            need(a == "dir" and b not in (None, "dir"), errno.ENOTDIR, path)
            need(a == b == "dir" and path != d["from"] and bool(self.below(path)), errno.ENOTEMPTY, path)
            need(path.startswith(d["from"] + "/"), errno.EINVAL, path)
        elif op in ("set_attr", "set_xattr", "truncate"):
            need(kind(path) is None, errno.ENOENT, path)
            need(op == "truncate" and kind(path) != "file", errno.EINVAL, path)
            need(op == "set_xattr" and d.get("value") is None and d["name"] not in getattr(self.nodes.get(path), "xattrs", {}), errno.ENODATA, path)

    def merge(self, entries: list[tuple[str, Node | None]]) -> None:
        """A segment: whole nodes, and tombstones that take what is below them. Tombstones come first."""
        for path, node in entries:
            if node is None:
                self._take([path, *self.below(path)])
        for path, node in entries:
            if node is not None:
                self._put(path, node if node.inline is None else replace(node, inline=self.keep(node.inline)))


def recut(pieces: Iterable[bytes], size: int = FILE_BLOCK) -> Iterator[bytes]:
    """The same content in pieces of the size, the last may be shorter."""
    held = bytearray()
    for raw in pieces:
        rest = memoryview(raw)
        while rest:
            n = size - len(held)
            held += rest[:n]
            rest = rest[n:]
            if len(held) == size:
                yield bytes(held)
                held.clear()
    if held:
        yield bytes(held)


def stored_block(raw: bytes) -> bytes:
    """A block as it is kept under the hash of what it holds."""
    return shrink(raw) or raw


def block_of(name: str, stored: bytes, read: Callable[[str], bytes] | None = None) -> bytes:
    """What the block holds; blocks of older stores, and such as are no smaller compressed, are kept as they are. read: gives other blocks, for one that is kept as places in them."""
    if read and stored.startswith(repeats.PLACES) and hashlib.sha256(stored).hexdigest() != name:
        if hashlib.sha256(raw := repeats.whole(stored, read)).hexdigest() != name:
            raise Backend(f"block {name} is damaged")
        return raw
    with contextlib.suppress(zstandard.ZstdError):
        if stored[:4] == ZSTD and 0 <= zstandard.frame_content_size(stored) <= FILE_BLOCK:  # a content that looks like a frame may name any size
            if hashlib.sha256(raw := grow(stored)).hexdigest() == name:
                return raw
    return stored


def cut(content: bytes, size: int = FILE_BLOCK) -> list[tuple[str, bytes]]:
    return [(hashlib.sha256(b := content[i : i + size]).hexdigest(), b) for i in range(0, len(content), size)]
