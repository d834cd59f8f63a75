"""A file tree as DataFrames: blocks, overlap reads, directories, attributes, segment merges and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import FILE_BLOCK


def split_blocks(rows: DataFrame, key: str, content: str, size: int = FILE_BLOCK) -> DataFrame:
    """key, block, offset, len, hash, bytes: the content in blocks of `size` bytes named by SHA-256."""
    n = F.octet_length(content)
    at = rows.where(n > 0).select(key, content, F.explode(F.expr(f"sequence(0L, cast((octet_length({content}) - 1) div {size} as bigint))")).alias("block"))
    piece = at.withColumn("bytes", F.substring(F.col(content), (F.col("block") * size + 1).cast("int"), F.lit(size)))
    return piece.select(key, "block", (F.col("block") * size).alias("offset"), F.octet_length("bytes").cast("long").alias("len"), F.sha2("bytes", 256).alias("hash"), "bytes")


def new_blocks(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Blocks still to upload: one of each hash that is not stored."""
    return wanted.dropDuplicates(["hash"]).join(stored.select("hash"), "hash", "left_anti")


def overlapping(blocks: DataFrame, key: str, offset: int, length: int) -> DataFrame:
    """Blocks that a read of `length` bytes from `offset` touches; offsets are running sums of lengths."""
    end = F.sum("len").over(Window.partitionBy(key).orderBy("block"))
    return blocks.withColumn("__end", end).where((F.col("__end") > offset) & (F.col("__end") - F.col("len") < offset + length)).drop("__end")


def read_range(blocks: DataFrame, key: str, offset: int, length: int) -> DataFrame:
    """key, content: the bytes of the range, from the overlapping blocks only."""
    hit = overlapping(blocks, key, offset, length)
    parts = F.array_sort(F.collect_list(F.struct("block", "offset", "bytes")))
    joined = hit.groupBy(key).agg(parts.alias("p")).withColumn("start", F.element_at("p", 1)["offset"])
    whole = F.aggregate(F.col("p.bytes"), F.unhex(F.lit("")), lambda s, x: F.concat(s, x))
    return joined.select(key, F.substring(whole, (F.lit(offset + 1) - F.col("start")).cast("int"), F.lit(length)).alias("content"))


def splice(content: Column, offset: Column, data: Column) -> Column:
    """content with data written at offset, the gap filled with zero bytes."""
    base = F.coalesce(content, F.unhex(F.lit("")))
    padded = F.when(F.octet_length(base) < offset, F.rpad(base, offset.cast("int"), F.unhex(F.lit("00")))).otherwise(base)
    head = F.substring(padded, F.lit(1), offset.cast("int"))
    rest = F.substring(padded, (offset + F.octet_length(data) + 1).cast("int"), F.octet_length(padded))
    return F.concat(head, data, rest)


def parent(path: Column) -> Column:
    """The directory of a path; null for the root."""
    up = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(path == "/", F.lit(None)).when(up == "", F.lit("/")).otherwise(up)


def tree(writes: DataFrame) -> DataFrame:
    """path, version, size, is_dir: the last write of each path, its ancestors as directories, and the root."""
    image = writes.groupBy("path").agg(F.max("version").alias("version"), F.max_by("size", "version").alias("size")).withColumn("is_dir", F.lit(False))
    parts = F.split(F.substring("path", 2, 1 << 30), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    dirs = image.where(F.size(parts) > 1).select(F.explode(ups).alias("path")).unionAll(image.sparkSession.range(1).select(F.lit("/").alias("path"))).distinct()
    dirs = dirs.join(image.select("path"), "path", "left_anti")
    return image.unionAll(dirs.select("path", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(True)))


def children(nodes: DataFrame) -> DataFrame:
    return nodes.where("path <> '/'").withColumn("parent", parent(F.col("path")))


def attributes(nodes: DataFrame) -> DataFrame:
    """nodes with nlink (2 and the subdirectories of a directory, else 1) and blocks of 512 bytes."""
    subs = children(nodes).where("is_dir").groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("__subs"))
    both = nodes.join(subs, "path", "left")
    return both.select(*nodes.columns, F.when(F.col("is_dir"), F.coalesce("__subs", F.lit(0)) + 2).otherwise(F.lit(1)).alias("nlink"), F.coalesce(F.expr("(size + 511) div 512"), F.lit(0)).alias("blocks"))


def diff(image: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """path, action: add, delete, update or keep, by full outer join and null-safe comparison."""
    a, b = image.alias("a"), state.alias("b")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    action = F.when(F.col("b.path").isNull(), "add").when(F.col("a.path").isNull(), "delete").when(~same, "update").otherwise("keep")
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), action.alias("action"))


def verify(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("size") > 0).alias("files"), F.sum("size").alias("bytes"))


def merge_segments(entries: DataFrame) -> DataFrame:
    """Live nodes of ordered segments (vol, seg_ord, path, tombstone, …): the newest entry of each path, unless a later tombstone covers it or a directory above it.

    Tombstones are matched by equality: every entry lists its ancestors, so the prefix join needs no range condition.
    """
    order = Window.partitionBy("vol", "path").orderBy(F.desc("seg_ord"))
    newest = entries.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank").where("not tombstone")
    parts = F.split(F.substring("path", 2, 1 << 30), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    graves = entries.where("tombstone").groupBy("vol", F.col("path").alias("__grave")).agg(F.max("seg_ord").alias("__at"))
    dead = newest.select("vol", "path", "seg_ord", F.explode(above).alias("__grave")).join(graves, ["vol", "__grave"]).where("__at > seg_ord").select("vol", "path").distinct()
    return newest.join(dead, ["vol", "path"], "left_anti")


DELTAS = "op string, path string, offset long, inline binary, from string, to string, target string, mode long, uid long, gid long, mtime_ms long, name string, value binary"
NODES = "vol string, path string, kind string, size long, mode long, uid long, gid long, mtime_ms long, target string, content binary"


def fold_volumes(deltas: DataFrame) -> DataFrame:
    """Nodes of many volumes from their deltas (vol, version, ts_ms and DELTAS): one ordered fold per volume, volumes in parallel.

    Renames and removals of subtrees do not commute, so one volume's fold is serial; segments keep it short.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from tidelog.functions.fsimage import FsImage

        image = FsImage()
        for d in pdf.sort_values("version").to_dict("records"):
            clean = {k: bytes(v) if isinstance(v, bytearray) else v for k, v in d.items() if v is not None and v == v}
            for k in ("offset", "mode", "uid", "gid", "mtime_ms"):
                if k in clean:
                    clean[k] = int(clean[k])
            image.apply(clean, int(clean.get("ts_ms", 0)))
        rows = [(pdf["vol"].iloc[0], p, n.kind, n.size, n.mode, n.uid, n.gid, n.mtime_ms, n.target, n.inline) for p, n in sorted(image.nodes.items())]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])

    return deltas.groupBy("vol").applyInPandas(run, NODES)
