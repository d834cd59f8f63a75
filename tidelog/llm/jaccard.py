"""N-gram Jaccard join: which documents share at least a given share of their word n-grams.

The document by n-gram incidence is never multiplied whole. Documents with equal sets are one row of it. Its columns are put into one
global order, rare n-grams first (document counts from a sketch of fixed size), and a row can only reach the threshold with another if
they meet in the first n - ceil(t n) + 1 columns that each has. That part is dealt into blocks of columns, a block is multiplied by
sorting, and only columns that two rows share survive. For a pair, the products over those columns are summed to an overlap count;
the pair is discarded if that count and what lies behind the prefixes cannot reach the size-derived bound t/(1+t) (n_a + n_b). For
the rest the remaining columns decide exactly.

Groups of copies would square, so pairs are not drawn from columns. In each column and size class the row with the largest share of shared
columns is the hub, and the rows of that class and its neighbours are its group. Round one pairs rows with hubs only, and linked rows become one
component. Two rows that could link meet in some group, and unless they are in one component by then, at least one of them is outside the hub's:
round two multiplies, group by group, the rows outside with all rows, in blocks, so no link between components is missed and pairs
within a component need no look.

Defined results: words are runs without ASCII white space, A-Z lower-cased; a text with fewer than k words has one n-gram, the whole
sequence; a null text or one without words has the empty set and links with nothing. Repeated rows and rows that share an id are
equal rows of the incidence. N-grams are compared by 64-bit hashes and sets by a 64-bit hash of these; the counting bound uses 44 bits of an n-gram
and its place in the global order, where two n-grams of one text count once, so exactness is up to collisions of these hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.components import components
from tidelog.llm.textops import LOWER, Words, column_bytes, give_back, mix64, pieces, streamed, windows
from tidelog.session import drop, settle

SKETCH = 1 << 22
CHUNK = 1 << 16
_U = np.uint64


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    for lo, hi in pieces(texts):
        words = Words([t.translate(LOWER) for t in texts[lo:hi]])
        h = words.hashes()
        grams = windows(h, k)
        for i in range(hi - lo):
            a, b = int(words.first[i]), int(words.first[i + 1])
            if b - a >= k:
                found = np.sort(grams[a : b - k + 1])
                new = np.ones(len(found), bool)
                np.not_equal(found[1:], found[:-1], out=new[1:])
                yield found[new]
            else:
                yield windows(h[a:b], b - a) if b > a else grams[:0]


def vertex(grams: np.ndarray) -> int:
    """One value for equal sets (signed 64 bits)."""
    if not len(grams):
        return 0
    mixed = (int(np.add.reduce(grams)) + 0x9E3779B97F4A7C15 * int(np.bitwise_xor.reduce(grams)) + len(grams)) % 2**64
    return int(mix64(np.array([mixed], _U)).view(np.int64)[0])


def _first_pass(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        seen = False
        names = ["doc_id", "n", "vertex", "chunk", "counts"]
        for batch in batches:
            seen = True
            n, v = [], []
            for grams in shingle_sets(column_bytes(batch.column(1)), k):
                n.append(len(grams))
                v.append(vertex(grams))
                counts[(grams & _U(SKETCH - 1)).astype(np.int64)] += np.uint32(1)  # two n-grams of a text in one bucket count once
            nothing = pa.nulls(len(n), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(v, pa.int64()), nothing, pa.nulls(len(n), pa.binary())], names)
        if seen:
            part = np.minimum(counts, 255).astype(np.uint8).reshape(-1, CHUNK)  # any counts give a valid order
            m = len(part)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(range(m), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in part], pa.binary())], names)

    return run


def _add_chunks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.uint64)
    for x in table.column("counts").to_pylist():
        raw = zlib.decompress(x)
        total += np.frombuffer(raw, np.uint8 if len(raw) == CHUNK else "<u4")
    total = np.minimum(total, 2**32 - 1).astype("<u4")
    return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _sketch(first: DataFrame) -> np.ndarray:
    """Document counts of n-grams by bucket, added up in two steps; SKETCH numbers whatever the corpus."""
    parts = first.where("chunk is not null").select("chunk", "counts", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("salt"))
    parts = parts.groupBy("chunk", "salt").applyInArrow(_add_chunks, "chunk int, counts binary")
    rows = parts.groupBy("chunk").applyInArrow(_add_chunks, "chunk int, counts binary").toLocalIterator()
    out = np.zeros(SKETCH, np.uint32)
    for r in rows:
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(bytes(r["counts"])), "<u4")
    return out


def _need(n: np.ndarray | int, percent: int):
    """The least overlap that a set of n can have with one at the threshold."""
    return -(-percent * n // 100)


_POST = [("tok", "<u8"), ("vertex", "<i8"), ("n", "<u4"), ("pos", "<u4")]


def _postings(k: int, percent: int, held, blocks: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.minimum(held.value, (1 << 20) - 1).astype(_U)
        for batch in batches:
            toks, verts, sizes, places, seen = [], [], [], [], set()
            for grams in shingle_sets(column_bytes(batch.column(1)), k):
                n, v = len(grams), vertex(grams)
                if not n or v in seen:
                    continue
                seen.add(v)
                tok = np.sort((rank[(grams & _U(SKETCH - 1)).astype(np.int64)] << _U(44)) | (grams >> _U(20)))[: n - _need(n, percent) + 1]
                toks.append(tok)
                verts.append(v)
                sizes.append(n)
                places.append(len(tok))
            if not toks:
                continue
            rows = np.zeros(sum(places), np.dtype(_POST))
            rows["tok"] = np.concatenate(toks)
            rows["vertex"], rows["n"] = np.repeat(verts, places), np.repeat(sizes, places)
            rows["pos"] = np.arange(len(rows)) - np.repeat(np.cumsum(places) - places, places)
            mixed = mix64(rows["tok"])
            often = (rows["tok"] >> _U(44)) >= _U(hot)
            mixed[often] ^= mix64(rows["vertex"][often].view(_U)) & _U(63)  # a column that may be hot is spread over 64 keys
            at = (mixed % _U(blocks)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            rows, at = rows[order], at[order]
            cut = np.flatnonzero(np.diff(at, prepend=-1))
            ends = np.append(cut[1:], len(at))
            yield pa.RecordBatch.from_arrays([pa.array(at[cut].astype(np.int32), pa.int32()), pa.array([rows[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())], ["block", "rows"])

    return run


def _shared(hot: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), np.dtype(_POST))
        rows = rows[np.lexsort((rows["vertex"], rows["tok"]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["tok"][1:] != rows["tok"][:-1]) | (rows["vertex"][1:] != rows["vertex"][:-1])
        rows = rows[new]
        start = np.flatnonzero(np.concatenate(([True], rows["tok"][1:] != rows["tok"][:-1])))
        count = np.repeat(np.diff(np.append(start, len(rows))), np.diff(np.append(start, len(rows))))
        rows = rows[(count > 1) | ((rows["tok"] >> _U(44)) >= _U(hot))]
        give_back()
        return pa.table({"tok": pa.array(rows["tok"].view("<i8").copy(), pa.int64()), "vertex": pa.array(rows["vertex"].copy(), pa.int64()), "n": pa.array(rows["n"].astype(np.int64), pa.int64()), "pos": pa.array(rows["pos"].astype(np.int64), pa.int64())})

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                found = list(shingle_sets(column_bytes(part.column(1)), k))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([vertex(g) for g in found], pa.int64()), pa.array([g.tobytes() for g in found], pa.binary())], ["first", "rep", "grams"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                keep = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                    both = np.concatenate((x, y))
                    both.sort(kind="stable")
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _product(percent: int, cells: int = 1 << 22):
    """One cell of a group's grid: overlap counts over the shared columns of its outer rows with its inner rows; pairs across components that pass the bounds.

    The inner rows are indexed by column, so an outer row meets only columns that it has; outer rows are taken so many at a time that the counts fit `cells` numbers.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        reps, n, comp = (table.column(c).to_numpy() for c in ("rep", "n", "comp"))
        lists = [np.asarray(x, np.int64) for x in table.column("toks").to_pylist()]
        outer = table.column("outer").to_numpy(zero_copy_only=False)
        order, outside = np.flatnonzero(~outer), np.flatnonzero(outer)
        found = [np.zeros((0, 2), np.int64)]
        if len(order) and len(outside):
            order = order[np.argsort(n[order], kind="stable")]
            sizes = np.fromiter((len(lists[i]) for i in order), np.int64, len(order))
            flat, row = np.concatenate([lists[i] for i in order]), np.repeat(np.arange(len(order)), sizes)
            by = np.argsort(flat, kind="stable")
            flat, row = flat[by], row[by]
            inner_n, inner_comp, inner_rep = n[order], comp[order], reps[order]
            step = max(1, cells // len(order))
            for lo in range(0, len(outside), step):
                part = outside[lo : lo + step]
                mine = np.concatenate([lists[i] for i in part])
                owner = np.repeat(np.arange(len(part)), [len(lists[i]) for i in part])
                begin, end = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
                overlap = np.zeros(len(part) * len(order), np.int32)
                width = np.cumsum(end - begin)
                cut = [0, *np.searchsorted(width, np.arange(cells, int(width[-1]) if len(width) else 0, cells)), len(mine)]
                for a, b in zip(cut, cut[1:]):
                    count = end[a:b] - begin[a:b]
                    at = np.repeat(begin[a:b] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if b > a else np.zeros(0, np.int64)
                    np.add.at(overlap, np.repeat(owner[a:b], count) * len(order) + row[at], 1)
                overlap = overlap.reshape(len(part), len(order))
                size, behind = n[part][:, None], _need(np.maximum(inner_n[None, :], n[part][:, None]), percent) - 1
                able = (inner_comp[None, :] != comp[part][:, None]) & (overlap > 0)
                able &= ((overlap + behind) * (100 + percent) >= percent * (inner_n[None, :] + size)) & (np.minimum(inner_n[None, :], size) * 100 >= percent * np.maximum(inner_n[None, :], size))
                x, y = np.nonzero(able)
                x, y = reps[part][x], inner_rep[y]
                found.append(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0].copy(), pa.int64()), "b": pa.array(pairs[:, 1].copy(), pa.int64())})

    return run


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most a million narrow rows."""
    return F.broadcast(df) if rows <= 1_000_000 else df


class JaccardJoin:
    """The join's tables: docs (doc_id, n, vertex), groups (vertex, comp: the smallest id of its component) and links (a, b: vertices of linked sets, enough of them to connect all).

    A vertex is the hash of a set, so rows that share an id but not a set are different ones; sets that only rows without an id have link with nothing.
    """

    def __init__(self, docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 400_000, group_rows: int = 2048):
        spark = docs.sparkSession
        self.k, self.percent = k, percent
        self.base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        first = settle(self.base.mapInArrow(streamed(_first_pass(k)), "doc_id long, n long, vertex long, chunk int, counts binary"), "jaccard-first")
        self.docs = first.where("chunk is null").select("doc_id", "n", "vertex")
        counts = _sketch(first)
        ids = self.docs.agg(F.count("doc_id").alias("ids"), F.count_distinct("doc_id").alias("different"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        self.repeated, total = ids["ids"] > ids["different"], ids["total"]
        hot = min((1 << 20) - 1, max(100_000, 8 * total // SKETCH))
        blocks = max(8, -(-total * (100 - percent) // 100 // block_rows))
        post = self.base.mapInArrow(streamed(_postings(k, percent, spark.sparkContext.broadcast(counts), blocks, hot)), "block int, rows binary")
        self.least_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = settle(post.repartitionById(blocks, F.col("block")).groupBy("block").applyInArrow(_shared(hot), "tok long, vertex long, n long, pos long"), "jaccard-shared")
        firsts = self.docs.where("n > 0 and doc_id is not null").groupBy("vertex").agg(F.min("doc_id").alias("first"))
        rows = found.groupBy("vertex").agg(F.first("n").alias("n"), F.collect_list("tok").alias("toks"))
        self.rows = settle(rows.join(firsts, "vertex").select(F.col("vertex").alias("rep"), "first", "n", "toks"), "jaccard-rows")
        members = settle(self._members(found), "jaccard-members")
        drop(found)
        pairs = members.where((F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent) & (F.col("rep") != F.col("hub")))
        links = self._verified(self._able(pairs.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))), "jaccard-links-1")
        labels = settle(components(links), "jaccard-labels")
        more = self._verified(self._products(members, labels, group_rows), "jaccard-links-2")
        self.links = links.unionAll(more)
        drop(members, *self.used)
        labels = settle(components(self.links), "jaccard-labels") if more.head(1) else labels
        n = labels.count()
        linked = firsts.join(small(labels.select(F.col("node").alias("vertex"), "comp"), n), "vertex")
        least = linked.groupBy("comp").agg(F.min("first").alias("least"))
        known = labels.join(least, "comp").select(F.col("node").alias("vertex"), "least")
        self.groups = firsts.join(small(settle(known, "jaccard-least"), n), "vertex", "left").select("vertex", F.coalesce("least", "first").alias("comp"))

    def _members(self, found: DataFrame) -> DataFrame:
        """hub, hub_n, rep, n: the rows of each hub's group."""
        step = float(np.log(100 / self.percent))
        cells = found.withColumnRenamed("vertex", "rep").join(self.rows.select("rep", (F.size("toks") / F.col("n")).alias("share")), "rep")
        cells = cells.select("tok", "rep", "n", "share", F.floor(F.log("n") / F.lit(step) + F.lit(1e-9)).alias("size"))
        hubs = cells.groupBy("tok", "size").agg(F.max(F.struct("share", "rep", "n")).alias("h"), F.count(F.lit(1)).alias("rows"))
        hubs = hubs.select("tok", F.col("h.rep").alias("hub"), F.col("h.n").alias("hub_n"), F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"))
        return cells.join(hubs, ["tok", "size"]).select("hub", "hub_n", "rep", "n").distinct()

    def _side(self, c: str) -> DataFrame:
        return self.rows.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("toks").alias(f"toks_{c}"))

    def _able(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose overlap over the shared columns and what lies behind the prefixes can reach the bound."""
        counted = pairs.distinct().join(self._side("a"), "a").join(self._side("b"), "b")
        behind = F.ceil(F.greatest("n_a", "n_b") * F.lit(self.percent) / F.lit(100)) - 1
        reach = (F.size(F.array_intersect("toks_a", "toks_b")) + behind) * (100 + self.percent)
        return counted.where(reach >= self.percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")

    def _products(self, members: DataFrame, labels: DataFrame, group_rows: int) -> DataFrame:
        """Able pairs across components from the groups that have rows outside their hub's component.

        A group is a grid: all its rows are dealt over rows of cells, those outside over columns of cells, and a cell gets group_rows of each at most, about.
        """
        n = labels.count()
        comp = lambda c, name: small(labels.select(F.col("node").alias(c), F.col("comp").alias(name)), n)
        named = members.join(comp("rep", "comp"), "rep", "left").join(comp("hub", "hub_comp"), "hub", "left")
        named = named.select("hub", "rep", F.coalesce("comp", "rep").alias("comp"), (F.coalesce("comp", "rep") != F.coalesce("hub_comp", "hub")).alias("outside"))
        named = settle(named, "jaccard-named")
        self.used = [named]
        sizes = named.groupBy("hub").agg(F.count(F.lit(1)).alias("rows"), F.count_if("outside").alias("out")).where("out > 0 and rows > 1")
        sizes = settle(sizes, "jaccard-sizes")
        self.used.append(sizes)
        size = sizes.agg(F.sum(F.col("rows") + F.col("out"))).first()[0] or 0
        sizes = sizes.select("hub", *[F.ceil(F.col(c) / F.lit(group_rows)).cast("int").alias(f"{c}_cells") for c in ("rows", "out")])
        cell = lambda r, o, outer: F.struct(r.alias("r"), o.alias("o"), F.lit(outer).alias("outer"))
        own = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
        every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
        inner = F.transform(every("out_cells"), lambda o: cell(own("rows_cells"), o, False))
        outer = F.transform(every("rows_cells"), lambda r: cell(r, own("out_cells"), True))
        dealt = named.join(sizes, "hub").withColumn("cell", F.explode(F.when(F.col("outside"), F.concat(inner, outer)).otherwise(inner)))
        dealt = dealt.join(self.rows.select("rep", "n", "toks"), "rep").select("hub", "cell.r", "cell.o", "cell.outer", "rep", "n", "comp", "toks")
        tasks = max(self.least_tasks, -(-size // (2 * group_rows)))  # work grows faster than bytes, so tasks are counted by rows
        return dealt.repartition(tasks, "hub", "r", "o").groupBy("hub", "r", "o").applyInArrow(_product(self.percent), "a long, b long").distinct()

    def _verified(self, able: DataFrame, name: str) -> DataFrame:
        """Those of the pairs whose whole sets reach the threshold."""
        able = settle(able, name + "-able")
        nodes = able.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(self.rows.select("rep", "first"), "rep")
        nodes = settle(nodes, name + "-nodes")
        n = nodes.count()
        wanted = nodes.select(F.col("first").alias("doc_id")).distinct()
        sets = self.base.join(small(wanted, n), "doc_id", "left_semi").mapInArrow(streamed(_sets(self.k)), "first long, rep long, grams binary")
        sets = sets.join(small(nodes, n), ["first", "rep"], "left_semi")
        sets = settle((sets.dropDuplicates(["rep"]) if self.repeated else sets).select("rep", "grams"), name + "-sets")
        grams = lambda c: sets.select(F.col("rep").alias(c), F.col("grams").alias(f"grams_{c}"))
        full = able.join(grams("a"), "a").join(grams("b"), "b").select("a", "b", "grams_a", "grams_b")
        links = settle(full.mapInArrow(streamed(_linked(self.percent)), "a long, b long"), name)
        drop(able, nodes, sets)
        return links

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row, and its set's vertex."""
        out = self.docs.join(self.groups, "vertex", "left")
        return out.select("vertex", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def join(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) of every row."""
    return JaccardJoin(docs, k, percent, id_col, text_col).result().drop("vertex")


def _marked(k: int, text_col: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                found = [vertex(g) for g in shingle_sets(column_bytes(part.column(part.schema.get_field_index(text_col))), k)]
                yield part.append_column(name, pa.array(found, pa.int64()))

    return run


def keep_one(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the one row of each component that bears its smallest id; a row without an id stays.

    Of rows that share an id one of each set is looked at: it goes if its own component has a smaller id.
    """
    found = settle(JaccardJoin(docs, k, percent, id_col, text_col).result().select("doc_id", "vertex", (F.col("component_id") != F.col("doc_id")).alias("gone")).where("doc_id is not null"), "jaccard-components")
    mark = "__jaccard"
    while mark in docs.columns:
        mark += "_"
    twice = settle(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(mark)), "jaccard-repeated")
    n = twice.count()
    gone = found.where("gone").select(F.col("doc_id").alias(mark)).join(small(twice, n), mark, "left_anti") if n else found.where("gone").select(F.col("doc_id").alias(mark))
    gone = settle(gone, "jaccard-gone")
    kept = docs.join(small(gone, gone.count()), docs[id_col] == F.col(mark), "left_anti")
    if not n:
        return kept
    once = kept.join(small(twice, n), kept[id_col] == F.col(mark), "left_anti")
    several = kept.join(small(twice, n), kept[id_col] == F.col(mark), "left_semi")
    several = several.mapInArrow(streamed(_marked(k, text_col, mark)), T.StructType([*docs.schema.fields, T.StructField(mark, T.LongType())]))
    away = found.where("gone").join(small(twice.withColumnRenamed(mark, "doc_id"), n), "doc_id", "left_semi").select(F.col("doc_id").alias(f"{mark}id"), F.col("vertex").alias(f"{mark}set")).distinct()
    stay = several.join(away, (several[id_col] == F.col(f"{mark}id")) & (several[mark] == F.col(f"{mark}set")), "left_anti")
    return once.unionAll(stay.dropDuplicates([id_col, mark]).drop(mark))
