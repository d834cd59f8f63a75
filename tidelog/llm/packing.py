"""Best-fit packing of tokenised documents into sequences, by bin completion.

Only lengths matter for packing, so the driver sees no document: it gets the histogram of piece lengths (at most `size` rows,
whatever the corpus) and solves that. Bin completion takes the largest open length, enumerates the undominated fillings of the rest of its
sequence and branches over them, sequence by sequence, on the histogram; a branch is cut where its waste passes what the best plan
so far leaves to waste. Best-fit plans are the incumbents (see Completion). `solve` gives the plan, the lower bound and whether the plan is proven least.

Pieces are then numbered within their length (running counts inside buckets plus the counts of the buckets before, so no task
sees a whole length) and find their sequence and offset by bisection in the plan.

Defined results: a null text is an empty one and packs its end token only; rows that share an id are packed each for itself; an
empty table gives an empty result. Whole texts are tokenised.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.session import settle
from tidelog.llm.textops import streamed

#: Text on which both tokenizer libraries agree by their tables of letters, digits and spaces; any other goes to `tokenizers`.
_COMMON = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ſ]*")


#: Fixed value: how byte-level BPE files of this kind split a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library, special strings included.

    The merges of such a file are ranked by id, so tiktoken gives the same ids from the same file in a fraction of the time; it is used where its
    letter classes cannot differ and the text holds no special string.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        plain = {k: v for k, v in vocab.items() if k not in self.special}
        if [vocab.get("".join(m)) for m in merges] == list(range(256, 256 + len(merges))) and len(plain) == 256 + len(merges) and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec.get("normalizer"):
            import tiktoken

            shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 0xAD)]
            back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            ranks = {bytes(back[c] for c in k): v for k, v in plain.items()}
            self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and _COMMON.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenise(docs: DataFrame, path: str, size: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids and the end token, cut only if longer than size, the first piece the shorter one."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                rows, kept = [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(coder.ids(text or ""), np.uint32(end)).astype("<u4")
                    first = len(ids) % size or size
                    for k, lo in enumerate([0, *range(first, len(ids), size)]):
                        piece = ids[lo : first if k == 0 else lo + size]
                        rows.append((doc_id, k, lo, len(piece), zlib.crc32(piece.tobytes())))
                        if keep_ids:
                            kept.append(piece.astype(np.int32))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)] + ([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if keep_ids else []))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(streamed(run), schema)


Pattern = tuple[tuple[int, ...], int]


@dataclass
class Plan:
    """patterns: (lengths of a sequence, how often); bound: the fewest sequences that there can be; proven: whether none has fewer sequences."""

    patterns: list[Pattern]
    bound: int
    proven: bool

    @property
    def sequences(self) -> int:
        return sum(t for _, t in self.patterns)


def least_sequences(histogram: dict[int, int], size: int) -> int:
    """A lower bound: pieces of more than size - k fill a sequence against pieces of k or more, those above half of it one each, and the rest must fit in what these leave."""
    best = -(-sum(n * c for n, c in histogram.items()) // size)
    for k in [n for n in histogram if 2 * n <= size]:
        alone = sum(c for n, c in histogram.items() if n > size - k)
        half = [(n, c) for n, c in histogram.items() if size - k >= n and 2 * n > size]
        rest = sum(n * c for n, c in histogram.items() if 2 * n <= size and n >= k)
        room = sum((size - n) * c for n, c in half)
        best = max(best, alone + sum(c for _, c in half) + max(0, -(-(rest - room) // size)))
    return max(best, sum(c for n, c in histogram.items() if 2 * n > size))


def _reaches(lengths: list[int], room: int) -> list[int]:
    """For each i a number whose bit s is set if some of the first i lengths (ascending), each as often as needed, sum to s."""
    bits, full, out = 1, (1 << room + 1) - 1, [1]
    for n in lengths:
        step = n
        while step <= room:
            bits |= bits << step & full
            step *= 2
        out.append(bits)
    return out


def best_fit(histogram: dict[int, int], size: int) -> list[Pattern]:
    """Patterns of best-fit decreasing."""
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []  # the keys of open_, ascending

    def hold(room: int, pattern: tuple[int, ...], times: int) -> None:
        if room not in open_:
            insort(rooms, room)
        open_.setdefault(room, []).append([pattern, times])

    for n in sorted(histogram, reverse=True):
        c = histogram[n]
        while c:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                per = size // n
                count, take = (per, c // per) if c >= per else (c, 1)
                hold(size - n * count, (n,) * count, take)
                c -= take * count
                continue
            room = rooms[at]
            group = open_[room][-1]
            take = min(c, group[1])
            group[1] -= take
            if not group[1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            hold(room - n, (*group[0], n), take)
            c -= take
    return [(tuple(p), t) for groups in open_.values() for p, t in groups]


class Completion:
    """Bin completion on a histogram of lengths.

    A node of the search is what is still open. Its children are the fillings around the largest open length, those with least waste first: each as
    often as the counts allow, and then once, so that every packing can be reached. Left out are fillings that waste more than the best plan so far leaves
    to waste, and dominated ones: where an open length fits into the waste, or can take the place of one, two or three pieces that it is at least as long as.
    The search allows no departure from the first child, then one, two and so on, until nothing is cut off (then the plan is proven), the lower
    bound is met, or `budget` steps are spent. The incumbent is best-fit decreasing, of the whole and of what nodes leave open.
    """

    def __init__(self, histogram: dict[int, int], size: int, budget: int):
        self.size, self.left = size, budget
        self.bound = least_sequences(histogram, size)
        self.best = best_fit(histogram, size)
        self.fewest = sum(t for _, t in self.best)
        self.total = sum(n * c for n, c in histogram.items())
        self.proven = self.fewest <= self.bound
        departures = 0
        while not self.proven and self.left > 0:
            self.cut = False
            self._search(dict(histogram), departures)
            self.proven = self.fewest <= self.bound or (not self.cut and self.left > 0)
            departures = 2 * departures + 1

    def _fillings(self, counts: dict[int, int], lengths: list[int], reaches: list[int], spare: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """(filling around the largest length, its waste) for a waste of up to spare, the least first, dominated ones left out."""
        top = lengths[-1]
        room = self.size - top
        own = {top: 1}
        for waste in range(min(spare, room) + 1):
            if not reaches[-1] >> (room - waste) & 1:
                continue
            stack: list[tuple[int, int, tuple[int, ...]]] = [(room - waste, len(lengths), ())]
            while stack:
                self.left -= 1
                if self.left <= 0:
                    return
                left, at, chosen = stack.pop()
                if not left:
                    if not self._dominated(chosen, waste, counts, lengths, top):
                        yield (top, *chosen), waste
                    continue
                at = min(at, bisect_right(lengths, left))
                if not at or not reaches[at] >> left & 1:
                    continue
                n = lengths[at - 1]
                stack.append((left, at - 1, chosen))
                held = own.get(n, 0)
                for x in reversed(chosen):
                    if x != n:
                        break
                    held += 1
                if held < counts[n] and reaches[at] >> (left - n) & 1:
                    stack.append((left - n, at, (*chosen, n)))

    def _dominated(self, chosen: tuple[int, ...], waste: int, counts: dict[int, int], lengths: list[int], top: int) -> bool:
        def free(lo: int, hi: int) -> bool:
            """Whether a length from lo to hi is open beyond what the filling takes."""
            i = bisect_left(lengths, lo)
            while i < len(lengths) and lengths[i] <= hi:
                if counts[lengths[i]] > chosen.count(lengths[i]) + (lengths[i] == top):
                    return True
                i += 1
            return False

        if waste and (free(1, waste) or any(free(n + 1, n + waste) for n in set(chosen))):
            return True
        return any(free(s, s + waste) for k in (2, 3) for s in {sum(x) for x in combinations(chosen[-8:], k)} if s <= top)

    def _search(self, start: dict[int, int], departures: int) -> None:
        """Depth first, with at most so many departures from the first child on a path."""
        path: list[Pattern] = []
        lengths = sorted(start)
        nodes = [(start, lengths, _reaches(lengths, self.size), 0, 0, departures, None)]  # open, lengths, reaches, sequences, waste, departures left, children
        while nodes:
            counts, lengths, reaches, used, wasted, may, children = nodes[-1]
            if children is None:
                if self._done(counts, used, path):
                    nodes.pop()
                    path and path.pop()
                    continue
                children = self._children(counts, lengths, reaches, used, wasted)
                nodes[-1] = (counts, lengths, reaches, used, wasted, may, children)
            step = next(children, None)
            if step is None or self.left <= 0 or self.fewest <= self.bound:
                nodes.pop()
                path and path.pop()
                continue
            (filling, times, waste), nth = step
            if nth > may:
                self.cut = True
                nodes.pop()
                path and path.pop()
                continue
            rest = dict(counts)
            for n in filling:
                rest[n] -= times
            gone = [n for n in set(filling) if not rest[n]]
            for n in gone:
                del rest[n]
            open_ = [n for n in lengths if n in rest] if gone else lengths
            path.append((filling, times))
            nodes.append((rest, open_, _reaches(open_, self.size) if gone else reaches, used + times, wasted + times * waste, may - nth, None))

    def _done(self, counts: dict[int, int], used: int, path: list[Pattern]) -> bool:
        """Whether the node needs no children. What it leaves open is packed by best fit now and then, always where little is left."""
        open_ = sum(n * c for n, c in counts.items())
        if used + -(-open_ // self.size) >= self.fewest:
            return True
        if len(counts) <= 64 or len(path) % 32 == 0:
            self.left -= 4 * len(counts)
            tail = best_fit(counts, self.size)
            fewest = used + sum(t for _, t in tail)
            if fewest < self.fewest:
                self.fewest, self.best = fewest, [*path, *tail]
        return self.fewest <= self.bound or not counts

    def _children(self, counts: dict[int, int], lengths: list[int], reaches: list[int], used: int, wasted: int) -> Iterator[tuple[tuple[tuple[int, ...], int, int], int]]:
        nth, again = 0, []
        spare = lambda: (self.fewest - 1) * self.size - self.total - wasted
        for filling, waste in self._fillings(counts, lengths, reaches, max(-1, spare())):
            times = min(counts[n] // filling.count(n) for n in set(filling))
            if times > 1:
                again.append((filling, waste))
                times = min(times, spare() // waste if waste else times)
            if times and times * waste <= spare():
                yield (filling, times, waste), nth
                nth += 1
        for filling, waste in again:
            if waste <= spare():
                yield (filling, 1, waste), nth
                nth += 1


def solve(histogram: dict[int, int], size: int, budget: int = 1_000_000) -> Plan:
    """The plan of bin completion for a histogram of lengths; budget: steps of the search (about a microsecond each), at the end of which the best plan so far stands."""
    histogram = {n: c for n, c in histogram.items() if c}
    if not histogram:
        return Plan([], 0, True)
    found = Completion(histogram, size, budget)
    return Plan(found.best, found.bound, found.proven)


def _slots(plan: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length: ranks from `rank` on go to sequences from `first` on, `per` to a sequence, from `offset` on."""
    seen: dict[int, int] = {}
    rows, first = [], 0
    for pattern, times in plan:
        at = 0
        for n in dict.fromkeys(pattern):
            per = pattern.count(n)
            rows.append((n, seen.get(n, 0), first, per, at))
            seen[n] = seen.get(n, 0) + per * times
            at += n * per
        first += times
    rows.sort()
    return dict(zip(("length", "rank", "first", "per", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def place(pieces: DataFrame, size: int = 1024, bucket_rows: int = 20_000, budget: int = 1_000_000) -> DataFrame:
    """All columns of the pieces (doc_id, piece, length among them), sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # size rows at most
    if any(not 0 < n <= size for n in histogram):
        raise ValueError(f"lengths lie between 1 and {size}")
    slots = _slots(solve(histogram, size, budget).patterns)
    buckets = max(1, -(-sum(histogram.values()) // bucket_rows))
    mark = "__place"
    while any(c.startswith(mark) for c in pieces.columns):
        mark += "_"
    bucket, ahead, inside, rank = (f"{mark}{c}" for c in ("bucket", "ahead", "inside", "rank"))
    # by all plain columns, so that pieces without an id are dealt too and a rerun numbers them alike
    plain = [f.name for f in pieces.schema.fields if isinstance(f.dataType, (T.AtomicType, T.NumericType))]
    rows = pieces.withColumn(bucket, F.pmod(F.xxhash64(*plain), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("length", bucket).agg(F.count(F.lit(1)).alias("n")).select("length", bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(ahead))
    within = Window.partitionBy("length", bucket).orderBy("doc_id", "piece", *[c for c in plain if c not in ("doc_id", "piece")])
    ranked = rows.withColumn(inside, F.row_number().over(within) - 1).join(sums, ["length", bucket]).select(*pieces.columns, (F.col(ahead) + F.col(inside)).alias(rank))
    held = pieces.sparkSession.sparkContext.broadcast(slots)  # five numbers a slot, bounded by the square of size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        keys = plan["length"] << 44 | plan["rank"]
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("length")).to_numpy()
            nth = batch.column(batch.schema.get_field_index(rank)).to_numpy()
            at = np.searchsorted(keys, n << 44 | nth, "right") - 1
            later = nth - plan["rank"][at]
            sequence = plan["first"][at] + later // plan["per"][at]
            offset = plan["offset"][at] + later % plan["per"][at] * n
            rest = [c for c in batch.schema.names if c != rank]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array(sequence), pa.array(offset)], [*rest, "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(streamed(run), schema)


def pack(docs: DataFrame, path: str, size: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset of every piece."""
    return place(settle(tokenise(docs, path, size, end, id_col, text_col, keep_ids), "packing-pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids of pieces packed with keep_ids; a sequence holds size ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
