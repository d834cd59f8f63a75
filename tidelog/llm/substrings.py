"""Substring dedup with suffix automata of reference shards.

Two entrances. `against` takes a bounded reference (licence lines, a benchmark): it is cut into shards, each shard becomes a suffix automaton, the
automata are broadcast behind a check of their size, and documents are streamed through them for matching statistics. `remove_repeats` takes
the corpus as its own reference. That has no size bound and cannot be broadcast (README: 5,400 CPU seconds a GB at half a GB, more with every GB), so here each shard stays with the task that owns it and the
passages travel: every window of `words` words chooses an anchor (its smallest hashed 5-gram), anchors that one document
alone has are out, and what lies around the others (its windows' words) goes to the anchor's shard. There the passages of documents in
ascending id feed a suffix automaton that later ones are matched against: where the matching statistic reaches `words`, the words of the match are
removed. Equal windows choose equal anchors, so no repeat is missed; a match is a run of equal words, so nothing else is removed.

Copies are dealt with before the shuffle: of equal passages in a batch only that of the smallest id travels, and the others are known to
be repeats, so a passage that a third of all documents have costs one per batch. Where very many documents have an anchor, in whatever surroundings, their
passages are cut into windows that meet by all their words.

Defined results: a null text has no words; a row with a null id counts as the largest id; rows that share an id are one document as far as the
order goes (none is smaller), and repeated rows are treated alike; whole texts are read. Words are compared by 32-bit hashes in runs of
`words`, which is `words` times 32 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.textops import Words, column_bytes, mix64, pieces, streamed, windows
from tidelog.session import settle

GRAM = 5
_U = np.uint64
NONE = 2**63 - 1


class SuffixAutomaton:
    """A suffix automaton of several sequences of hashable symbols; `feed` adds one, `statistics` matches one."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def feed(self, symbols) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for c in symbols:
            q = nexts[last].get(c)
            if q is not None:  # this prefix is there already: go to it, cut off a longer state if it is one
                last = q if length[q] == length[last] + 1 else self._split(last, q, c)
                continue
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            last = cur

    def _split(self, p: int, q: int, c) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def statistics(self, symbols) -> list[int]:
        """For each position, how long the longest run ending there is that some fed sequence has."""
        out, state, n = [], 0, 0
        nexts, link, length = self.next, self.link, self.length
        for c in symbols:
            while state and c not in nexts[state]:
                state = link[state]
                n = length[state]
            to = nexts[state].get(c)
            if to is None:
                state = n = 0
            else:
                state, n = to, n + 1
            out.append(n)
        return out


def matched_spans(statistics: list[int], words: int) -> list[tuple[int, int]]:
    """Maximal spans (first word, end) covered by matches of at least `words` words."""
    out: list[list[int]] = []
    for i, n in enumerate(statistics):
        if n >= words:
            lo = i + 1 - n
            while out and lo <= out[-1][1]:
                lo = min(lo, out.pop()[0])
            out.append([lo, i + 1])
    return [(a, b) for a, b in out]


def passages(words: Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor hash, text index, first word and last window's first word of each run of windows with one anchor."""
    n = len(h) - size + 1
    if n <= 0:
        nothing = np.zeros(0, np.int64)
        return nothing.astype(_U), nothing, nothing, nothing
    grams = windows(h, GRAM)
    span = size - GRAM + 1
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span):
        other = grams[j : j + n]
        less = other < best
        best[less] = other[less]
        at[less] = j
    start = np.flatnonzero(words.doc[:n] == words.doc[size - 1 :])
    if not len(start):
        return start.astype(_U), start, start, start
    place = at[start] + start
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return best[start[first]], words.doc[start[first]], start[first], start[last]


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


_ANCHOR = np.dtype([("anchor", "<u8"), ("rid", "<i8")])
_COUNTED = np.dtype([*_ANCHOR.descr, ("docs", "<u4")])


def _packed(keys: np.ndarray, rows: np.ndarray, blocks: int) -> tuple[list[int], list[bytes]]:
    at = (mix64(keys) % _U(blocks)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    cut = np.flatnonzero(np.diff(at, prepend=-1))
    return at[cut].tolist(), [rows[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(at)), strict=True)]


def _anchors(size: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rids = column_bytes(batch.column(2)), batch.column(0).to_numpy()
            found = []
            for lo, hi in pieces(texts):
                w = Words(texts[lo:hi])
                anchor, doc, _, _ = passages(w, w.hashes(), size)
                rows = np.zeros(len(anchor), _ANCHOR)
                rows["anchor"], rows["rid"] = anchor, rids[lo:hi][doc]
                found.append(np.unique(rows))
            rows = np.unique(np.concatenate(found)) if found else np.zeros(0, _ANCHOR)
            if not len(rows):
                continue
            first = np.ones(len(rows), bool)
            first[1:] = rows["anchor"][1:] != rows["anchor"][:-1]
            group = np.cumsum(first) - 1
            docs = np.bincount(group)
            shared = docs[group] > 1
            heads = np.zeros(len(docs), _COUNTED)
            heads["anchor"], heads["rid"], heads["docs"] = rows["anchor"][first], rows["rid"][first], docs
            keys, packs = _packed(heads["anchor"], heads, blocks)
            local = rows[shared]  # known to be shared here: these need no meeting, only a way out
            more, most = _packed(local["rid"].view(_U), local, blocks) if len(local) else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(keys + more, pa.int32()), pa.array([False] * len(keys) + [True] * len(more)), pa.array(packs + most, pa.binary())], ["block", "known", "rows"])

    return run


def _shared_anchors(hot_docs: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Documents and their anchors that other documents have too; and, in a row without a document, the anchors that at least hot_docs have."""
        data, hot = b"".join(table.column("rows").to_pylist()), np.zeros(0, _U)
        if key[1].as_py():
            rows = np.frombuffer(data, _ANCHOR)
        else:
            heads = np.frombuffer(data, _COUNTED)
            heads = heads[np.argsort(heads["anchor"], kind="stable")]
            cut = _starts(heads["anchor"])
            if len(cut):
                hot = heads["anchor"][cut][np.add.reduceat(heads["docs"].astype(np.int64), cut) >= hot_docs]
            rows = np.zeros(len(heads), _ANCHOR)
            rows["anchor"], rows["rid"] = heads["anchor"], heads["rid"]
            rows = np.unique(rows)
            first = np.ones(len(rows), bool)
            first[1:] = rows["anchor"][1:] != rows["anchor"][:-1]
            group = np.cumsum(first) - 1
            rows = rows[np.bincount(group)[group] > 1]
        rows = rows[np.argsort(rows["rid"], kind="stable")]
        cut = _starts(rows["rid"])
        ends = np.append(cut[1:], len(rows)) if len(rows) else cut
        rids, lists = rows["rid"][cut].tolist(), [rows["anchor"][a:b].tobytes() for a, b in zip(cut, ends, strict=True)]
        if len(hot):
            rids, lists = [*rids, None], [*lists, hot.tobytes()]
        return pa.table({"rid": pa.array(rids, pa.int64()), "anchors": pa.array(lists, pa.binary())})

    return run


def _entry(size: int) -> np.dtype:
    return np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("rid", "<i8"), ("first", "<i8"), ("n", "<i4"), ("words", "<u4", (2 * size - GRAM,))])


_SPAN = np.dtype([("rid", "<i8"), ("first", "<i8"), ("end", "<i8")])


def _meetings(size: int, blocks: int, hot):
    """Passages around shared anchors, for their shards; of equal ones in a batch that of the smallest id, the others being repeats already.

    A hot anchor (one of the broadcast, sorted ones) has passages in many surroundings: there each window is a passage of its own, filed under all its words, so only equal ones meet.
    """
    kind = _entry(size)
    wide = 2 * size - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rids = column_bytes(batch.column(2)), batch.column(0).to_numpy()
            ids = np.array([NONE if x is None else x for x in batch.column(1).to_pylist()], np.int64)
            lists = [np.frombuffer(b"".join(x), _U) for x in batch.column(3).to_pylist()]
            entries, prints = [], []
            for lo, hi in pieces(texts):
                w = Words(texts[lo:hi])
                h = w.hashes()
                anchor, doc, first, last = passages(w, h, size)
                if not len(anchor):
                    continue
                keep = np.concatenate([np.isin(anchor[a:b], lists[lo + d]) for d in range(hi - lo) if (a := np.searchsorted(doc, d)) <= (b := np.searchsorted(doc, d, "right"))])
                anchor, doc, first, last = anchor[keep], doc[keep], first[keep], last[keep]
                if len(hot.value) and (many := np.isin(anchor, hot.value)).any():
                    times = (last - first + 1)[many]
                    start = np.repeat(first[many], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    anchor = np.concatenate((anchor[~many], mix64(windows(h, size)[start])))
                    doc, first, last = np.concatenate((doc[~many], np.repeat(doc[many], times))), np.concatenate((first[~many], start)), np.concatenate((last[~many], start))
                rows = np.zeros(len(anchor), kind)
                rows["anchor"], rows["doc"], rows["rid"] = anchor, ids[lo:hi][doc], rids[lo:hi][doc]
                rows["first"], rows["n"] = first - w.first[doc], last - first + size
                at = first[:, None] + np.arange(wide)
                inside = np.arange(wide) < rows["n"][:, None]
                value = np.where(inside, h[np.minimum(at, max(0, len(h) - 1))], _U(0))
                rows["words"] = (value >> _U(32)).astype("<u4")
                prints.append(mix64((value * (mix64(np.arange(wide).astype(_U) + _U(1)) | _U(1))).sum(axis=1, dtype=_U) ^ anchor ^ rows["n"].astype(_U)))
                entries.append(rows)
            if not entries:
                continue
            rows, mark = np.concatenate(entries), np.concatenate(prints)
            order = np.lexsort((rows["first"], rows["rid"], rows["doc"], mark))
            rows, mark = rows[order], mark[order]
            head = np.ones(len(rows), bool)
            head[1:] = mark[1:] != mark[:-1]
            least = rows["doc"][np.flatnonzero(head)][np.cumsum(head) - 1]
            repeat = rows["doc"] > least
            spans = np.zeros(int(repeat.sum()), _SPAN)
            spans["rid"], spans["first"], spans["end"] = rows["rid"][repeat], rows["first"][repeat], rows["first"][repeat] + rows["n"][repeat]
            keys, packs = _packed(rows["anchor"][~repeat], rows[~repeat], blocks)
            more, most = _packed(spans["rid"].view(_U), spans, blocks) if len(spans) else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(keys + more, pa.int32()), pa.array([False] * len(keys) + [True] * len(more)), pa.array(packs + most, pa.binary())], ["block", "known", "rows"])

    return run


def shard_spans(rows: np.ndarray, size: int) -> np.ndarray:
    """Spans of a shard's passages that an earlier document has, anchor by anchor through a suffix automaton."""
    rows = rows[np.lexsort((rows["first"], rows["rid"], rows["doc"], rows["anchor"]))]
    cut = _starts(rows["anchor"])
    out: list[tuple[int, int, int]] = []
    lengths = rows["n"].tolist()
    ids, rids, firsts = rows["doc"].tolist(), rows["rid"].tolist(), rows["first"].tolist()
    raw = rows["words"]
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)], strict=True):
        if ids[a] == ids[b - 1]:
            continue
        automaton, owners = None, {}
        i, pending = a, []
        while i < b:
            j = i
            while j < b and ids[j] == ids[i]:
                j += 1
            if i > a and pending:  # feed what earlier documents brought
                if automaton is None:
                    automaton = SuffixAutomaton()
                for text in pending:
                    automaton.feed(text)
                pending = []
            new = {}
            for k in range(i, j):
                n = lengths[k]
                key = raw[k, :n].tobytes()
                if key in owners:
                    out.append((rids[k], firsts[k], firsts[k] + n))
                    continue
                text = raw[k, :n].tolist()
                if automaton is not None:
                    out += [(rids[k], firsts[k] + lo, firsts[k] + hi) for lo, hi in matched_spans(automaton.statistics(text), size)]
                new[key] = text
            owners |= dict.fromkeys(new)
            pending += new.values()
            i = j
    found = np.zeros(len(out), _SPAN)
    if out:
        found["rid"], found["first"], found["end"] = np.array(out, np.int64).T
    return found


def _resolved(size: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        data = b"".join(table.column("rows").to_pylist())
        spans = np.frombuffer(data, _SPAN) if key[1].as_py() else shard_spans(np.frombuffer(data, _entry(size)), size)
        spans = spans[np.argsort(spans["rid"], kind="stable")]
        cut = _starts(spans["rid"])
        ends = np.append(cut[1:], len(spans)) if len(spans) else cut
        return pa.table({"rid": pa.array(spans["rid"][cut].copy(), pa.int64()), "spans": pa.array([np.stack((spans["first"][a:b], spans["end"][a:b]), axis=1).astype("<i8").tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())})

    return run


def covered(n: int, spans: np.ndarray) -> np.ndarray:
    """Which of n words lie in some of the spans (first, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, spans[:, 0], 1)
    np.add.at(step, spans[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            n_words, n_removed, kept = [], [], []
            for text, lists in zip(column_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                words = text.split()  # at space, \t, \n, \v, \f and \r, as bytes are
                gone = 0
                if lists:
                    mask = covered(len(words), np.frombuffer(b"".join(lists), "<i8").reshape(-1, 2))
                    gone = int(mask.sum())
                n_words.append(len(words))
                n_removed.append(gone)
                kept.append(b" ".join([w for w, x in zip(words, mask.tolist(), strict=True) if not x] if gone else words).decode())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, words: int = 13, id_col: str = "doc_id", text_col: str = "text", most: int = 200_000, block_rows: int = 2_000, hot_docs: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words joined by single spaces) of every row, against all rows of smaller id.

    A block holds the passages of about block_rows rows; anchors of hot_docs documents or more (2,000 or a 10,000th of all) are split by window; ids of documents that share something are broadcast up to `most` of them.
    """
    base = docs.select(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = base.count()
    hot_docs = hot_docs or max(2_000, rows // 10_000)
    blocks = max(8, -(-rows // block_rows))  # a task each, as many as the input asks for, so none grows with it
    packed = base.mapInArrow(streamed(_anchors(words, blocks)), "block int, known boolean, rows binary")
    shared = packed.repartitionById(blocks, F.col("block")).groupBy("block", "known").applyInArrow(_shared_anchors(hot_docs), "rid long, anchors binary")
    every = settle(shared.repartition(blocks, "rid").groupBy("rid").agg(F.collect_list("anchors").alias("anchors")), "substrings-anchors")
    hot = every.where("rid is null").select("anchors").toArrow().column(0).to_pylist()  # one row: at most 10,000 times the anchors of a mean document, 8 bytes each
    hot = docs.sparkSession.sparkContext.broadcast(np.sort(np.frombuffer(b"".join(x for row in hot for x in row), _U)))
    shared = every.where("rid is not null")
    few = shared.select("rid")
    n = few.count()
    held = base.join(F.broadcast(few), "rid", "left_semi") if n <= most else base
    meeting = held.repartition(blocks, "rid").join(shared.repartition(blocks, "rid"), "rid").select("rid", "doc_id", "text", "anchors").mapInArrow(streamed(_meetings(words, blocks, hot)), "block int, known boolean, rows binary")
    spans = meeting.repartitionById(blocks, F.col("block")).groupBy("block", "known").applyInArrow(_resolved(words), "rid long, spans binary")
    spans = settle(spans.repartition(blocks, "rid").groupBy("rid").agg(F.collect_list("spans").alias("spans")), "substrings-spans")
    hit = spans.select("rid")
    schema = "doc_id long, n_words long, n_removed long, kept string"
    if hit.count() <= most:
        marked = F.broadcast(hit)
        whole = base.join(marked, "rid", "left_anti").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("spans"))
        parts = base.join(marked, "rid", "left_semi").join(spans, "rid").select("doc_id", "text", "spans")
        return whole.mapInArrow(streamed(_cut), schema).unionAll(parts.mapInArrow(streamed(_cut), schema))
    return base.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(streamed(_cut), schema)


def against(docs: DataFrame, reference: DataFrame, words: int = 13, id_col: str = "doc_id", text_col: str = "text", ref_col: str = "text", shard_words: int = 100_000, most_words: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept: words of maximal spans of at least `words` words that some reference text has are removed.

    The reference may have most_words words at most (checked): an automaton takes about 360 bytes a word in each Python worker, so 72 MB by
    default. The automata are broadcast shard by shard, shard_words words each.
    """
    texts = [r[0] for r in reference.select(F.col(ref_col).cast("string")).where(F.col(ref_col).isNotNull()).limit(most_words + 1).toLocalIterator()]
    tokens = [t.encode().split() for t in texts]
    if sum(map(len, tokens)) > most_words:
        raise ValueError(f"the reference has more than {most_words} words; use remove_repeats")
    shards, room = [[]], shard_words
    for t in tokens:
        if room < len(t) and shards[-1]:
            shards.append([])
            room = shard_words
        shards[-1].append(t)
        room -= len(t)
    automata = []
    for shard in shards:
        a = SuffixAutomaton()
        for t in shard:
            a.feed(t)
        automata.append(docs.sparkSession.sparkContext.broadcast((a.next, a.link, a.length)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = []
        for b in automata:
            m = SuffixAutomaton()
            m.next, m.link, m.length = b.value
            machines.append(m)
        for batch in batches:
            rows = []
            for text in column_bytes(batch.column(1)):
                found = text.split()
                spans = [s for m in machines for s in matched_spans(m.statistics(found), words)]
                mask = covered(len(found), np.array(spans, np.int64).reshape(-1, 2))
                rows.append((len(found), int(mask.sum()), b" ".join([w for w, x in zip(found, mask.tolist(), strict=True) if not x]).decode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(streamed(run), "doc_id long, n_words long, n_removed long, kept string")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

