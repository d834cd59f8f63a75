"""The visibility operators against a small model in plain Python, and plans that reach the scan."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import files, pages
from tidelog.operators import fold, visible
from tidelog.schema import InvalidInput

EVENTS = "stream string, version long, global_seq long, event_type string, data string, cents long, ts_ms long, commit_pos long"


def model(events, trims, rollbacks, deletes, forks, root):
    """(stream, version, data) of a root's history, read the long way."""
    best = {}
    for e in events:
        if (e[0], e[1]) not in best or best[e[0], e[1]][7] < e[7]:
            best[e[0], e[1]] = e
    pins = {}
    for child, parent, at in forks:
        if child not in deletes:
            pins[parent] = max(at, pins.get(parent, -1))

    def visible_events(stream, hi):
        out = []
        for (s, v), e in sorted(best.items()):
            if s != stream or v >= hi or v < trims.get(s, 0):
                continue
            if any(r == s and v >= f and e[2] > t for r, f, t in rollbacks) or (s in deletes and v > pins.get(s, -1)):
                continue
            out.append((s, v, e[4]))
        return out

    parents = {c: (p, at) for c, p, at in forks}

    def history(stream, hi):
        up = history(parents[stream][0], min(hi, parents[stream][1] + 1)) if stream in parents else []
        return up + visible_events(stream, hi)

    return history(root, 2**63 - 1)


@pytest.mark.parametrize("seed", range(6))
def test_history_equals_the_model(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d"]
    forks = [("b", "a", rng.randint(0, 5)), ("c", "b", rng.randint(0, 8))][: rng.randint(0, 2)]
    events, seq = [], 0
    for s in names:
        for v in [*range(rng.randint(1, 10)), *rng.sample(range(8), rng.randint(0, 4))]:
            seq += 1
            events.append((s, v, seq, "e", f"{s}{v}@{seq}", v, seq * 10, seq))
    trims = {s: rng.randint(0, 4) for s in names if rng.random() < 0.4}
    rollbacks = [(s, rng.randint(0, 6), rng.randint(0, seq)) for s in names if rng.random() < 0.4]
    deletes = {s for s in names if rng.random() < 0.3}
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    f = df(forks, "child string, parent string, at_version long")
    shown = visible.guarded(visible.lww(df(events, EVENTS)), df(list(trims.items()), "stream string, floor long"), df(rollbacks, "stream string, from_version long, txn long"), df([(x,) for x in deletes], "stream string"), f)
    rows = visible.history(shown, visible.lineage(f, df([(n,) for n in names], "root string"))).collect()
    for root in names:
        got = [(r["stream"], r["version"], r["data"]) for r in sorted(rows, key=lambda r: (-r["depth"], r["version"])) if r["root"] == root]
        assert got == model(events, trims, rollbacks, deletes, forks, root)


def test_cycles_and_transitive_pins(spark):
    forks = spark.createDataFrame([("b", "a", 4), ("c", "b", 2)], "child string, parent string, at_version long")
    gone = spark.createDataFrame([("b",)], "stream string")
    assert {r["stream"]: r["ceiling"] for r in visible.pins(forks, gone).collect()} == {"b": 2}
    assert {r["stream"]: r["ceiling"] for r in visible.pins(forks, gone, transitive=True).collect()} == {"b": 2, "a": 2}
    loop = spark.createDataFrame([("x", "y", 1), ("y", "x", 1)], "child string, parent string, at_version long")
    with pytest.raises(InvalidInput):
        visible.lineage(loop, spark.createDataFrame([("x",)], "root string"))


def test_lineage_of_any_depth(spark):
    """A chain of 150 forks, a bush beside it and a lone stream, against walking up."""
    rng = random.Random(3)
    forks = {f"c{i}": (f"c{i - 1}", rng.randint(0, 400)) for i in range(1, 151)} | {f"b{i}": (f"c{rng.randrange(150)}", i) for i in range(20)}
    df = spark.createDataFrame([(c, p, a) for c, (p, a) in forks.items()], "child string, parent string, at_version long")
    roots = ["c0", "c1", "c77", "c150", "b3", "b19", "lone"]
    got = {(r["root"], r["seg"], r["hi"], r["depth"]) for r in visible.lineage(df, spark.createDataFrame([(x,) for x in roots], "root string")).collect()}
    want = set()
    for root in roots:
        seg, hi, depth = root, 2**63 - 1, 0
        while True:
            want.add((root, seg, hi, depth))
            if seg not in forks:
                break
            seg, at = forks[seg]
            hi, depth = min(hi, at + 1), depth + 1
    assert got == want
    assert visible.lineage(df.limit(0), spark.createDataFrame([("x",)], "root string")).count() == 1


def test_bounds():
    assert visible.bounds() == (0, 2**63 - 1) and visible.bounds(3, 5, lo_open=True, hi_closed=True) == (4, 6) and visible.bounds(5, 3) == (5, 3)


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("s", 1, 1, "e", "d", 1, 1, 1)], EVENTS).write.parquet(str(tmp_path / "e"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = visible.in_range(visible.lww(spark.read.parquet(str(tmp_path / "e"))), 3, 9).where("stream = 's'").select("stream", "version", "cents")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(version,3)" in plan and "EqualTo(stream,s)" in plan and "event_type" not in plan.split("ReadSchema")[1]


def test_python_folds_resume_from_snapshots(spark):
    class Text:
        def __init__(self, start=""):
            self.text = start

        def apply(self, event):
            self.text += event.data

        def snapshot(self):
            return self.text.encode()

        @classmethod
        def restore(cls, data):
            return cls(data.decode())

    rows = [(s, v, v, "e", f"{s}{v} ", v, v, v) for s in "ab" for v in range(5)]
    ev = spark.createDataFrame(rows, EVENTS)
    assert {r["stream"]: bytes(r["state"]) for r in fold.python_fold(ev, Text).collect()} == {s: "".join(f"{s}{v} " for v in range(5)).encode() for s in "ab"}
    snaps = spark.createDataFrame([("a", b"A+", 2)], "stream string, state binary, through_version long")
    assert {r["stream"]: bytes(r["state"]) for r in fold.python_fold(ev, Text, snapshots=snaps).collect()}["a"] == b"A+a3 a4 "


def test_blocks_and_ranges(spark):
    df = spark.createDataFrame([("f", bytes(range(256)) * 10), ("g", b"")], "path string, content binary")
    b = files.split_blocks(df, "path", "content", 1000)
    assert [r["len"] for r in b.orderBy("block").collect()] == [1000, 1000, 560]
    data = bytes(range(256)) * 10
    assert bytes(files.read_range(b, "path", 990, 1500).first()["content"]) == data[990:2490]
    assert files.new_blocks(b, b.where("block = 1")).count() == 2
    s = spark.createDataFrame([(b"abc", 6, b"xyz"), (None, 0, b"q"), (b"abcdef", 1, b"ZZ")], "c binary, o long, d binary").select(files.splice(F.col("c"), F.col("o"), F.col("d")).alias("x")).collect()
    assert [bytes(r["x"]) for r in s] == [b"abc\0\0\0xyz", b"q", b"aZZdef"]


def test_segments_merge_newest_first(spark):
    rows = [("v", 0, "/a", False, 1), ("v", 0, "/a/x", False, 2), ("v", 1, "/a", True, None), ("v", 2, "/a/y", False, 3), ("v", 1, "/b", False, 4), ("v", 2, "/b", False, 5)]
    out = files.merge_segments(spark.createDataFrame(rows, "vol string, seg_ord int, path string, tombstone boolean, node int"))
    assert sorted((r["path"], r["node"]) for r in out.collect()) == [("/a/y", 3), ("/b", 5)]


def test_restore_needs_the_transaction(spark):
    log = spark.createDataFrame([(1, 1, 0, 1, "a"), (1, 2, 0, 1, "b")], "db long, txid long, frame_idx int, pgno long, data string")
    assert [r["data"] for r in pages.restore_at(pages.seal(log, 1).where("txid = 1"), log, 2).collect()] == ["b"]
    with pytest.raises(InvalidInput):
        pages.restore_at(pages.seal(log, 1), log, 3)
    gap = spark.createDataFrame([(1, t, 0, 1, str(t)) for t in (1, 2, 4, 5)], "db long, txid long, frame_idx int, pgno long, data string")
    with pytest.raises(InvalidInput, match="missing"):
        pages.restore_at(pages.seal(gap, 1).where("txid <= 2"), gap, 5)
    assert [r["data"] for r in pages.restore_at(pages.seal(gap, 1).where("txid <= 4"), gap, 5).collect()] == ["5"]
