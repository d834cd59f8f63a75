"""Homomorphic multiset hashes of documents, as plain DataFrame expressions.

A document is the multiset of its paragraphs (runs of lines, trimmed, empty ones left out). Each paragraph is hashed to
a wide vector of 16 lanes of 32 bits (two SHA-256 digests) and the vectors are added lane by lane modulo 2^32, so
the order of paragraphs does not matter and a paragraph is inserted or deleted by adding or subtracting its vector.
A second, narrower sum is kept over the clauses of the text (runs without marks or line ends; a clause above LONG characters is
cut again behind words that end in certain letters): 60 bits of each clause's MD5 are counted in 60 lanes. As the bits
are fair coins, 2 * lane - clauses is a random projection of the clause counts, and the cosine of two such projections
estimates the likeness of two documents (standard error about 1 / sqrt(60) = 0.13 for unlike ones, less for like ones).

Sums are homomorphic, and an edited text is treated so: what it shares with the original up to the last whole paragraph (or
clause) is hashed once, and only the tails are hashed for each.

Defined results: a null text is an empty one; a text without clauses has zero sums, is like another such text (1.0)
and unlike any other (0.0). Lanes count to 2^31, more clauses than a text can have. Null ids come first; rows that share an id (or have none) are
ordered among themselves by the MD5 of their text, and so a hot id is dealt over ranges like any others; only rows equal in id and text stay together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES, BITS, LONG = 16, 60, 200
MASK32, MASK62, SPREAD = 2**32 - 1, 2**62 - 1, 1 | 1 << 20 | 1 << 40
#: The marks that end a clause, and the words behind which a long clause is cut.
MARKS, CUT = ".,;:!?。，；：！？、", "[aeinst] +"
#: Clauses whose bits are counted together, three lanes to a long.
_TOGETHER = 2**20 - 1


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n+"), lambda x: F.trim(x)), lambda x: x != "")


def clauses(text: Column) -> Column:
    runs = F.split(text, rf"[{MARKS}\n]+")
    parts = F.flatten(F.transform(runs, lambda x: F.when(F.length(x) > LONG, F.split(x, CUT)).otherwise(F.array(x))))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def _zeros(n: int) -> Column:
    return F.array(*[F.lit(0).cast("long")] * n)


def lanes(text: Column) -> Column:
    """array<bigint> of LANES sums modulo 2^32 over the paragraphs."""
    part = lambda h, k: F.conv(F.substring(h, k * 8 + 1, 8), 16, 10).cast("long")
    digests = F.transform(paragraphs(text), lambda p: F.concat(F.sha2(p, 256), F.sha2(F.concat(F.lit("+"), p), 256)))
    vectors = F.transform(digests, lambda h: F.array(*[part(h, k) for k in range(LANES)]))
    return F.aggregate(vectors, _zeros(LANES), lambda acc, v: F.zip_with(acc, v, lambda a, b: (a + b).bitwiseAND(F.lit(MASK32))))


def _given(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column) -> Column:
    """array<bigint>: how many clauses have each of BITS bits, then the number of clauses."""
    hashes = F.transform(clauses(text), lambda c: F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long"))
    add = lambda acc, h: F.transform(acc, lambda v, k: v + F.call_function("shiftright", h, k).bitwiseAND(F.lit(SPREAD)))
    lane = lambda p, shift: F.transform(p, lambda v: F.shiftright(v, shift).bitwiseAND(F.lit(2**20 - 1)))
    counted = lambda some: _given(F.aggregate(some, _zeros(BITS // 3), add), lambda p: F.concat(lane(p, 0), lane(p, 20), lane(p, 40)))

    def sums(hs: Column) -> Column:
        n = F.size(hs)
        starts = F.sequence(F.lit(0), F.floor((n - 1) / _TOGETHER).cast("int"))
        many = F.aggregate(F.transform(starts, lambda i: counted(F.slice(hs, i * _TOGETHER + 1, F.lit(_TOGETHER)))), _zeros(BITS), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
        return F.array_append(F.when(n > _TOGETHER, many).otherwise(counted(hs)), n.cast("long"))

    return _given(hashes, sums)


def combine(a: Column, b: Column, sign: int = 1, mask: int = MASK32) -> Column:
    """Lanes after inserting (sign 1) or deleting (-1) the paragraphs whose lanes are b."""
    return F.zip_with(a, b, lambda x, y: (x + F.lit(sign) * y).bitwiseAND(F.lit(mask)))


def digest(strong: Column, weak: Column) -> Column:
    """The fingerprint as text: LANES sums, '-', then the sketch, 8 hex digits each."""
    wide = lambda a: F.array_join(F.transform(a, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")
    return F.concat(wide(strong), F.lit("-"), wide(weak))


def _signed(weak: Column) -> Column:
    """The lanes as signed projections."""
    n = F.element_at(weak, BITS + 1)
    return F.transform(F.slice(weak, 1, BITS), lambda v: v * 2 - n)


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two sketches' projections, from 0 to 1, to six places."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0).cast("long"), lambda s, v: s + v)
    dots = _given(F.struct(_signed(a).alias("x"), _signed(b).alias("y")), lambda v: F.struct(dot(v["x"], v["y"]).alias("xy"), dot(v["x"], v["x"]).alias("xx"), dot(v["y"], v["y"]).alias("yy")))
    value = lambda d: d["xy"].cast("double") / (F.sqrt(d["xx"].cast("double")) * F.sqrt(d["yy"].cast("double")))
    cosine = _given(dots, lambda d: F.when((d["xx"] == 0) | (d["yy"] == 0), F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value(d))), 6)))
    return F.when(a == b, F.lit(1.0)).otherwise(cosine)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lanes, sketch, fingerprint of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    both = docs.select(F.col(id_col).alias("doc_id"), lanes(text).alias("lanes"), sketch(text).alias("sketch"))
    return both.withColumn("fingerprint", digest(F.col("lanes"), F.col("sketch")))


def _ranges(ids: DataFrame, bucket_rows: int, most_ranges: int) -> list[tuple[int, int]]:
    """(k, h) of the first row of each range of rows in order: about bucket_rows rows a range, most_ranges of them at most (beyond, ranges grow and their sort spills).

    A k that fills more than a range is cut by its rows' uniform h.
    """
    n = ids.count()
    if not n:
        return [(0, 0)]
    buckets = max(1, min(most_ranges, -(-n // bucket_rows)))
    found = ids.select(F.min("k").alias("lo"), F.percentile_approx("k", [i / buckets for i in range(1, buckets)] or [0.5], 10 * max(1_000, buckets)).alias("q")).first()
    times = Counter(found["q"] if buckets > 1 else [])
    times[found["lo"]] = max(1, times[found["lo"]])
    cuts = sorted((k, i * 2**60 // m) for k, m in times.items() for i in range(m))
    # a range begins with its least row; ranges that got none are left out
    hot = any(m > 1 for m in times.values())
    held = ids.sparkSession.createDataFrame([(k,) for k in times], "k long")
    rows = ids if hot else ids.join(F.broadcast(held), "k", "left_semi")  # most_ranges rows at most
    firsts = rows.groupBy(_last_at_most(cuts, F.col("k"), F.col("h")).alias("b")).agg(F.min(F.struct("k", "h")).alias("f"))
    return sorted((r["f"]["k"], r["f"]["h"]) for r in firsts.collect())


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 4_000, most_ranges: int = 20_000) -> DataFrame:
    """Every row beside the next one in order (after the last: the first), its edited text and their fingerprints.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the next. Rows are dealt into
    ranges once, a task each; the first row of a range also goes, as a ghost, to the range before, where it is the next of the last.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    base = base.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("h"))
    bounds = _ranges(base.select("k", "h"), bucket_rows, most_ranges)
    rows = base.withColumn("b", _last_at_most(bounds, F.col("k"), F.col("h")))
    at = lambda which: F.element_at(F.lit([x[which] for x in bounds]).cast("array<bigint>"), F.col("b") + 1)
    heads = rows.where((F.col("k") == at(0)) & (F.col("h") == at(1))).dropDuplicates(["b"])
    ghosts = heads.withColumn("b", F.pmod(F.col("b") - 1, F.lit(len(bounds))))
    dealt = rows.withColumn("ghost", F.lit(False)).unionAll(ghosts.withColumn("ghost", F.lit(True))).repartitionById(len(bounds), F.col("b"))
    n_chars = F.length("text").cast("int")
    quarter = F.floor(n_chars / 4).cast("int")
    order = Window.partitionBy("b").orderBy("ghost", "k", "h")
    # sums of the part that the edit leaves alone, and of the rest of the own text; the next row's sketch is its own
    head = F.left(F.col("text"), n_chars - quarter)
    last = {"lanes": F.substring_index(head, "\n", -1), "sketch": F.substring_index(F.translate(head, MARKS, "\n" * len(MARKS)), "\n", -1)}
    sums = {"lanes": lanes, "sketch": sketch}
    cut = dealt.select("doc_id", "text", "k", "h", "b", "ghost", n_chars.alias("n_chars"), quarter.alias("quarter"), *[(n_chars - quarter - F.length(last[c])).alias(f"{c}_at") for c in sums])
    rest = lambda c, t: F.substring(t, F.col(f"{c}_at") + 1, F.lit(2**31 - 1))
    kept = cut.select("*", *[sums[c](F.left("text", F.col(f"{c}_at"))).alias(f"{c}_kept") for c in sums])
    own = kept.select("*", *[combine(F.col(f"{c}_kept"), sums[c](rest(c, F.col("text"))), mask=MASK62 if c == "sketch" else MASK32).alias(c) for c in sums])
    seen = own.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).where(~F.col("ghost"))
    edited = F.concat(F.left("text", F.col("n_chars") - F.col("quarter")), F.left("next_text", F.col("quarter")))
    out = seen.withColumn("edited", edited)
    tails = [combine(F.col(f"{c}_kept"), sums[c](rest(c, F.col("edited"))), mask=MASK62 if c == "sketch" else MASK32).alias(f"edited_{c}") for c in sums]
    return out.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"), "lanes", "sketch", "next_sketch", "edited", *tails)


def _last_at_most(bounds: list[tuple[int, int]], k: Column, h: Column) -> Column:
    """Index from 0 of the last of the ascending bounds at or below (k, h), 0 if none, by bisection."""
    ks, hs = (F.lit([b[i] for b in bounds]).cast("array<bigint>") for i in (0, 1))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds) - 1).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        at = F.element_at(ks, mid + 1)
        above = (at > k) | ((at == k) & (F.element_at(hs, mid + 1) > h))
        return F.struct(F.when(above, acc["lo"]).otherwise(mid).alias("lo"), F.when(above, F.greatest(acc["lo"], mid - 1)).otherwise(acc["hi"]).alias("hi"))

    steps = max(1, len(bounds).bit_length())
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["lo"]
