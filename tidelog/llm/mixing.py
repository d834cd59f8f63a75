"""Mixing sources to target weights.

Every row gets a hash-random key. Within a source the rows are dealt by key range into buckets, each
bucket is sorted, and the sums of the buckets before it turn its running sums into a prefix sum over
the whole source without any task seeing a whole source. A source is cut where the prefix sum meets
its exact budget; a target above the source's size is met by whole epochs plus such a cut.

Defined results: a null text or one without words has size 0 and nothing is taken of it; a null source
is a source of its own, last in order; rows that share an id count each for itself, and the key is drawn from id and
text, so a source whose ids are all null is dealt over its buckets like any other; rows equal in source, id and text share a
key, are counted as one row before they are sorted and then get the shares that single rows would get one after the other;
an empty table gives an empty result. Only the three named columns are read, so further columns, whatever their names, do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import settle

WORDS = r"[^\x20\x09-\x0D]+"


def _key(id_col: str, text_col: str, seed: str) -> Column:
    """32 hex digits, uniform, the same for rows equal in id and text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), text(id_col), F.lit(":"), F.md5(text(text_col))))


def _src(source_col: str) -> Column:
    """A sort key of the source that puts null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """doc_id, src (a sort key that puts null last), size in words, key (32 hex digits, uniform)."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        _src(source_col).alias("src"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        _key(id_col, text_col, seed).alias("key"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), epochs: int = 2) -> DataFrame:
    """One row per source: src, source_size, target (double).

    Sources in code point order weigh `weights` over and over and share `share` (a fraction) of all sizes; no target
    exceeds `epochs` times its source and the excess goes to the others by weight. That fixed point needs no
    iteration: in the order of cap by weight, a source is capped exactly if the level that the sources before
    it leave exceeds its own. The two global windows see one row per source, not one per document.
    """
    num, den = share
    by_src = Window.orderBy("src")
    per = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.pmod(F.row_number().over(by_src) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.select("src", "source_size", w.alias("w"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    per = per.select(
        "*",
        F.sum("source_size").over(whole).alias("all_size"),
        F.sum("w").over(whole).alias("all_w"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
    )
    level = (F.lit(num) * F.col("all_size") - F.lit(den * epochs) * F.col("size_before")) * F.col("w")
    per = per.withColumn("capped", level > F.lit(den * epochs) * F.col("source_size") * (F.col("all_w") - F.col("w_before")))
    of_capped = lambda c: F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(whole), F.lit(0))
    per = per.withColumn("size_capped", of_capped("source_size")).withColumn("w_capped", of_capped("w"))
    rest = (F.lit(num) * F.col("all_size") - F.lit(den * epochs) * F.col("size_capped")) * F.col("w")
    target = F.when(F.col("capped"), F.lit(epochs) * F.col("source_size").cast("double")).otherwise(rest.cast("double") / (F.lit(float(den)) * (F.col("all_w") - F.col("w_capped"))))
    return per.select("src", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    epochs: int = 2,
    seed: str = "mix",
    bucket_rows: int = 10_000,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs (whole ones), key, src: how many words of each row the mix takes.

    The row at the cut gives its first words only, so that a source's taken words equal floor(target).
    """
    rows = settle(sized(docs, id_col, text_col, source_col, seed), "mix-sized")
    buckets = max(1, -(-rows.count() // bucket_rows))
    bucket = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("int")
    groups = rows.groupBy("src", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", bucket)
    per = targets(rows, weights, share, epochs)
    sums = groups.groupBy("src", "bucket").agg(F.sum(F.col("n") * F.col("size")).alias("bucket_size"))
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        sums.select("src", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("ahead"))
        .join(per, "src")
        .withColumn("full", F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.floor("target").cast("long") - F.col("full") * F.col("source_size"))
    )
    within = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("inside", F.coalesce(F.sum(F.col("n") * F.col("size")).over(within), F.lit(0))).join(cuts, ["src", "bucket"])
    # a group becomes its rows again, in two steps, for it may have very many
    step = 4096
    out = placed.withColumn("k", F.explode(F.expr(f"sequence(0L, (n - 1) div {step})"))).withColumn("j", F.explode(F.expr(f"sequence(k * {step}, least(n, (k + 1) * {step}) - 1)")))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("ahead") - F.col("inside") - F.col("j") * F.col("size")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("full") * F.col("size") + part).alias("taken"), F.col("full").alias("epochs"), "key", "src")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, all columns kept, each as often as the mix takes it.

    Whole documents only: what is at a source's cut (one row, or rows equal in id and text) stays out of the last epoch. The cut travels as one key per source, so no text is shuffled.
    """
    seed = options.get("seed", "mix")
    plan = mix(docs, id_col, text_col, source_col, **options)
    whole = plan.where("size > 0").groupBy("src", "key").agg(F.max("epochs").alias("epochs"), F.min(F.col("taken") == (F.col("epochs") + 1) * F.col("size")).alias("whole"))
    cut = settle(whole.groupBy("src").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("whole"), F.col("key"))).alias("last")), "mix-cuts")
    names = {c: f"__mix_{c}_{len(docs.columns)}" for c in ("src", "epochs", "last")}
    while set(names.values()) & set(docs.columns):
        names = {c: n + "_" for c, n in names.items()}
    src, epochs, last = names.values()
    times = F.col(epochs) + F.when(_key(id_col, text_col, seed) <= F.col(last), 1).otherwise(0)
    has_words = F.coalesce(F.col(text_col).rlike(WORDS), F.lit(False))
    joined = docs.where(has_words).withColumn(src, _src(source_col)).join(cut.withColumnsRenamed(names), src)
    return joined.withColumn(src, F.explode(F.expr(f"sequence(1L, `{epochs}` + 1L)"))).where(F.col(src) <= times).select(*[f"`{c}`" for c in docs.columns])
