"""URL filters: fixed rules by host and path, and association rules mined from labels.

URLs become sets of tokens (scheme, host suffixes and labels, path parts with numbers generalised, query keys and pairs, fragment).
Spark's FP-growth mines combinations of tokens and class over two thirds of the distinct labelled URLs (by hash). Before it, tokens that no rule can have
(rarer than the support) or need (in every URL, or in the same URLs as another one) are taken out. A rule towards a class is kept if its
support, confidence and lift pass the bounds, if its precision on the last third, which it was not mined from, is surely (lower end of the confidence
interval) above both that class's share there and one half, and if no shorter rule says the same as surely. They are matched by an inverted index: a rule is filed
under its rarest token, a URL looks up its tokens there, and the few rules found are tested whole. The surest rule wins.

Defined results: a null url, or one without ://, has an empty host and path and no token, so no rule fits and the verdict is the default; labels of one URL
that disagree count as the class of most of them (block if even); without labels, or if no rule holds on the last third, there are no mined rules.
All tokens of a URL are mined and matched. Repeated and null page ids are judged row by row.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD, GOOD = "=block", "=allow"
Rule = tuple[str, str, str]
#: Verdict, host and path of the site rules.
RULES: tuple[Rule, ...] = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host_col: Column, path_col: Column, rule: Rule) -> Column:
    _, h, p = rule
    return ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)


def site_rule(host_col: Column, path_col: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = _fits(host_col, path_col, rule)
        name, verdict = F.when(fits, F.lit(rule[1] + rule[2])).otherwise(name), F.when(fits, F.lit(rule[0])).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, host tokens first."""
    h, p = host(url), path(url)
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(3))), lambda n: F.concat(F.lit("h:"), F.array_join(F.slice(labels, -n, n), ".")))
    generalised = lambda x: F.regexp_replace(x, r"[0-9]+", "#")
    parts = F.filter(F.split(generalised(p), "/"), lambda x: x != "")
    query = F.filter(F.split(generalised(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)), "&"), lambda x: x != "")
    mark = F.regexp_extract(url, r"(?s)#(.*)$", 1)
    found = F.concat(
        F.when(h != "", suffixes).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("s:"), F.element_at(labels, 1)), F.concat(F.lit("u:"), F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
        F.transform(parts, lambda x, i: F.concat(F.lit("p"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), x)),
        F.transform(query, lambda x: F.concat(F.lit("q:"), x)),
        F.when(mark != "", F.array(F.concat(F.lit("f:"), generalised(mark)))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(url.contains("://"), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def _informative(baskets: DataFrame, least: int, n: int) -> DataFrame:
    """basket, bad, items: without tokens of fewer than `least` baskets or of all n; of tokens that are in the same baskets the shortest stands for all."""
    each = baskets.select("basket", F.explode("items").alias("token"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("basket").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("basket")).alias("b"))
    kept = settle(counts.where((F.col("n") >= least) & (F.col("n") < n)).groupBy("n", "a", "b").agg(F.min(F.struct(F.length("token"), "token"))["token"].alias("token")), "urls-tokens")
    left = each.join(kept.select("token"), "token").groupBy("basket").agg(F.collect_list("token").alias("items"))
    return baskets.select("basket", "bad").join(left, "basket", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def _surely(hits: Column, n: Column, z: float) -> Column:
    """The lower end of Wilson's interval of a share of hits in n."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


RULE_COLUMNS = "rule_id string, antecedent array<string>, verdict string, confidence double, support double, held_out long, precision double"


def mine(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", min_support: float = 0.01, min_confidence: float = 0.5, min_lift: float = 1.2, doubt: float = 0.05) -> DataFrame:
    """Pruned association rules towards a class: rule_id, antecedent, verdict, confidence and support where they were mined, held_out (URLs of the last third that match), precision (its lower bound there).

    min_support is the share of a class's URLs that a rule towards it must have, doubt the chance that any rule passes the last third by luck (shared by all that are tried).
    """
    spark = labelled.sparkSession
    votes = labelled.where(F.col(url_col).isNotNull() & F.col(bad_col).isNotNull()).groupBy(F.col(url_col).cast("string").alias("url")).agg(F.avg(F.col(bad_col).cast("int")).alias("share"))
    found = votes.select("url", (F.col("share") >= 0.5).alias("bad"), tokens(F.col("url")).alias("items"), (F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(3)) == 1).alias("held"))
    rows = settle(found.select(F.xxhash64("url").alias("basket"), "bad", "items", "held"), "urls-baskets")
    sums = rows.groupBy("held").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).collect()
    by = {r["held"]: (r["n"], r["bad"], r["n"] - r["bad"]) for r in sums}
    nothing = spark.createDataFrame([], RULE_COLUMNS)
    if len(by) < 2 or not all(min(x[1:]) for x in by.values()):
        return nothing
    n, bad, good = by[False]
    least = max(2, math.ceil(min_support * min(bad, good)))
    named = _informative(rows.where(~F.col("held")), least, n)
    baskets = settle(named.select(F.array_append("items", F.when(F.col("bad"), F.lit(BAD)).otherwise(F.lit(GOOD))).alias("items")), "urls-mined")
    model = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=min_confidence).fit(baskets)
    classes = F.array(F.lit(BAD), F.lit(GOOD))
    mined = model.associationRules.where((F.element_at("consequent", 1).isin(BAD, GOOD)) & ~F.arrays_overlap("antecedent", classes) & (F.col("lift") >= min_lift))
    mined = mined.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.element_at("consequent", 1), 2, 10).alias("verdict"), "confidence", "support")
    enough = F.ceil(F.col("support") * n) >= F.when(F.col("verdict") == BAD[1:], F.lit(min_support * bad)).otherwise(F.lit(min_support * good))
    mined = settle(mined.where(enough).withColumn("rule_id", F.array_join("antecedent", " ")), "urls-rules")
    filed, rules = index(mined)
    if not rules:
        return nothing
    m, held_bad, held_good = by[True]
    hits = looked_up(rows.where("held").select("basket", "bad", "items"), filed, rules, "items")
    right = F.col("bad") == (F.col("verdict") == BAD[1:])
    tried = hits.groupBy("rule_id", "verdict").agg(F.count(F.lit(1)).alias("held_out"), F.count_if(right).alias("right"))
    base = F.when(F.col("verdict") == BAD[1:], F.lit(held_bad / m)).otherwise(F.lit(held_good / m))
    z = NormalDist().inv_cdf(1 - doubt / rules)  # many rules are tried, and few may pass by chance
    precision = _surely(F.col("right").cast("double"), F.col("held_out").cast("double"), z)
    tried = tried.withColumn("precision", precision).where((F.col("precision") > 0.5) & (F.col("precision") > base))
    sure = settle(mined.join(tried.select("rule_id", "verdict", "held_out", "precision"), ["rule_id", "verdict"]), "urls-sure")
    # a shorter rule fits a longer one's tokens as it fits a URL's, so the same index finds it
    filed, rules = index(sure)
    longer = sure.select("rule_id", "antecedent", F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    beaten = looked_up(longer.withColumnsRenamed({"rule_id": "longer", "antecedent": "items"}), filed, rules, "items")
    beaten = beaten.where((F.col("verdict") == F.col("v")) & (F.col("confidence") >= F.col("c")) & (F.col("rule_id") != F.col("longer"))).select(F.col("longer").alias("rule_id"), "verdict").distinct()
    return settle(sure.join(beaten, ["rule_id", "verdict"], "left_anti").select(*[c.split()[0] for c in RULE_COLUMNS.split(", ")]), "urls-kept")


def index(rules: DataFrame) -> tuple[DataFrame, int]:
    """token, rule_id, verdict, antecedent, confidence: each rule under the token that the fewest rules have; and how many there are."""
    each = rules.select("rule_id", "verdict", "antecedent", "confidence", F.explode("antecedent").alias("token"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    first = each.join(counts, "token").groupBy("rule_id", "verdict").agg(F.min(F.struct("n", "token"))["token"].alias("token"), F.first("antecedent").alias("antecedent"), F.first("confidence").alias("confidence"))
    filed = settle(first, "urls-index")
    return filed, filed.count()


def looked_up(rows: DataFrame, filed: DataFrame, n: int, tokens_col: str, most: int = 100_000, salts: int = 16) -> DataFrame:
    """Every row beside each rule whose tokens it has. Up to `most` rules the index is broadcast; beyond, it meets the tokens in a shuffle, dealt over salts, for most URLs share some tokens."""
    each = rows.withColumn("token", F.explode(tokens_col))
    if n <= most:
        met = each.join(F.broadcast(filed), "token")
    else:
        dealt = filed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = each.withColumn("__salt", F.pmod(F.xxhash64(tokens_col), F.lit(salts)).cast("int")).join(dealt, ["token", "__salt"]).drop("__salt")
    return met.where(F.size(F.array_except("antecedent", tokens_col)) == 0)


def match(urls: DataFrame, rules: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """id_col and the surest mined rule that fits (mined, mined_verdict, confidence), for rows that have one."""
    filed, n = index(rules)
    held = looked_up(urls.select(id_col, tokens_col), filed, n, tokens_col)
    best = held.groupBy(id_col).agg(F.max(F.struct("confidence", F.size("antecedent").alias("n"), "rule_id", "verdict")).alias("b"))
    return best.select(id_col, F.col("b.rule_id").alias("mined"), F.col("b.verdict").alias("mined_verdict"), F.col("b.confidence").alias("confidence"))


def judge(pages: DataFrame, mined: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, default: str = "allow", most: int = 200_000, salts: int = 16) -> DataFrame:
    """page_id, host, path, rule, verdict, mined, confidence of every row: a site rule decides, else the surest mined rule, else the default.

    Mined rules are matched once for each set of tokens, and what is found goes back to the pages that have it: broadcast up to `most` sets, else dealt over salts.
    """
    url = F.col(url_col).cast("string")
    h, p = host(url), path(url)
    name, verdict = site_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), h.alias("host"), p.alias("path"), F.array_sort(tokens(F.coalesce(url, F.lit("")))).alias("__tokens"))
    rows = rows.withColumn("rule", name).withColumn("__verdict", verdict).withColumn("__set", F.sha2(F.to_json("__tokens"), 256))
    sets = rows.where(F.size("__tokens") > 0).groupBy("__set").agg(F.first("__tokens").alias("__tokens"))
    found = settle(match(sets, mined, "__set", "__tokens"), "urls-found")
    if found.count() <= most:
        joined = rows.join(F.broadcast(found), "__set", "left")
    else:
        dealt = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("__salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(dealt, ["__set", "__salt"], "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("__verdict", "mined_verdict", F.lit(default)).alias("verdict"), "mined", "confidence")
