"""The queries opN_<name> over the synthetic tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import fingerprint, flac, html, jaccard, language, mixing, packing, secrets, substrings, urlrules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    raw = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), flac.payload(F.col("text")).alias("payload"))
    return flac.describe(flac.encode(raw))


def op2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machines = language.fit(docs.where(~language.held_out()).select("text", "lang"))
    return language.predict(docs, machines).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "family")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secrets.joined(F.col("spans")).alias("spans"), F.size("credentials").cast("long").alias("n_credentials"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint.edited_pairs(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.digest(F.col("lanes"), F.col("sketch")).alias("fingerprint"),
        fingerprint.digest(F.col("edited_lanes"), F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    # a page shows the document whose number ends its path; that document's label is the URL's
    number = F.regexp_extract(urlrules.path(F.col("url")), r"(\d{1,18})(?:\.[a-z]+)?/?$", 1)
    labelled = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).join(labels, "doc_id")
    bad = labelled.select("url", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return urlrules.judge(pages, urlrules.mine(bad))


# -- parts of the above that SQL can express -----------------------------------------------------


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 reads back of each stored text."""
    return op1_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's base matches of each text."""
    return op4_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def url_site_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's host, path and rule of each page, and its verdict where a rule decides."""
    rows = op10_urls(spark, sf_dir)
    return rows.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def packing_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 by document: pieces that follow each other, none but the first shorter than full; and no sequence with a gap or an overlap, or above 1024."""
    rows = op6_packing(spark, sf_dir)
    ends = rows.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("places"), F.count(F.lit(1)).alias("n"))
    bad = ends.where("length <> end or places <> n or end > 1024").count()
    per = rows.groupBy("doc_id").agg(F.max("piece").alias("last"), F.count(F.lit(1)).alias("n"), F.max_by("start", "piece").alias("start"), F.sum("length").alias("ids"), F.max_by("length", "piece").alias("length"))
    right = (F.col("last") == F.col("n") - 1) & (F.col("start") + F.col("length") == F.col("ids")) & (F.col("n") == F.ceil(F.col("ids") / 1024)) & F.lit(bad == 0)
    return per.select("doc_id", right.alias("right"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_languages": op2_languages,
    "op3_jaccard": op3_jaccard,
    "op4_secrets": op4_secrets,
    "op5_fingerprints": op5_fingerprints,
    "op6_packing": op6_packing,
    "op7_substrings": op7_substrings,
    "op8_mix_sources": op8_mix_sources,
    "op9_html": op9_html,
    "op10_urls": op10_urls,
    "media_payloads": media_payloads,
    "secret_counts": secret_counts,
    "url_site_rules": url_site_rules,
    "packing_layout": packing_layout,
}
