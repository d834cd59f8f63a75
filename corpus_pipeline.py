"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

language   rows go whose text has no letter, or on whose language the machines hardly do better than tossing (see language.keep_identified)
jaccard    of each component of near-duplicate rows the one with the smallest id stays
secrets    secrets found in a text are masked; every row stays, n_chars follows the text
mix        rows are taken as often as their source's target weight asks
pack       what is left is tokenised and packed into sequences

All stages but the last return the columns of their input. Without labels, or with one language, all rows with a letter pass the first stage. No stage needs an id, text, language or source to be there: null
texts go with the first stage, rows without an id are kept by the second, a null source is a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import jaccard, language, mixing, packing, secrets
from tidelog.session import settle


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machines = language.fit(docs.where(~language.held_out()).select("text", "lang"))
    return language.keep_identified(docs, machines)


def stage_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, chars_col="n_chars")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", stage_language), ("jaccard", stage_jaccard), ("secrets", stage_secrets), ("mix", stage_mix), ("pack", stage_pack)]

#: The language machines, the packing and the tokens have no SQL form; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
