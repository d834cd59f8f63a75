"""Import of records that an older log wrote as JSON envelopes, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: fields of a JSON envelope; data and the values of metadata, a list of pairs, are base64.
JSON = "id string, type string, version long, seq long, data string, metadata array<array<string>>, ts_ms long"


def is_json(value: Column) -> Column:
    """Whether a record is a JSON envelope: its first byte is an opening brace."""
    return F.substring(value, 1, 1) == F.lit(b"{")


def events(records: DataFrame, value_col: str = "value", stream_col: str = "stream") -> DataFrame:
    """Records (stream, value) as events: stream, version, global_seq, id, event_type, data, metadata, ts_ms. A record that is no JSON envelope, or a damaged one, raises."""
    value = F.col(value_col).cast("binary")
    body = F.from_json(value.cast("string"), JSON, {"mode": "PERMISSIVE"})
    found = records.select(F.col(stream_col).alias("stream"), value.alias("__raw"), body.alias("e"))
    bad = ~F.coalesce(is_json(F.col("__raw")), F.lit(False)) | F.col("e.version").isNull() | F.col("e.type").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a JSON envelope in stream "), F.coalesce("stream", F.lit("?")))).cast("long")).otherwise(F.col("e.version"))
    pairs = F.transform(F.coalesce("e.metadata", F.array().cast("array<array<string>>")), lambda p: F.struct(p[0].alias("name"), F.unbase64(p[1]).alias("value")))
    return found.select("stream", checked.alias("version"), F.col("e.seq").alias("global_seq"), F.col("e.id").alias("id"), F.col("e.type").alias("event_type"), F.unbase64("e.data").alias("data"), pairs.alias("metadata"), F.col("e.ts_ms").alias("ts_ms"))
