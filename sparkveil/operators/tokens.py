"""Stable tokens: the registry of each transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.text import prefix_of, registry_key, token_text
from sparkveil.operators.numbering import numbered


def token_registry(spans: DataFrame) -> DataFrame:
    """Rows transcript_id, surface_key, prefix, n, token, ord from flat spans.

    Each distinct key gets one token. The first span of the key decides the prefix, keys of a prefix are numbered in order of
    their first spans, and ord counts all keys of the transcript from 0.
    """
    place = F.struct("turn_id", "span_start")
    first = spans.withColumn("surface_key", registry_key(F.col("text"))).groupBy("transcript_id", "surface_key").agg(F.min_by("pii_type", place).alias("pii_type"), F.min(place).alias("place"))
    first = first.select("transcript_id", "surface_key", prefix_of(F.col("pii_type")).alias("prefix"), "place.turn_id", "place.span_start")
    first = numbered(numbered(first, ["transcript_id", "prefix"], ["span_start", "surface_key"], "n"), ["transcript_id"], ["span_start", "surface_key"], "ord")
    return first.select("transcript_id", "surface_key", "prefix", "n", token_text(F.col("prefix"), F.col("n")).alias("token"), (F.col("ord") - 1).alias("ord"))


def with_residuals(registry: DataFrame, residuals: DataFrame) -> DataFrame:
    """The registry with the residual hits that aren't in it, as further tokens of the prefix PII.

    residuals: transcript_id, turn_id, hit_ord, text, in the order (turn_id, hit_ord); numbers go on where the prefix ends.
    """
    place = F.struct("turn_id", "hit_ord")
    new = residuals.withColumn("surface_key", registry_key(F.col("text"))).groupBy("transcript_id", "surface_key").agg(F.min(place).alias("place"))
    new = new.join(registry.select("transcript_id", "surface_key"), ["transcript_id", "surface_key"], "left_anti")
    last = registry.groupBy("transcript_id").agg(F.max(F.when(F.col("prefix") == "PII", F.col("n"))).alias("last_n"), F.max("ord").alias("last_ord"))
    new = numbered(new.select("transcript_id", "surface_key", "place.turn_id", "place.hit_ord"), ["transcript_id"], ["hit_ord", "surface_key"], "k").join(last, "transcript_id", "left")
    n = F.col("k") + F.coalesce("last_n", F.lit(0))
    added = new.select("transcript_id", "surface_key", F.lit("PII").alias("prefix"), n.alias("n"), token_text(F.lit("PII"), n).alias("token"), (F.col("k") + F.coalesce("last_ord", F.lit(-1))).alias("ord"))
    return registry.unionByName(added)
