"""Tokens in place of spans, and the sweep of all known surfaces over redacted turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.spans import spliced
from sparkveil.functions.text import bounded, registry_key
from sparkveil.operators.detect import KEYS
from sparkveil.operators.lookup import candidates


def with_tokens(spans: DataFrame, registry: DataFrame) -> DataFrame:
    """Flat spans with the token of their registry key."""
    keyed = spans.withColumn("surface_key", registry_key(F.col("text")))
    return keyed.join(registry.select("transcript_id", "surface_key", "token"), ["transcript_id", "surface_key"], "left").drop("surface_key")


def redact(turns: DataFrame, spans: DataFrame) -> DataFrame:
    """turns with anonymised_text: each span replaced by its token; turns without spans keep their text, null stays null."""
    listed = spans.groupBy(*KEYS).agg(F.collect_list(F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end"), "token")).alias("marks"))
    joined = turns.drop("anonymised_text").join(listed, KEYS, "left")
    return joined.withColumn("anonymised_text", F.when(F.col("marks").isNull(), F.col("text")).otherwise(spliced(F.col("text"), F.col("marks")))).drop("marks")


def sweep(turns: DataFrame, registry: DataFrame, only: DataFrame) -> DataFrame:
    """turns with every registry surface in anonymised_text replaced by its token, in the transcripts of `only`.

    Longest surfaces first, of equal ones the earlier; each sees what those before have left. A surface matches ignoring case,
    not inside a word and not next to a square bracket at its outer side.
    """
    surfaces = registry.where(F.col("surface_key") != "").join(only.select("transcript_id").distinct(), "transcript_id", "left_semi")
    surfaces = surfaces.select("transcript_id", (-F.length("surface_key")).alias("neg_length"), "ord", "surface_key", "token", bounded(F.col("surface_key"), "[]").alias("pattern"))
    # A surface with a bracket may only come to stand in a turn when another one has been replaced.
    near = candidates(turns.select(*KEYS, F.col("anonymised_text").alias("text")), surfaces, "surface_key", always="surface_key like '%[%'")
    swept = near.select(*KEYS, F.aggregate(F.array_sort("entries"), F.col("text"), lambda text, e: F.regexp_replace(text, e["pattern"], e["token"])).alias("swept"))
    return turns.join(swept, KEYS, "left").withColumn("anonymised_text", F.coalesce("swept", "anonymised_text")).drop("swept")
