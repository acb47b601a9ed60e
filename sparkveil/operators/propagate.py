"""Contextual identifiers found in one turn are found in all turns of the transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.spans import find_all, without_overlaps
from sparkveil.functions.text import bounded, matching_key
from sparkveil.operators.detect import KEYS, SPAN_TYPE, exploded, ranked
from sparkveil.operators.lookup import candidates


def contextual(spans: DataFrame) -> DataFrame:
    """Rows transcript_id, match_key, pii_type, text, confidence, first_turn, first_start: the identifiers worth propagating.

    spans: flat rows. Of the spans of one key and type the last in (turn, place) gives text and confidence, the first the
    order. Keys of less than three characters and structured matches are left out.
    """
    place = F.struct("turn_id", "span_start")
    known = spans.where("source = 'llm'").withColumn("match_key", matching_key("text")).where(F.length("match_key") >= 3)
    grouped = known.groupBy("transcript_id", "match_key", "pii_type").agg(F.max_by(F.struct("text", "confidence"), place).alias("last"), F.min(place).alias("first"))
    return grouped.select("transcript_id", "match_key", "pii_type", "last.text", "last.confidence", F.col("first.turn_id").alias("first_turn"), F.col("first.span_start").alias("first_start"))


def propagate(turns: DataFrame, detected: DataFrame) -> DataFrame:
    """Rows transcript_id, turn_id, spans: the detected spans and the repeats of contextual ones, disjoint.

    detected: rows with spans as an array, as `detect` gives them. Repeats match ignoring case, between word boundaries. Where
    spans overlap, leftmost, longest, detected before repeated, and the contextual identifier met first win, in this order.
    """
    known = contextual(exploded(detected)).withColumn("pattern", bounded(F.col("text")))
    near = candidates(turns, known.withColumnRenamed("text", "surface"), "surface")
    # The contextual identifier met first has the lowest rank.
    order = "array_sort(transform(entries, e -> struct(e.first_turn as t, e.first_start as s, e.pii_type as y, e.confidence as c, e.pattern as p)))"
    marks = F.expr(f"flatten(transform({order}, (e, r) -> {ranked(find_all('text', 'e.p'), 'r + 1', 'e.y', 'e.c', 'llm')}))")
    repeats = near.select(*KEYS, marks.alias("marks"))
    # Detected spans come first at equal places: their ranks are made negative, in their order.
    own = detected.select(*KEYS, F.expr("transform(spans, (s, i) -> named_struct('start', s.start, 'neg_length', s.neg_length, 'rank', i - 1000000, 'end', s.end, 'text', s.text, 'pii_type', s.pii_type, 'confidence', s.confidence, 'source', s.source))").alias("spans"))
    empty = F.array().cast(f"array<{SPAN_TYPE}>")
    both = own.join(repeats, KEYS, "full").select(*KEYS, F.concat(F.coalesce("spans", empty), F.coalesce("marks", empty)).alias("spans"))
    return both.select(*KEYS, without_overlaps(F.col("spans"), SPAN_TYPE).alias("spans"))
