"""The gate: what is still in redacted turns, and what a reviewer gets to see."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.functions.text import contains_ignoring_case, is_generic, is_token_artifact, masked_tokens
from sparkveil.operators.detect import KEYS, structured_spans
from sparkveil.operators.numbering import numbered

RESIDUAL, CORRECTED, LOW = "residual PII (gate)", "gate: auto-corrected", "low-confidence detection"


def residual_hits(turns: DataFrame, residuals: DataFrame | None = None) -> DataFrame:
    """Rows transcript_id, turn_id, hit_ord, text: what the residual detector named, then structured matches of the redacted
    text with its tokens masked by a space (unmerged).

    turns: with anonymised_text. residuals: transcript_id, turn_id, ord, text; their turns needn't be there.
    """
    masked = turns.select(*KEYS, masked_tokens(F.col("anonymised_text")).alias("masked"))
    masked = masked.select(*KEYS, F.posexplode_outer(structured_spans("masked")).alias("pos", "s")).where("s is not null")
    hits = masked.select(*KEYS, (F.col("pos") + 1_000_000_000).alias("hit_ord"), F.col("s.text").alias("text"))
    if residuals is not None:
        hits = residuals.select(*KEYS, F.col("ord").cast("int").alias("hit_ord"), "text").where(F.col("text").isNotNull()).unionByName(hits)
    return hits


def confirmed(hits: DataFrame, turns: DataFrame) -> DataFrame:
    """The hits that are neither parts of tokens nor generic and stand in their redacted turn, ignoring case; of repeated ones
    in a turn the first."""
    worth = hits.where(~is_token_artifact(F.col("text")) & ~is_generic("text"))
    there = worth.join(turns.select(*KEYS, "anonymised_text"), KEYS).where(contains_ignoring_case(F.col("anonymised_text"), F.col("text")))
    return there.groupBy(*KEYS, "text").agg(F.min("hit_ord").alias("hit_ord"))


def low_confidence(spans: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Spans below the threshold that aren't generic, once for each (turn, text), the first of them."""
    weak = spans.where((F.col("confidence") < threshold) & ~is_generic("text"))
    first = F.row_number().over(Window.partitionBy(*KEYS, "text").orderBy("span_start", "span_end"))
    return weak.withColumn("k", first).where("k = 1").select(*KEYS, "span_start", "text", "pii_type", "confidence")


def review_items(weak: DataFrame, residual: DataFrame, reason: str = CORRECTED, weak_first: bool = True) -> DataFrame:
    """Rows transcript_id, item_ord, turn_id, text, reason, pii_type, confidence: weak detections, then residuals
    with the given reason, or the other way round."""
    a = weak.select("transcript_id", "turn_id", F.lit(0).alias("part"), F.col("span_start").alias("place"), "text", F.lit(LOW).alias("reason"), "pii_type", "confidence")
    b = residual.select("transcript_id", "turn_id", F.lit(1 if weak_first else -1).alias("part"), F.col("hit_ord").alias("place"), "text", F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("pii_type"), F.lit(1.0).alias("confidence"))
    both = numbered(a.unionByName(b), ["transcript_id"], ["place", "text"], "item_ord", major=["part"])
    return both.select("transcript_id", (F.col("item_ord") - 1).alias("item_ord"), "turn_id", "text", "reason", "pii_type", "confidence")


def validate(turns: DataFrame, spans: DataFrame, residuals: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Review items of redacted turns that are looked at on their own, without a sweep: what is still there, as RESIDUAL, then weak
    detections. Columns as of `review_items`."""
    left = confirmed(residual_hits(turns, residuals), turns)
    return review_items(low_confidence(spans, threshold), left, RESIDUAL, weak_first=False)


def reports(turns: DataFrame, spans: DataFrame, items: DataFrame, metadata: dict | None = None) -> DataFrame:
    """Rows transcript_id, status, n_spans, n_review_items, run_metadata; needs_review where a weak detection is left."""
    every = turns.select("transcript_id").distinct()
    n_spans = spans.groupBy("transcript_id").agg(F.count("*").alias("n_spans"))
    n_items = items.groupBy("transcript_id").agg(F.count("*").alias("n_review_items"), F.max((F.col("reason") == LOW).cast("int")).alias("weak"))
    names = ("model", "model_digest", "pipeline_version", "started_at_utc")
    run = F.struct(*[F.lit((metadata or {}).get(k)).cast("string").alias(k) for k in names]) if metadata else F.lit(None).cast("struct<model:string,model_digest:string,pipeline_version:string,started_at_utc:string>")
    joined = every.join(n_spans, "transcript_id", "left").join(n_items, "transcript_id", "left")
    return joined.select("transcript_id", F.when(F.col("weak") == 1, "needs_review").otherwise("clean").alias("status"), F.coalesce("n_spans", F.lit(0)).cast("int").alias("n_spans"), F.coalesce("n_review_items", F.lit(0)).cast("int").alias("n_review_items"), run.alias("run_metadata"))


def run_summary(reports_: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row: transcripts processed (failed ones too), of these in need of review and failed, and all replacements and items."""
    done = reports_.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "needs_review").alias("needs_review"), F.coalesce(F.sum("n_spans"), F.lit(0)).alias("replacements"), F.coalesce(F.sum("n_review_items"), F.lit(0)).alias("review_items"))
    failed = errors.agg(F.count("*").alias("failed")) if errors is not None else reports_.sparkSession.range(1).select(F.lit(0).cast("long").alias("failed"))
    return done.crossJoin(failed).select((F.col("n") + F.col("failed")).alias("processed"), "needs_review", "failed", "replacements", "review_items")
