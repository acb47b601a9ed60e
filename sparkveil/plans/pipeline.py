"""The whole of it: turns and what detectors say about them, to redacted turns, spans, registry, review items and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.operators import gate
from sparkveil.operators.detect import detect, distinct_turns, exploded
from sparkveil.operators.propagate import propagate
from sparkveil.operators.redact import redact, sweep, with_tokens
from sparkveil.operators.tokens import token_registry, with_residuals
from sparkveil.storage import cut_lineage


@dataclass(frozen=True)
class Result:
    """Tables of one run. The stages before them have been computed and kept when `deidentify` returns; what the tables add to
    these is computed when they are read."""

    turns: DataFrame
    spans: DataFrame
    registry: DataFrame
    review_items: DataFrame
    reports: DataFrame

    def without(self, transcripts: DataFrame) -> Result:
        """The tables without the transcripts of those rows."""
        ids = transcripts.select("transcript_id").distinct()
        return Result(*(x.join(ids, "transcript_id", "left_anti") for x in (self.turns, self.spans, self.registry, self.review_items, self.reports)))


def deidentify(turns: DataFrame, mentions: DataFrame | None = None, residuals: DataFrame | None = None, threshold: float = 0.5, metadata: dict | None = None, detected: DataFrame | None = None) -> Result:
    """turns: transcript_id, turn_id, speaker, text (other columns are left out). mentions: what a detector named in each turn.
    residuals: what a second look named in redacted turns; a function of the redacted turns may be given instead. detected:
    spans of a detector of one's own, used as they are, in place of `mentions` and the structured patterns.

    Rows with a null transcript_id or turn_id are left out, repeated turns count once, a null text has no spans and stays null.
    """
    columns = [c for c in ("transcript_id", "turn_id", "speaker", "text") if c in turns.columns]
    turns = cut_lineage(distinct_turns(turns.select(*columns).where("transcript_id is not null and turn_id is not null")))
    # Stages end where their result is used more than once, as texts must not be searched again for each use.
    found = cut_lineage(detect(turns, mentions) if detected is None else detected).where(F.size("spans") > 0)
    spans = cut_lineage(exploded(propagate(turns, found)))
    registry = cut_lineage(token_registry(spans))
    spans = with_tokens(spans, registry)
    redacted = cut_lineage(redact(turns, spans))
    if callable(residuals):
        residuals = residuals(redacted)
    hits = cut_lineage(gate.confirmed(gate.residual_hits(redacted, residuals), redacted))
    weak = gate.low_confidence(spans, threshold)
    registry = with_residuals(registry, hits)
    swept = sweep(redacted, registry, hits)
    items = gate.review_items(weak, hits)
    return Result(swept, spans, registry, items, gate.reports(turns, spans, items, metadata))


def unresolved(result: Result) -> DataFrame:
    """Corrected review items whose text still stands in their swept turn (inside a longer word, or with other spaces)."""
    items = result.review_items.where(F.col("reason") == gate.CORRECTED)
    both = items.join(result.turns.select("transcript_id", "turn_id", "anonymised_text"), ["transcript_id", "turn_id"])
    return both.where(F.contains(F.lower("anonymised_text"), F.lower("text")) & (F.col("text") != "")).select("transcript_id", "item_ord", "turn_id", "text")
