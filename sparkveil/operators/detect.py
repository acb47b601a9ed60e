"""Detection: structured identifiers, located mentions, and their merge into disjoint spans of each turn.

Null and empty texts have no spans. Repeated rows of a turn are the caller's to remove (`distinct_turns`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.patterns import STRUCTURED
from sparkveil.functions.spans import find_all, without_overlaps
from sparkveil.functions.text import is_generic, literal

KEYS = ["transcript_id", "turn_id"]
SPAN_TYPE = "struct<start:int,neg_length:int,rank:int,end:int,text:string,pii_type:string,confidence:double,source:string>"


def distinct_turns(turns: DataFrame) -> DataFrame:
    """One row for each turn; which of several is undefined, they are deliveries of the same content."""
    return turns.dropDuplicates(KEYS)


def ranked(found: str, rank: str, pii_type: str, confidence: str, source: str) -> str:
    """SQL for found spans as SPAN_TYPE, whose order by fields is the order in which overlapping spans win."""
    return f"transform({found}, s -> named_struct('start', s.start, 'neg_length', s.start - s.end, 'rank', {rank}, 'end', s.end, 'text', s.text, 'pii_type', {pii_type}, 'confidence', {confidence}, 'source', '{source}'))"


def structured_spans(text: str, names: list[str] | None = None) -> Column:
    """All matches of the structured patterns in a column, pattern by pattern; those of different patterns may overlap."""
    parts = [ranked(find_all(text, f"r'{pattern}'", f"rlike({text}, r'{guard}')"), str(1_000_000 + k), f"'{kind}'", "1.0D", "regex") for k, (name, kind, pattern, guard) in enumerate(STRUCTURED) if names is None or name in names]
    return F.expr(f"flatten(array({', '.join(parts)}))")


def exploded(df: DataFrame, spans: str = "spans") -> DataFrame:
    columns = [F.col(f"s.{c}") for c in ("text", "pii_type", "confidence", "source")]
    # The outer form keeps the optimizer from evaluating the spans once more in a filter below.
    return df.select(*KEYS, F.explode_outer(spans).alias("s")).where("s is not null").select(*KEYS, F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), *columns)


def regex_spans(turns: DataFrame, names: list[str] | None = None, column: str = "text") -> DataFrame:
    """Rows transcript_id, turn_id, span_start, span_end, text, pii_type, confidence, source, unmerged."""
    return exploded(turns.select(*KEYS, structured_spans(column, names).alias("spans")))


def located(mentions: DataFrame, turns: DataFrame) -> DataFrame:
    """Every non-overlapping exact occurrence of a mention in its turn, also inside words; empty and absent ones give none.

    mentions: transcript_id, turn_id, ord, text, pii_type, confidence. Gives those with spans as an array.
    """
    asked = mentions.where(F.col("text").isNotNull() & (F.col("text") != "")).withColumnRenamed("text", "mention")
    both = asked.join(turns.select(*KEYS, "text"), KEYS).where(F.contains("text", "mention"))
    return both.withColumn("pattern", literal(F.col("mention"))).withColumn("found", F.expr(find_all("text", "pattern")))


def locate_mentions(mentions: DataFrame, turns: DataFrame) -> DataFrame:
    spans = located(mentions, turns).select(*KEYS, "ord", F.explode_outer("found").alias("s"), "pii_type", "confidence").where("s is not null")
    return spans.select(*KEYS, "ord", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.text").alias("text"), "pii_type", "confidence", F.lit("llm").alias("source"))


def without_generic(spans: DataFrame) -> DataFrame:
    return spans.where(~is_generic("text"))


def detect(turns: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """Rows transcript_id, turn_id, spans: for each turn its disjoint spans in order.

    Located mentions that aren't generic come before structured matches; of overlapping spans the leftmost stays, of those
    that begin together the longest, of those the first.
    """
    own = turns.select(*KEYS, structured_spans("text").alias("spans"))
    if mentions is None:
        every = own
    else:
        found = located(mentions, turns).where(~is_generic("mention"))
        found = found.select(*KEYS, F.expr(ranked("found", "ord", "pii_type", "confidence", "llm")).alias("marks"))
        found = found.groupBy(*KEYS).agg(F.flatten(F.collect_list("marks")).alias("marks"))
        every = own.join(found, KEYS, "left").select(*KEYS, F.concat(F.coalesce("marks", F.array().cast(f"array<{SPAN_TYPE}>")), "spans").alias("spans"))
    return every.select(*KEYS, without_overlaps(F.col("spans"), SPAN_TYPE).alias("spans"))


def merge_spans(spans: DataFrame, order: list[str]) -> DataFrame:
    """Overlaps removed from flat spans; order: columns that decide between spans of equal place."""
    ranked = F.struct(F.col("span_start").alias("start"), (F.col("span_start") - F.col("span_end")).alias("neg_length"), F.struct(*order).alias("rank"), F.col("span_end").alias("end"), "text", "pii_type", "confidence", "source")
    listed = spans.groupBy(*KEYS).agg(F.collect_list(ranked).alias("spans"))
    element = listed.schema["spans"].dataType.elementType.simpleString()
    return exploded(listed.select(*KEYS, without_overlaps(F.col("spans"), element).alias("spans")))
