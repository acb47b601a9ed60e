"""Lines of plain text as turns, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.text import trimmed

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LABEL = r"(?s)^([^:]{1,80}):(.*)$"


def speaker_of(line: Column) -> Column:
    """What stands before the first colon, if that is at place 2 to 81 of the line; else "unknown"."""
    return F.when(line.rlike(LABEL), trimmed(F.regexp_extract(line, LABEL, 1))).otherwise("unknown")


def text_of(line: Column) -> Column:
    return F.when(line.rlike(LABEL), F.regexp_replace(F.regexp_extract(line, LABEL, 2), r"(?U)^[\s\x1c-\x1f]+", "")).otherwise(line)


def lines_to_turns(texts: DataFrame, id_column: str, text_column: str = "text") -> DataFrame:
    """Rows transcript_id, turn_id, speaker, text: one turn for each line that isn't blank, numbered from 0. A null text has no
    turns; a label without text gives a turn with an empty text."""
    lines = F.filter(F.transform(F.split(text_column, LINE_END, -1), trimmed), lambda x: x != "")
    exploded = texts.select(F.col(id_column).cast("string").alias("transcript_id"), F.posexplode_outer(lines).alias("turn_id", "line")).where("line is not null")
    return exploded.select("transcript_id", "turn_id", speaker_of(F.col("line")).alias("speaker"), text_of(F.col("line")).alias("text"))
