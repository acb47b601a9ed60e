"""Transcript files (plain text and JSON) as turns, many at once; what can't be read becomes a row of errors.

A file of which the turns can't be read never stops the others: it is listed with its path and a message.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.functions.text import trimmed
from sparkveil.sources.text import LINE_END, speaker_of, text_of

BOM = "\ufeff"


@dataclass(frozen=True)
class Loaded:
    """turns: transcript_id, turn_id, speaker, text; errors: path, message; files: path, transcript_id of those that were read."""

    turns: DataFrame
    errors: DataFrame
    files: DataFrame


def discover(spark: SparkSession, path: str, any_suffix: bool = False) -> DataFrame:
    """Rows path, content of the .txt and .json files (in any case) directly in a directory, or of one file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    files = reader.load(path).select("path", "content")
    return files if any_suffix else files.where(F.lower("path").rlike(r"\.(txt|json)$"))


def file_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.url_decode(F.replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit("+"), F.lit("%2B")))


def safe_name(transcript_id: Column) -> Column:
    """The id as a file name: anything that could lead out of a folder becomes an underscore."""
    return F.regexp_replace(F.regexp_replace(transcript_id, r"[/\\\x00-\x1f]", "_"), r"^\.+", "_")


def load(files: DataFrame, transcript_id: str | None = None) -> Loaded:
    """files: path, content (bytes). An id given here comes before one in the file, this before the file's stem.

    Text files may begin with a byte order mark, JSON files may not. JSON holds {"turns": [{"speaker", "text" or "raw_text"}]};
    a missing text is raw_text, else empty; a missing speaker is "unknown"; null texts or speakers, other shapes and files
    without turns are errors. Ids that two files share are errors of all but the last in path order.
    """
    is_json = F.lower("path").endswith(".json")
    base = files.withColumn("valid", F.is_valid_utf8(F.col("content").cast("string"))).withColumn("body", F.when(F.col("valid"), F.col("content").cast("string")))
    given = F.lit(transcript_id or None).cast("string")
    text = base.where(~is_json & F.col("valid"))
    lines = F.filter(F.transform(F.split(F.regexp_replace("body", f"^{BOM}", ""), LINE_END, -1), trimmed), lambda x: x != "")
    text = text.select("path", F.coalesce(given, file_stem(F.col("path"))).alias("transcript_id"), F.transform(lines, lambda x: F.struct(speaker_of(x).alias("speaker"), text_of(x).alias("text"))).alias("turns"), F.lit(None).cast("string").alias("message"))
    # In brackets, as the parser takes a value with anything behind it; a second value makes it no JSON either.
    alone = F.try_parse_json(F.concat(F.lit("["), "body", F.lit("]")))
    parsed = base.where(is_json & F.col("valid")).withColumn("v", F.when(~F.col("body").startswith(BOM), alone))
    parsed = parsed.withColumn("v", F.when(F.try_variant_get("v", "$[1]", "variant").isNull(), F.try_variant_get("v", "$[0]", "variant")))
    listed = F.expr("try_variant_get(v, '$.turns', 'array<variant>')")
    field = lambda x, name: F.try_variant_get(x, f"$.{name}", "string")
    kind = lambda x: F.schema_of_variant(x)
    is_object = lambda x: kind(x).startswith("OBJECT")
    missing = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant").isNull()
    null = lambda x, name: F.coalesce(F.is_variant_null(F.try_variant_get(x, f"$.{name}", "variant")), F.lit(False))
    wrong = lambda x, name: ~missing(x, name) & (kind(F.try_variant_get(x, f"$.{name}", "variant")) != "STRING")
    bad = lambda x: ~is_object(x) | wrong(x, "speaker") | null(x, "speaker") | wrong(x, "text") | null(x, "text") | (missing(x, "text") & (wrong(x, "raw_text") | null(x, "raw_text")))
    parsed = parsed.withColumn("items", listed).withColumn("own", F.try_variant_get("v", "$.transcript_id", "string"))
    message = F.when(F.col("body").startswith(BOM), "JSON begins with a byte order mark").when(F.col("v").isNull(), "not JSON").when(~is_object(F.col("v")), "JSON is not an object").when(F.col("items").isNull(), "no list of turns").when(F.exists("items", bad), "a turn is not an object, or its speaker or text is not a string")
    turn = lambda x: F.struct(F.coalesce(field(x, "speaker"), F.lit("unknown")).alias("speaker"), F.coalesce(field(x, "text"), field(x, "raw_text"), F.lit("")).alias("text"))
    json = parsed.withColumn("message", message).select("path", F.coalesce(given, F.col("own"), file_stem(F.col("path"))).alias("transcript_id"), F.when(F.col("message").isNull(), F.transform("items", turn)).alias("turns"), "message")
    broken = base.where(~F.col("valid")).select("path", F.lit(None).cast("string").alias("transcript_id"), F.lit(None).cast(json.schema["turns"].dataType).alias("turns"), F.lit("not UTF-8").alias("message"))
    every = text.unionByName(json).unionByName(broken)
    every = every.withColumn("message", F.coalesce("message", F.when(F.size("turns") == 0, "no turns were found")))
    last = every.where("message is null").groupBy("transcript_id").agg(F.max("path").alias("path"))
    kept = every.where("message is null").join(last, ["transcript_id", "path"], "left_semi")
    doubled = every.where("message is null").join(last, ["transcript_id", "path"], "left_anti").select("path", F.lit("another file has the same transcript_id").alias("message"))
    turns = kept.select("transcript_id", F.posexplode("turns").alias("turn_id", "t")).select("transcript_id", "turn_id", "t.speaker", "t.text")
    return Loaded(turns, every.where("message is not null").select("path", "message").unionByName(doubled), kept.select("path", "transcript_id"))
