"""Results as files: the anonymised transcripts, and apart from them the sensitive reports and review queues.

`write_tables` is for large runs (Parquet, or JSON lines, one folder for each kind); `write_files` makes one set of files for
each transcript, written by the executors into a folder they share.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.plans.pipeline import Result
from sparkveil.sources.transcripts import safe_name


PART = 100_000  # turns, or tokens of a registry, that one document holds; longer transcripts have several


def _part(column: str, size: int) -> Column:
    return F.floor(F.col(column) / size).cast("int").alias("part")


def anonymised_documents(result: Result, size: int = PART) -> DataFrame:
    """Rows transcript_id, part, turns: array of (turn_id, speaker, text) in order, text being the anonymised text. No raw text."""
    turn = F.struct("turn_id", F.coalesce("speaker", F.lit("unknown")).alias("speaker"), F.coalesce("anonymised_text", F.lit("")).alias("text"))
    return result.turns.groupBy("transcript_id", _part("turn_id", size)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def report_documents(result: Result, size: int = PART) -> DataFrame:
    """Rows transcript_id, part, run_metadata, spans, registry, review_items, status: the sensitive report of each transcript. Part 0
    is always there."""
    span = F.struct("turn_id", F.col("span_start").alias("start"), F.col("span_end").alias("end"), "text", "pii_type", "token", "confidence", "source")
    spans = result.spans.groupBy("transcript_id", _part("turn_id", size)).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("ord", "surface_key", "token"))), lambda x: F.struct(x["surface_key"], x["token"]))
    registry = result.registry.groupBy("transcript_id", _part("ord", size)).agg(F.map_from_entries(entries).alias("registry"))
    items = queue_documents(result, size).withColumnRenamed("items", "review_items")
    keys = ["transcript_id", "part"]
    out = result.reports.select("transcript_id", F.lit(0).alias("part")).join(spans, keys, "full").join(registry, keys, "full").join(items, keys, "full")
    out = out.join(result.reports.select("transcript_id", "run_metadata", "status"), "transcript_id")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    return out.select(*keys, "run_metadata", empty("spans").alias("spans"), F.coalesce("registry", F.create_map().cast("map<string,string>")).alias("registry"), empty("review_items").alias("review_items"), "status")


def queue_documents(result: Result, size: int = PART) -> DataFrame:
    item = F.struct("item_ord", "turn_id", "text", "reason", "pii_type", "confidence")
    listed = result.review_items.groupBy("transcript_id", _part("turn_id", size)).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return listed.select("transcript_id", "part", F.transform("items", lambda x: F.struct(x["turn_id"].alias("turn_id"), x["text"].alias("text"), x["reason"].alias("reason"), x["pii_type"].alias("pii_type"), x["confidence"].alias("confidence"))).alias("items"))


def write_tables(result: Result, folder: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """anonymised/ apart from sensitive/spans, registry, review_items, reports."""
    result.turns.select("transcript_id", "turn_id", "speaker", F.col("anonymised_text").alias("text")).write.format(format).mode(mode).save(f"{folder}/anonymised")
    for name in ("spans", "registry", "review_items", "reports"):
        getattr(result, name).write.format(format).mode(mode).save(f"{folder}/sensitive/{name}")


def write_files(result: Result, folder: str, size: int = PART) -> DataFrame:
    """For each transcript anonymised/ID.json, sensitive/ID.deid-report.json and sensitive/ID.review-queue.jsonl (there even if
    empty); what is beyond `size` turns goes to further parts ID.part-1 and so on. Files of the same id are overwritten. Gives
    rows transcript_id, status of what was written."""
    plain = anonymised_documents(result, size).select("transcript_id", "part", F.to_json("turns", {"ignoreNullFields": "false"}).alias("turns_json"))
    report = report_documents(result, size)
    fields = ["transcript_id", "run_metadata", "spans", "registry", "review_items", "status"]
    report = report.select("transcript_id", "part", "status", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("report_json"))
    name = F.concat(safe_name(F.col("transcript_id")), F.when(F.col("part") > 0, F.concat(F.lit(".part-"), "part")).otherwise(""))
    both = plain.join(report, ["transcript_id", "part"], "full").withColumn("name", name)

    master = result.turns.sparkSession.sparkContext.master
    if "://" not in folder and not folder.startswith("file:") and not master.startswith("local"):
        raise ValueError("on a cluster the folder must be an address of a file system that all executors share")

    def put(path: str, text: str) -> None:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
        system.create_dir(os.path.dirname(name), recursive=True)
        part = f"{name}.{os.getpid()}.part"
        with system.open_output_stream(part) as f:
            f.write(text.encode())
        system.move(part, name)  # a task that is run again leaves no half file

    def run(batches):
        for batch in batches:
            for tid, name, turns, report_json in zip(*(batch.column(c).to_pylist() for c in ("transcript_id", "name", "turns_json", "report_json"))):
                if turns is not None:
                    put(f"{folder}/anonymised/{name}.json", json.dumps({"transcript_id": tid, "turns": json.loads(turns)}, indent=2, ensure_ascii=False))
                if report_json is not None:
                    report_ = json.loads(report_json)
                    put(f"{folder}/sensitive/{name}.deid-report.json", json.dumps(report_, indent=2, ensure_ascii=False))
                    put(f"{folder}/sensitive/{name}.review-queue.jsonl", "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in report_["review_items"]))
            yield batch.select(["transcript_id", "part", "status"])

    written = both.mapInArrow(run, "transcript_id string, part int, status string")
    # Every part is written before the first row of the result is given, as they are grouped.
    return written.groupBy("transcript_id").agg(F.max("status").alias("status"))
