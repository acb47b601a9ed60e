"""The queries of the de-identification operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.functions.patterns import STRUCTURED
from sparkveil.functions.text import is_generic, is_token_artifact, masked_tokens, matching_key, registry_key
from sparkveil.operators import gate
from sparkveil.operators.detect import detect, distinct_turns, exploded, locate_mentions, merge_spans, regex_spans, without_generic
from sparkveil.operators.propagate import contextual, propagate
from sparkveil.operators.redact import redact, sweep, with_tokens
from sparkveil.operators.tokens import token_registry, with_residuals
from sparkveil.plans.oracle import oracle_sql
from sparkveil.plans.pipeline import Result, deidentify
from sparkveil.sources import sinks, transcripts
from sparkveil.sources.text import lines_to_turns
from sparkveil.storage import cut_lineage

__all__ = ["deidentify_end_to_end", "oracle_sql", "queries"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _turns(spark, sf_dir, *more: str) -> DataFrame:
    return distinct_turns(_read(spark, sf_dir, "turns").select("transcript_id", "turn_id", "text", *more))


def _spans(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "spans").select("transcript_id", "turn_id", "span_start", "span_end", "text", "pii_type", "confidence", "source").distinct()


def _merged(spark, sf_dir) -> DataFrame:
    return merge_spans(_spans(spark, sf_dir), ["source", "pii_type", "confidence"])


def _mentions(spark, sf_dir) -> DataFrame:
    return _spans(spark, sf_dir).where("source = 'llm'").select("transcript_id", "turn_id", F.col("span_start").alias("ord"), "text", "pii_type", "confidence")


def _residuals(spark, sf_dir) -> DataFrame:
    items = _read(spark, sf_dir, "review_items").where(F.col("reason") == gate.CORRECTED)
    return items.select("transcript_id", "turn_id", F.col("item_ord").alias("ord"), "text").distinct()


def _phrases(spark, sf_dir) -> DataFrame:
    """Texts of one to three words from every place of the turns, and the texts of the spans and the review items."""
    words = _read(spark, sf_dir, "turns").where("text <> ''").select(F.split("text", " ").alias("w"))
    runs = words.select(F.explode(F.expr("flatten(transform(sequence(1, size(w)), i -> transform(sequence(1, least(3, size(w) - i + 1)), n -> array_join(slice(w, i, n), ' '))))")).alias("text"))
    return runs.union(_read(spark, sf_dir, "spans").select("text")).union(_read(spark, sf_dir, "review_items").select("text")).where("text is not null").distinct()


def regex_spans_all(spark, sf_dir) -> DataFrame:
    return regex_spans(_turns(spark, sf_dir))


def merged_spans(spark, sf_dir) -> DataFrame:
    return exploded(detect(_turns(spark, sf_dir)))


def merged_known_spans(spark, sf_dir) -> DataFrame:
    return _merged(spark, sf_dir)


def text_source_turns(spark, sf_dir) -> DataFrame:
    return lines_to_turns(_read(spark, sf_dir, "documents").select("doc_id", "text").distinct(), "doc_id")


def speakers_of_lines(spark, sf_dir) -> DataFrame:
    return text_source_turns(spark, sf_dir).groupBy("speaker").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))


def normalise_keys(spark, sf_dir) -> DataFrame:
    texts = _phrases(spark, sf_dir)
    return texts.select("text", matching_key("text").alias("match_key"), registry_key(F.col("text")).alias("registry_key"))


def generic_predicate(spark, sf_dir) -> DataFrame:
    return _phrases(spark, sf_dir).select("text", is_generic("text").alias("generic"))


def generic_filter(spark, sf_dir) -> DataFrame:
    return without_generic(_spans(spark, sf_dir))


def located_mentions(spark, sf_dir) -> DataFrame:
    return locate_mentions(_mentions(spark, sf_dir), _turns(spark, sf_dir))


def contextual_dictionary(spark, sf_dir) -> DataFrame:
    return contextual(_merged(spark, sf_dir))


def propagated_spans(spark, sf_dir) -> DataFrame:
    turns = cut_lineage(_turns(spark, sf_dir))
    found = cut_lineage(detect(turns, _mentions(spark, sf_dir))).where(F.size("spans") > 0)
    return exploded(propagate(turns, found))


def token_registry_of_spans(spark, sf_dir) -> DataFrame:
    return token_registry(_merged(spark, sf_dir))


def redacted_turns(spark, sf_dir) -> DataFrame:
    spans = cut_lineage(_merged(spark, sf_dir))
    return redact(_turns(spark, sf_dir), with_tokens(spans, token_registry(spans))).select("transcript_id", "turn_id", "anonymised_text")


def masked_texts(spark, sf_dir) -> DataFrame:
    return _turns(spark, sf_dir, "anonymised_text").select("transcript_id", "turn_id", masked_tokens(F.col("anonymised_text")).alias("masked_text"))


def token_artifacts(spark, sf_dir) -> DataFrame:
    return _phrases(spark, sf_dir).select("text", is_token_artifact(F.col("text")).alias("artifact"))


def gate_hits(spark, sf_dir) -> DataFrame:
    return gate.residual_hits(_turns(spark, sf_dir, "anonymised_text"), _residuals(spark, sf_dir))


def _confirmed(spark, sf_dir) -> DataFrame:
    return gate.confirmed(gate_hits(spark, sf_dir), _turns(spark, sf_dir, "anonymised_text"))


def gate_confirmed(spark, sf_dir) -> DataFrame:
    return _confirmed(spark, sf_dir)


def gate_registry(spark, sf_dir) -> DataFrame:
    return with_residuals(cut_lineage(token_registry(_merged(spark, sf_dir))), _confirmed(spark, sf_dir))


def swept_turns(spark, sf_dir) -> DataFrame:
    turns = _turns(spark, sf_dir, "anonymised_text")
    registry = _read(spark, sf_dir, "registry").distinct()
    return sweep(turns, registry, cut_lineage(_confirmed(spark, sf_dir))).select("transcript_id", "turn_id", "anonymised_text")


def low_confidence_spans(spark, sf_dir) -> DataFrame:
    return gate.low_confidence(_merged(spark, sf_dir), 0.8)


def review_queue(spark, sf_dir) -> DataFrame:
    return gate.review_items(low_confidence_spans(spark, sf_dir), _confirmed(spark, sf_dir))


def transcript_reports(spark, sf_dir) -> DataFrame:
    return gate.reports(_turns(spark, sf_dir), _merged(spark, sf_dir), cut_lineage(review_queue(spark, sf_dir))).drop("run_metadata")


def batch_summary(spark, sf_dir) -> DataFrame:
    return gate.run_summary(transcript_reports(spark, sf_dir))


def spans_by_type(spark, sf_dir) -> DataFrame:
    return merged_spans(spark, sf_dir).groupBy("pii_type").agg(F.count("*").alias("n_spans"), F.count_distinct("transcript_id").alias("n_transcripts"), F.sum(F.col("span_end") - F.col("span_start")).alias("n_chars"))


def deidentify_end_to_end(spark, sf_dir) -> DataFrame:
    return _result(spark, sf_dir).turns.select("transcript_id", "turn_id", "anonymised_text")


def _result(spark, sf_dir):
    return deidentify(_read(spark, sf_dir, "turns"), _mentions(spark, sf_dir), _residuals(spark, sf_dir))


def end_to_end_registry(spark, sf_dir) -> DataFrame:
    return _result(spark, sf_dir).registry


def end_to_end_review_items(spark, sf_dir) -> DataFrame:
    return _result(spark, sf_dir).review_items


def end_to_end_reports(spark, sf_dir) -> DataFrame:
    return _result(spark, sf_dir).reports.drop("run_metadata")


def stored_result(spark, sf_dir) -> Result:
    """The tables of the existing pipeline as a result to be written."""
    turns = _turns(spark, sf_dir, "speaker", "anonymised_text")
    spans = cut_lineage(_merged(spark, sf_dir))
    registry = cut_lineage(token_registry(spans))
    return Result(turns, with_tokens(spans, registry), registry, review_queue(spark, sf_dir), transcript_reports(spark, sf_dir).withColumn("run_metadata", F.lit(None).cast("string")))


def anonymised_documents(spark, sf_dir) -> DataFrame:
    documents = sinks.anonymised_documents(stored_result(spark, sf_dir))
    return documents.select("transcript_id", F.posexplode("turns").alias("place", "t")).select("transcript_id", "place", "t.turn_id", "t.speaker", "t.text")


def report_documents(spark, sf_dir) -> DataFrame:
    documents = sinks.report_documents(stored_result(spark, sf_dir))
    return documents.select("transcript_id", "status", F.size("spans").alias("n_spans"), F.size("registry").alias("n_tokens"), F.size("review_items").alias("n_review_items"), F.array_join(F.transform("spans", lambda s: s["token"]), ",").alias("tokens_in_order"), F.array_join(F.array_sort(F.map_keys("registry")), "|").alias("surfaces"))


def queue_documents(spark, sf_dir) -> DataFrame:
    documents = sinks.queue_documents(stored_result(spark, sf_dir))
    return documents.select("transcript_id", F.posexplode("items").alias("place", "x")).select("transcript_id", "place", "x.turn_id", "x.text", "x.reason", "x.pii_type", "x.confidence")


def _json_files(spark, sf_dir) -> DataFrame:
    """The transcripts as JSON files: some name their id, some use raw_text, some leave out what is null."""
    turns = _turns(spark, sf_dir, "speaker").where("transcript_id is not null and turn_id is not null")
    odd = F.pmod("turn_id", F.lit(2)) == 1
    turn = F.struct("turn_id", F.struct("speaker", F.when(~odd, F.col("text")).alias("text"), F.when(odd, F.col("text")).alias("raw_text")).alias("t"))
    listed = turns.groupBy("transcript_id").agg(F.array_sort(F.collect_list(turn)).alias("all"))
    body = F.to_json(F.struct(F.when(F.length("transcript_id") % 2 == 0, F.col("transcript_id")).alias("transcript_id"), F.col("all.t").alias("turns")))
    return listed.select(F.concat(F.lit("/in/"), "transcript_id", F.lit(".json")).alias("path"), F.encode(body, "UTF-8").alias("content"))


def json_source_turns(spark, sf_dir) -> DataFrame:
    return transcripts.load(cut_lineage(_json_files(spark, sf_dir))).turns


def text_files_turns(spark, sf_dir) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text").distinct()
    files = documents.select(F.concat(F.lit("/in/"), "doc_id", F.lit(".txt")).alias("path"), F.encode(F.concat(F.lit("\ufeff"), F.coalesce("text", F.lit(""))), "UTF-8").alias("content"))
    return transcripts.load(cut_lineage(files)).turns


def source_errors(spark, sf_dir) -> DataFrame:
    """Files of which the turns can't be read: the items of the review queue as if each were a JSON file, spans as text files."""
    items = _read(spark, sf_dir, "review_items").select("transcript_id", "item_ord", "text").distinct()
    files = items.select(F.concat_ws("-", F.lit("/in/j"), "transcript_id", "item_ord").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    json = files.select(F.concat("name", F.lit(".json")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    text = files.select(F.concat("name", F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return transcripts.load(cut_lineage(json.unionByName(text))).errors


def validated_turns(spark, sf_dir) -> DataFrame:
    return gate.validate(_turns(spark, sf_dir, "anonymised_text"), _merged(spark, sf_dir), _residuals(spark, sf_dir), 0.8)


def queries() -> dict:
    single = {f"spans_{name}": (lambda spark, sf_dir, name=name: regex_spans(_turns(spark, sf_dir), [name])) for name, *_ in STRUCTURED}
    named = [regex_spans_all, merged_spans, merged_known_spans, text_source_turns, speakers_of_lines, normalise_keys, generic_predicate, generic_filter, located_mentions, contextual_dictionary, propagated_spans, token_registry_of_spans, redacted_turns, masked_texts, token_artifacts, gate_hits, gate_confirmed, gate_registry, swept_turns, low_confidence_spans, review_queue, transcript_reports, batch_summary, spans_by_type, deidentify_end_to_end, end_to_end_registry, end_to_end_review_items, end_to_end_reports, anonymised_documents, report_documents, queue_documents, json_source_turns, text_files_turns, source_errors, validated_turns]
    return single | {f.__name__: f for f in named}
