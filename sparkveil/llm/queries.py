"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkveil.llm import leak, lookalike, names, packing, pii, shared, split, turns


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split.split_texts(_read(spark, sf_dir, "turns"), ["transcript_id", "turn_id"])
    return pieces.where("n_pieces > 1").select("transcript_id", "turn_id").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_texts(_read(spark, sf_dir, "turns").select("transcript_id", "turn_id", "text").distinct(), ["transcript_id", "turn_id"])


def p1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_texts(_read(spark, sf_dir, "documents").select("doc_id", "text").distinct(), ["doc_id"])


def _covering(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """For each text: its length as the pieces have it, whether all is kept, in order and within the limits."""
    order = Window.partitionBy(*keys).orderBy("piece")
    size = F.col("piece_end") - F.col("piece_start")
    step = F.coalesce(F.col("piece_start") - F.lag("piece_end").over(order), F.lit(0))
    each = pieces.select(*keys, "piece", "n_pieces", "piece_end", ((size > 0) & (size <= split.LIMIT) & (F.length("piece_text") == size) & (step <= 0) & (step >= -split.OVERLAP) & ((F.col("piece") > 0) | (F.col("piece_start") == 0))).alias("fits"), F.substring("piece_text", F.lit(1) - step, size).alias("added"))
    every = each.groupBy(*keys).agg(F.max("piece_end").alias("n_chars"), (F.bool_and("fits") & (F.count("*") == F.max("n_pieces")) & (F.max("piece") + 1 == F.max("n_pieces"))).alias("whole"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "added"))), lambda x: x["added"]), "").alias("text"))
    return every.select(*keys, "n_chars", "whole", F.md5("text").alias("text_hash"))


def p1_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covering(p1_pieces(spark, sf_dir), ["transcript_id", "turn_id"])


def p1_documents_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covering(p1_documents(spark, sf_dir), ["doc_id"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.find_lookalikes(_read(spark, sf_dir, "review_items"), _read(spark, sf_dir, "turns"))


def p2_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn and review item that the one form changes."""
    said = _read(spark, sf_dir, "turns").select("transcript_id", "turn_id", F.lit(None).cast("int").alias("item_ord"), "text")
    items = _read(spark, sf_dir, "review_items").select("transcript_id", "turn_id", "item_ord", "text")
    return lookalike.normalise_lookalikes(said.unionByName(items).distinct(), ["text"]).where("text_normal <> text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.registry_pairs(_read(spark, sf_dir, "registry"), _read(spark, sf_dir, "spans"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turns.clean_turns(_read(spark, sf_dir, "turns"), _read(spark, sf_dir, "speakers"))
    return found.select("transcript_id", F.col("first_turn_id"), "speaker_code")


def p4_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.clean_turns(_read(spark, sf_dir, "turns"), _read(spark, sf_dir, "speakers"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _read(spark, sf_dir, "turns")
    return pii.find_types(said, pii.learn_contexts(said, _read(spark, sf_dir, "spans")))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _read(spark, sf_dir, "turns")
    return pii.redact(said, pii.learn_contexts(said, _read(spark, sf_dir, "spans")))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(packing.pack(_read(spark, sf_dir, "documents")))


def p6_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with whether all its tokens are placed, once, and none of its containers holds too much."""
    packed = packing.pack(_read(spark, sf_dir, "documents"))
    used = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    each = packed.join(used, "container_id").groupBy("doc_id").agg(F.bool_and(F.col("used") <= 2048).alias("fits"), F.sum("n_tokens").alias("placed"), F.count("*").alias("pieces"), F.max("piece").alias("last"))
    sized = packing.count_tokens(_read(spark, sf_dir, "documents"))
    return each.join(sized, "doc_id", "full").select("doc_id", F.coalesce(F.col("fits") & (F.col("placed") == F.col("n_tokens")) & (F.col("pieces") == F.col("last") + 1) & (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / 2048))), F.lit(False)).alias("placed"))


def p7_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.remove_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.shared_spans(_read(spark, sf_dir, "documents"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.shared_report(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def _normal_sql(x: str) -> str:
    """A text in one form, for comparing: every look-alike is Latin, whatever stands around it."""
    q = lambda v: "'" + v.replace("'", "''") + "'"
    pairs = {a: b for a, b in lookalike.LOOKALIKES.items() if len(a) == len(b) == 1}
    wide = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {"\u3000": " ", "\u00a0": " ", "\u2007": " ", "\u202f": " ", "\u2009": " ", "\u2002": " ", "\u2003": " "}
    table = wide | pairs
    out = f"regexp_replace({x}, '[\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}]', '', 'g')"
    for a, b in (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl")):
        out = f"replace({out}, {q(a)}, {q(b)})"
    return f"lower(nfc_normalize(translate({out}, {q(''.join(table))}, {q(''.join(table.values()))})))"


def oracle_sql() -> dict[str, str]:
    """What SQL can express; the others are tested against brute force and round trips."""
    ten = lambda table, key, text: f"SELECT {key}, list_aggregate(list_slice(w, i, i + 9), 'string_agg', ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 8)) AS i FROM (SELECT DISTINCT {key}, regexp_extract_all({_normal_sql(text)}, '[\\p{{L}}\\p{{N}}\\p{{M}}]+') AS w FROM {table} WHERE {text} <> '' AND {key} IS NOT NULL))"
    windows = "docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 256), places AS (SELECT doc_id, text, unnest(range(1, length(text) - 254)) AS p FROM docs), w AS (SELECT doc_id, p, md5(substr(text, p, 256)) AS h FROM places)"
    runs = f"""WITH {windows}, many AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), s AS (SELECT doc_id, p FROM w SEMI JOIN many USING (h)),
      m AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 256 THEN 0 ELSE 1 END AS new FROM s), r AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m),
      spans AS (SELECT doc_id, CAST(min(p) - 1 AS INTEGER) AS span_start, CAST(max(p) + 255 AS INTEGER) AS span_end FROM r GROUP BY doc_id, run)"""
    return {
        "p1_found": f"SELECT DISTINCT transcript_id, turn_id FROM turns WHERE length(text) > {split.LIMIT}",
        "p1_covering": "SELECT DISTINCT transcript_id, turn_id, CAST(length(text) AS INTEGER) AS n_chars, true AS whole, md5(text) AS text_hash FROM turns WHERE text <> ''",
        "p1_documents_covering": "SELECT DISTINCT doc_id, CAST(length(text) AS INTEGER) AS n_chars, true AS whole, md5(text) AS text_hash FROM documents WHERE text <> ''",
        "p2_found": f"""SELECT DISTINCT transcript_id, item_ord, turn_id FROM (SELECT i.transcript_id, i.item_ord, i.turn_id, {_normal_sql("i.text")} AS a, {_normal_sql("t.text")} AS b FROM review_items i JOIN turns t USING (transcript_id, turn_id)
            WHERE trim(i.text) <> '' AND NOT contains(lower(t.text), lower(i.text))) WHERE trim(a) <> '' AND contains(b, trim(a))""",
        "p6_placement": "SELECT DISTINCT doc_id, true AS placed FROM documents WHERE doc_id IS NOT NULL",
        "p7_found": f"SELECT DISTINCT doc_id, item_id FROM ({ten('documents', 'doc_id', 'text')}) d JOIN ({ten('eval_items', 'item_id', 'item_text')}) e USING (g)",
        "p8_found": f"{runs} SELECT * FROM spans",
        "p8_report": f"""{runs} SELECT doc_id, CAST(n AS INTEGER) AS n_chars, CAST(coalesce(k, 0) AS BIGINT) AS shared_chars, CASE WHEN n > 0 THEN round(coalesce(k, 0) / n, 6) END AS share
            FROM (SELECT doc_id, max(length(text)) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY 1) LEFT JOIN (SELECT doc_id, sum(span_end - span_start) AS k FROM spans GROUP BY 1) USING (doc_id)""",
    }
