"""Which surfaces of a transcript may stand in which of its turns, without comparing all with all.

A transcript with few surfaces sends them to its turns as one array, where those go that the turn doesn't contain. Where there are
many, a turn and a surface meet on (transcript, word): a surface between word boundaries can only stand where its words stand as
words, so one of them is enough, and the rarest of the transcript is taken, by counting. Words that are frequent all the same (a word in
a third of a long transcript) are salted: their turns spread over as many tasks as they need, and their surfaces go to each.
Surfaces without any word go to all turns; they are as rare as they are short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.text import folded, words_of
from sparkveil.storage import cut_lineage

KEYS = ["transcript_id", "turn_id"]
FEW = 64
PART = 50_000  # turns that one task takes for a word of a transcript


def candidates(turns: DataFrame, entries: DataFrame, surface: str, always: str = "false", few: int | None = None, part: int | None = None) -> DataFrame:
    """Rows transcript_id, turn_id, text, entries (array of the entries' rows), for turns of transcripts with entries (the array may be empty).

    turns: transcript_id, turn_id, text. entries: transcript_id and any other columns, `surface` among them. always: condition
    under which an entry is a candidate of every turn of the transcript. few: surfaces that go as one array; part: turns of a
    word that one task takes (by default FEW and PART). Neither changes the result.
    """
    few, part = FEW if few is None else few, PART if part is None else part
    entry = F.struct(*[c for c in entries.columns if c != "transcript_id"]).alias("entry")
    words = words_of(F.col(surface))
    entries = entries.select("transcript_id", entry, folded(F.col(surface)).alias("low"), words.alias("words"), (F.expr(always) | (F.size(words) == 0)).alias("everywhere"))
    sizes = entries.groupBy("transcript_id").agg(F.count("*").alias("n_entries"))
    sized = cut_lineage(entries.join(sizes, "transcript_id"))
    small = sized.where((F.col("n_entries") <= few) | F.col("everywhere")).groupBy("transcript_id").agg(F.collect_list(F.struct("entry", "low", "everywhere")).alias("listed"))
    texts = turns.select(*KEYS, "text").where(F.col("text") != "")
    # The folded text is bound to w so that it isn't made again for each entry.
    near = texts.join(small, "transcript_id").withColumn("low", folded(F.col("text")))
    near = near.select(*KEYS, "text", F.expr("transform(array(low), w -> transform(filter(listed, x -> x.everywhere or contains(w, x.low)), x -> x.entry))[0]").alias("entries"))
    large = sized.where((F.col("n_entries") > few) & ~F.col("everywhere")).select("transcript_id", "entry", "words")
    if large.isEmpty():
        return near
    # Words of turns that a surface of the transcript has too: of transcripts with many surfaces only.
    known = large.select("transcript_id", F.explode("words").alias("word")).distinct()
    said = texts.join(large.select("transcript_id").distinct(), "transcript_id", "left_semi").select(*KEYS, F.explode(words_of(F.col("text"))).alias("word"))
    said = cut_lineage(said.join(known, ["transcript_id", "word"], "left_semi"))
    counts = said.groupBy("transcript_id", "word").agg(F.count("*").alias("n"))
    one = large.select("transcript_id", "entry", F.size("words").alias("all"), F.explode("words").alias("word")).join(counts, ["transcript_id", "word"])
    # A surface with a word that no turn has stands nowhere.
    one = one.groupBy("transcript_id", "entry", "all").agg(F.min_by("word", F.struct("n", "word")).alias("word"), F.min("n").alias("n"), F.count("*").alias("there")).where(F.col("there") == F.col("all"))
    listed = cut_lineage(one.groupBy("transcript_id", "word").agg(F.collect_list("entry").alias("entries"), F.max(F.ceil(F.col("n") / part)).cast("int").alias("salts")))
    spread = listed.select("transcript_id", "word", "entries", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    placed = said.withColumn("salt", F.lit(0))
    hot = listed.where("salts > 1").select("transcript_id", "word", "salts")
    if not hot.isEmpty():
        placed = said.join(hot, ["transcript_id", "word"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("turn_id"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    met = placed.join(spread, ["transcript_id", "word", "salt"]).groupBy(*KEYS).agg(F.flatten(F.collect_list("entries")).alias("entries"))
    both = near.unionByName(texts.join(met, KEYS).select(*KEYS, "text", "entries"))
    return both.groupBy(*KEYS).agg(F.first("text").alias("text"), F.flatten(F.collect_list("entries")).alias("entries")) if always != "false" else both
