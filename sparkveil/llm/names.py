"""Problem 3: spellings of names typed by people, linked to the person or organisation they name.

A noisy channel in two steps, both by key and none over all pairs. First the words of names: within a transcript the more
frequent of two spellings is a candidate for what the other meant; a spelling is attached to the candidate with the greatest
posterior (log of the frequencies, log likelihood of the typing errors between them), unless it is likelier that it is a name of
its own: the more letters a name has, the less likely two names of one transcript are that near to each other by chance.
Candidates meet through keys that a single error leaves equal (the word less one letter) or looser ones, and every spelling of a
key is a candidate for the rarer ones; a loose key of many spellings is split by keys that the errors allowed leave equal, so no
pair is lost. Then whole names, made of the attached words: nicknames lead to the name they stand for, reordered parts and
titles are put right, abbreviated words are written out, and names that leave parts out (initials, surname or given name alone,
place or initials of an organisation) are attached to the full name with the greatest posterior, if it holds most of the
probability.

What names are made of is learned from the table itself (`Vocabulary`): given names are frequent over transcripts and stand in
names of persons; words of organisations stand last, or before "of", where words of places stand first, or after "of"; a nickname
is a given name that stands beside another with the same surname far more often than relatives would bring them together.
Abbreviations are read as the learned word of greatest posterior, frequency times likelihood of the shortening. Words count if
they stand in more than `common_share` of all transcripts, so at most (words a transcript) / common_share are learned.

Defined results: null or blank surfaces and surfaces of other kinds (numbers, addresses, e-mails) link to nothing, equal
surfaces always link, repeated rows count once, names that fit two persons about equally link to neither.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.llm.lookalike import fold_array
from sparkveil.storage import cut_lineage

TITLES = frozenset("mr mrs ms miss dr doctor prof professor sir madam rev".split())
ERROR = 3.0  # minus log of the probability of one typing error in a word
LETTER = 2.4  # what a letter tells two names apart by, in nats
OWN = 9.4  # how much likelier a priori, in nats, a new spelling is a name of its own
GIVEN = 2.0  # what an equal given name says for one person
SHARE = 0.75


@dataclass(frozen=True)
class Vocabulary:
    """Words learned from the table with the number of transcripts they stand in; nicknames: given names with the one meant."""

    given: dict[str, int] = field(default_factory=dict)
    org: dict[str, int] = field(default_factory=dict)
    nicknames: dict[str, str] = field(default_factory=dict)


def distance(a: str, b: str, limit: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; limit + 1 if there are more than limit."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > limit:
            return limit + 1
        before, row = row, new
    return row[-1] if row[-1] <= limit else limit + 1


def shortened(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def weight_of_errors(letters: int, errors: int) -> float:
    """Log odds that a name was meant as another one of about that many letters, against a name of its own."""
    return LETTER * letters - OWN - errors * (ERROR + math.log(10 * letters))


def shortening(short: str, word: str) -> float | None:
    """Minus log likelihood of an abbreviation, given the word: its beginning, or letters of it in order; None if it is neither."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return None
    if word.startswith(short):
        return 1.0
    at = iter(word)
    return 2.5 + (short[-1] != word[-1]) if all(c in at for c in short) else None


class Reader:
    """Reads surfaces as names, with the words that are known."""

    def __init__(self, words: Vocabulary) -> None:
        self.given, self.words, self.known = words.given, words.org, {}
        self.near: dict[str, list[str]] = {}
        self.org: dict[str, list[str]] = {}
        for table, index, least in ((self.given, self.near, 4), (self.words, self.org, 5)):
            for w in table:
                if len(w) >= least:
                    for k in {w, *shortened(w)}:
                        index.setdefault(k, []).append(w)
        self.first: dict[str, list[str]] = {}
        for w in self.words:
            self.first.setdefault(w[0], []).append(w)

    def given_name(self, word: str, fuzzy: bool = True) -> str | None:
        if word in self.given:
            return word
        if not fuzzy or len(word) < 4:
            return None
        near = {w for k in {word, *shortened(word)} for w in self.near.get(k, ()) if distance(word, w, 1) == 1}
        return max(near, key=lambda w: (self.given[w], w), default=None)

    def org_word(self, word: str) -> str | None:
        """The word of organisations that was typed, of greatest posterior; an abbreviation that became frequent is read too."""
        if word not in self.known:
            best, top = None, -math.inf
            if word in self.words:  # what shortens a more frequent word is rather that than a word of its own
                best, top = word, math.log(self.words[word]) - OWN / 2
            for w in self.first.get(word[:1], ()):
                cost = shortening(word, w)
                if cost is not None and self.words[w] > self.words.get(word, 0) and math.log(self.words[w]) - cost > top:
                    best, top = w, math.log(self.words[w]) - cost
            if best is None and len(word) >= 4:
                near = {w for k in {word, *shortened(word)} for w in self.org.get(k, ()) if distance(word, w, 1) == 1}
                best = max(near, key=lambda w: (self.words[w], w), default=None)
            self.known[word] = best
        return self.known[word]

    def read(self, surface: str, prefix: str | None):
        """(kind, main word or place, given name or organisation words, initials or form) of a folded surface, or None."""
        s = " ".join(surface.lower().split()).strip(" ,;:")
        if not s or "@" in s or "/" in s or any(c.isdigit() for c in s) or re.search(r"\b(?:at|dot)\b", s):
            return None
        bare = s.replace(".", "")
        orgish = prefix in ("ORG", "SCHOOL", "PLACE")
        if re.fullmatch(r"(?:[^\W\d]\.){3,7}", s) or (orgish and re.fullmatch(r"[^\W\d]{3,7}", bare) and not self.given_name(bare, False)):
            return ("initials", bare, "", "")
        tokens = [t for t in re.split(r"[\s,.]+", s) if t]
        words = [self.org_word(t) for t in tokens]
        known = [w for w in words if w]
        if "of" in tokens[1:-1] and known:
            k = tokens.index("of", 1)
            return ("org", " ".join(tokens[k + 1 :]), " ".join(w or t for t, w in zip(tokens[:k], words)), "")
        if tokens[0] == "the" and len(tokens) > 1:
            tokens, words = tokens[1:], words[1:]
        tail = len(tokens)
        while tail > 1 and words[tail - 1]:
            tail -= 1
        if tail < len(tokens) and (len(tokens) - tail > 1 or tail > 1) and (orgish or len(tokens) - tail > 1 or not self.given_name(tokens[-1], False)):
            return ("org", " ".join(tokens[:tail]), " ".join(words[tail:]), "")
        if orgish and 2 <= len(tokens) <= 3 and all(len(t) > 2 for t in tokens) and not any(self.given_name(t, False) for t in tokens):
            return ("place", " ".join(tokens), "", "")
        title = tokens[0] in TITLES
        if title:
            tokens = tokens[1:]
        if not tokens:
            return None
        if len(tokens) == 1:
            g = None if title else self.given_name(tokens[0])
            return ("given", "", g, g[0]) if g else ("person", tokens[0], "", "")
        if "," in s:
            head, _, rest = s.partition(",")
            tokens = [t for t in re.split(r"[\s.]+", rest) if t] + [t for t in re.split(r"[\s.]+", head) if t] if rest.strip() else tokens
        if len(tokens) > 2:
            tokens = [tokens[0], *[t for t in tokens[1:-1] if len(t) > 1], tokens[-1]]
        if len(tokens) < 2:
            return ("person", tokens[0], "", "")
        if len(tokens[0]) == 1:
            return ("person", tokens[-1], "", tokens[0])
        if len(tokens[-1]) == 1:
            g = self.given_name(tokens[0])
            return ("person", tokens[0], "", tokens[-1]) if not g else ("given", "", g, g[0])
        first, last = self.given_name(tokens[0], False), self.given_name(tokens[-1], False)
        if not first and last:
            return ("person", tokens[0], last, last[0])
        if not first:
            first, last = self.given_name(tokens[0]), self.given_name(tokens[-1])
            if not first and last:
                return ("person", tokens[0], last, last[0])
        g = first or tokens[0]
        return ("person", tokens[-1], g, g[0])


def common_words(surfaces: DataFrame, common_share: float = 0.001, least: int = 3) -> Vocabulary:
    """Given names and words of organisations: words that stand in more than that share of the transcripts, told apart by the
    names they stand in, and by their place in these."""
    total = surfaces.agg(F.approx_count_distinct("transcript_id")).first()[0]
    tokens = F.filter(F.split(F.regexp_replace(F.lower("surface"), r"^the ", ""), r"[\s,.]+"), lambda t: t != "")
    split = surfaces.where(~F.col("surface").rlike(r"[0-9@/]")).select("transcript_id", (F.col("prefix") == "NAME").alias("name"), F.col("prefix").isin("ORG", "SCHOOL").alias("org"), tokens.alias("t"))
    at = F.array_position("t", "of")
    size = F.size("t")
    # 1 for the place of a word of organisations, -1 for one of places, 0 where it may be either.
    side = lambda i: F.when(~F.col("org"), 0).when(at > 1, F.when(i + 1 < at, 1).otherwise(-1)).when((size >= 3) & (i == size - 1), 1).when((size >= 4) & (i == size - 2), 1).when((size >= 3) & (i == 0), -1).when((size >= 4) & (i == 1), -1).otherwise(0)
    words = split.select("transcript_id", "name", F.explode(F.transform("t", lambda w, i: F.struct(w.alias("word"), side(i).alias("side")))).alias("x")).select("transcript_id", "name", "x.word", "x.side").where(F.col("word").rlike(r"^[\p{L}'-]{2,}$") & (F.col("word") != "of"))
    counted = words.groupBy("word").agg(F.approx_count_distinct(F.when(F.col("name"), F.col("transcript_id"))).alias("n"), F.avg(F.col("name").cast("int")).alias("share"), F.approx_count_distinct(F.when(F.col("side") > 0, F.col("transcript_id"))).alias("m"), F.sum(F.greatest("side", F.lit(0))).alias("ends"), F.sum(F.greatest(-F.col("side"), F.lit(0))).alias("begins"))
    enough = max(least, math.ceil(total * common_share))
    kept = counted.where((F.col("n") >= enough) & (F.col("share") > 0.5) | (F.col("m") >= enough) & (F.col("ends") > 3 * F.col("begins")) & (F.col("share") < 0.5)).collect()
    org = {r.word: r.m for r in kept if r.share < 0.5}
    return Vocabulary(_without_errors({r.word: r.n for r in kept if r.share > 0.5 and r.word not in TITLES}), _without_errors(org))


def _without_errors(words: dict[str, int], times: int = 8) -> dict[str, int]:
    """The words without those that are one typing error from a far more frequent one."""
    index: dict[str, list[str]] = {}
    for w in words:
        for k in {w, *shortened(w)} if len(w) >= 6 else ():
            index.setdefault(k, []).append(w)
    near = lambda w: {v for k in {w, *shortened(w)} for v in index.get(k, ()) if v != w and distance(w, v, 1) == 1}
    return {w: n for w, n in words.items() if len(w) < 6 or not any(words[v] >= times * n for v in near(w))}


def alike(a: str, b: str) -> bool:
    """Whether two given names begin alike or have two letters in a row in common, as most nicknames do with their names."""
    return a[0] == b[0] or any(a[i : i + 2] in b for i in range(len(a) - 1))


def learn_nicknames(names: DataFrame, given: dict[str, int], least: int = 3, odds: float = 6.0, crowd: int = 12) -> dict[str, str]:
    """Given names with the one they stand for: pairs that stand in the same transcripts far more often than chance brings them
    together (`odds` times; three times that, if they have no letters in common), and in at least `least` of them.

    Of transcripts with more than `crowd` given names only pairs with one surname count, as there all names stand together.
    """
    usual = F.col("other").isin(*given) if given else F.lit(False)
    rows = names.where((F.col("kind").isin("person", "given")) & (F.col("other") != "") & usual)
    together = rows.groupBy("transcript_id").agg(F.collect_set("other").alias("g")).where(F.size("g") <= crowd)
    surname = rows.where("main <> ''").groupBy("transcript_id", "main").agg(F.collect_set("other").alias("g")).join(together.select("transcript_id"), "transcript_id", "left_anti").select("transcript_id", "g")
    sets = together.unionByName(surname).withColumn("g", F.array_sort("g"))
    counted = sets.select(F.explode(F.concat(F.flatten(F.transform("g", lambda a, i: F.transform(F.filter("g", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))), F.transform("g", lambda a: F.struct(a.alias("a"), F.lit("").alias("b"))))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    rows = counted.where((F.col("n") >= least) | (F.col("b") == "")).collect()  # at most as many as there are pairs of words
    alone = {r.a: r.n for r in rows if not r.b}
    total = sets.count()
    meant: dict[str, tuple] = {}
    for r in rows:
        if r.b and r.n * total >= odds * (1 if alike(r.a, r.b) else 3) * alone[r.a] * alone[r.b]:
            short, full = sorted((r.a, r.b), key=lambda g: (given[g], len(g), g))
            meant[short] = max(meant.get(short, (0, "")), (r.n, full))
    out = {}
    for g in meant:
        to = g
        while to in meant:  # each step leads to a more frequent name
            to = meant[to][1]
        out[g] = to
    return out


def _surfaces(registry: DataFrame, spans: DataFrame | None) -> DataFrame:
    """Rows transcript_id, surface (folded), prefix (the most frequent), n."""
    rows = registry.select("transcript_id", F.col("surface_key").alias("surface"), "prefix")
    if spans is not None:
        kind = F.when(F.col("pii_type").isin("person_name", "nickname", "family_member", "clinician_name"), "NAME").when(F.col("pii_type") == "organisation", "ORG").when(F.col("pii_type") == "school", "SCHOOL").otherwise("OTHER")
        rows = rows.unionByName(spans.select("transcript_id", F.col("text").alias("surface"), kind.alias("prefix")))
    rows = rows.where("transcript_id is not null and trim(surface) <> ''")
    rows = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([b.column("transcript_id"), fold_array(b.column("surface"), True), b.column("prefix")], names=b.schema.names) for b in batches), rows.schema)
    rows = rows.withColumn("surface", F.regexp_replace(F.trim("surface"), r"\s+", " "))
    counted = rows.groupBy("transcript_id", "surface", "prefix").agg(F.count("*").alias("n"))
    return counted.groupBy("transcript_id", "surface").agg(F.max_by("prefix", F.struct("n", "prefix")).alias("prefix"), F.sum("n").alias("n"))


def _read_all(surfaces: DataFrame, words: Vocabulary) -> DataFrame:
    def run(batches):
        reader = Reader(words)
        for b in batches:
            read = [reader.read(s, p) or (None,) * 4 for s, p in zip(b.column("surface").to_pylist(), b.column("prefix").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[k] for r in read], pa.string()) for k in range(4))], names=[*b.schema.names, "kind", "main", "other", "initial"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in surfaces.schema.fields)
    return surfaces.mapInArrow(run, fields + ", kind string, main string, other string, initial string").where("kind is not null")


def most_errors(a: int, b: int, loose: bool) -> int:
    """Typing errors allowed between words of those lengths."""
    return (3 if min(a, b) >= 10 else 2) if loose else (1 if min(a, b) < 6 else 2)


def reduced(word: str) -> set[str]:
    """The letters of a word in order, less up to as many as a loose key allows errors: two words within that distance share one."""
    level = {"".join(sorted(word))}
    found = set(level)
    for _ in range(most_errors(len(word), len(word), True)):
        level = {y for x in level for y in shortened(x)}
        found |= level
    return found


def attach_words(names: DataFrame, hot: int = 256) -> DataFrame:
    """Rows transcript_id, kind, main, canonical: each main word (surname, place) with the spelling it is attached to.

    Loose keys of more than `hot` spellings are split.
    """
    words = names.where("main <> ''").withColumn("kind", F.when(F.col("kind") == "person", "person").otherwise("place")).where(F.col("kind").isin("person", "place") & ~(F.col("kind") == "initials"))
    words = words.groupBy("transcript_id", "kind", "main").agg(F.sum("n").alias("n"), F.collect_set(F.when(F.col("other") != "", F.col("other"))).alias("others"))

    def keys(batches):
        for b in batches:
            rows = []
            for i, (w, given, kind) in enumerate(zip(*(b.column(c).to_pylist() for c in ("main", "others", "kind")))):
                letters = "".join(sorted(w))  # in order, so that swapped letters make no difference
                found = {letters, *shortened(letters)} if len(w) >= 4 else {letters}
                if kind == "person" and len(w) >= 6:
                    found |= {k for g in given for k in (f"{g}<{w[:3]}", f"{g}>{w[-3:]}")}
                rows += [(i, k) for k in found]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("transcript_id", "kind", "main", "n")), pa.array([r[1] for r in rows], pa.string())], names=["transcript_id", "kind", "main", "n", "key"])

    t = names.schema["transcript_id"].dataType.simpleString()
    keyed = words.mapInArrow(keys, f"transcript_id {t}, kind string, main string, n long, key string")
    loose = F.col("key").rlike("[<>]")
    keyed = keyed.withColumn("members", F.count("*").over(Window.partitionBy("transcript_id", "kind", "key"))).where("members > 1")
    keyed = cut_lineage(keyed.withColumn("loose", loose))

    def split(batches):
        for b in batches:
            rows = [(i, f"{k}{x}") for i, (w, k) in enumerate(zip(b.column("main").to_pylist(), b.column("key").to_pylist())) for x in reduced(w)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array([r[0] for r in rows], pa.int64())) for c in ("transcript_id", "kind", "main", "n")), pa.array([r[1] for r in rows], pa.string())], names=["transcript_id", "kind", "main", "n", "key"])

    parts = keyed.where(loose & (F.col("members") > hot)).mapInArrow(split, f"transcript_id {t}, kind string, main string, n long, key string").withColumn("loose", F.lit(True))
    keyed = keyed.where(~loose | (F.col("members") <= hot)).drop("members").unionByName(parts)
    other = keyed.select("transcript_id", "kind", "key", F.col("main").alias("candidate"), F.col("n").alias("candidate_n"))
    offers = keyed.join(other, ["transcript_id", "kind", "key"]).where(F.struct("candidate_n", "candidate") > F.struct("n", "main"))
    offers = offers.groupBy("transcript_id", "kind", "main", "candidate").agg(F.max("n").alias("n"), F.max("candidate_n").alias("candidate_n"), F.max("loose").alias("loose"))

    def score(batches):
        for b in batches:
            out = []
            for w, c, n, m, loose in zip(*(b.column(x).to_pylist() for x in ("main", "candidate", "n", "candidate_n", "loose"))):
                most = most_errors(len(w), len(c), loose)
                d = distance(w, c, most)
                odds = weight_of_errors(min(len(w), len(c)), d) + GIVEN * loose + math.log((m + 1) / (n + 1)) if d <= most else -1.0
                out.append(odds + math.log(m + 1) if odds > 0 else None)
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("transcript_id", "kind", "main", "candidate")), pa.array(out, pa.float64())], names=["transcript_id", "kind", "main", "candidate", "posterior"])

    scored = offers.mapInArrow(score, f"transcript_id {t}, kind string, main string, candidate string, posterior double").where("posterior is not null")
    best = scored.groupBy("transcript_id", "kind", "main").agg(F.max_by("candidate", F.struct("posterior", "candidate")).alias("canonical"))
    current = cut_lineage(words.select("transcript_id", "kind", "main").join(best, ["transcript_id", "kind", "main"], "left").withColumn("canonical", F.coalesce("canonical", "main")))
    while True:  # a candidate may itself be attached to a more frequent spelling; counts only rise, so this ends
        step = current.select("transcript_id", "kind", F.col("main").alias("canonical"), F.col("canonical").alias("next"))
        further = cut_lineage(current.join(step, ["transcript_id", "kind", "canonical"], "left").withColumn("next", F.coalesce("next", "canonical")))
        current = further.select("transcript_id", "kind", "main", F.col("next").alias("canonical"))
        if further.where("next <> canonical").isEmpty():
            return current


def _key(*parts) -> Column:
    return F.concat_ws("|", *[F.lit(x) if k == 0 else x for k, x in enumerate(parts)])


def _asked(rows: DataFrame) -> DataFrame:
    """rows: transcript_id, key, entity (null where it asks), n and what else. The rows that ask, with `to`, the entity that holds
    most of the probability of their key (null if none does), and `seen`, whether there is any. One exchange."""
    key = Window.partitionBy("transcript_id", "key")
    rows = rows.repartition("transcript_id", "key").withColumn("m", F.when(F.col("entity").isNotNull(), F.sum("n").over(Window.partitionBy("transcript_id", "key", "entity"))))
    rows = rows.withColumns({"top": F.max(F.struct("m", "entity")).over(key), "all": F.sum(F.when(F.col("entity").isNotNull(), F.col("n"))).over(key)}).where("entity is null")
    return rows.withColumn("to", F.when(F.col("top.m") >= SHARE * F.col("all"), F.col("top.entity"))).withColumn("seen", F.col("all").isNotNull())


def link_names(registry: DataFrame, spans: DataFrame | None = None, common_share: float = 0.001) -> DataFrame:
    """Rows transcript_id, surface (in its consistent form), entity: surfaces of one entity name the same person or organisation."""
    surfaces = cut_lineage(_surfaces(registry, spans))
    known = common_words(surfaces, common_share)
    names = cut_lineage(_read_all(surfaces, known))
    words = attach_words(names)
    group = F.when(F.col("kind") == "person", "person").otherwise("place")
    names = names.withColumn("group", group).join(words.select("transcript_id", F.col("kind").alias("group"), "main", "canonical"), ["transcript_id", "group", "main"], "left")
    names = cut_lineage(names.withColumn("main", F.coalesce("canonical", "main")).select("transcript_id", "surface", "prefix", "n", "kind", "main", "other", "initial"))
    nicknames = learn_nicknames(names, known.given)
    if nicknames:
        table = F.broadcast(names.sparkSession.createDataFrame(sorted(nicknames.items()), "other string, meant string"))
        names = names.join(table, "other", "left").withColumn("other", F.coalesce("meant", "other")).drop("meant")
        names = names.withColumn("initial", F.when((F.col("other") != "") & F.col("kind").isin("person", "given"), F.substring("other", 1, 1)).otherwise(F.col("initial")))
    kind, letters = F.col("kind"), F.array_join(F.transform(F.split(F.concat_ws(" ", F.translate("main", "-", " "), "other"), " "), lambda w: F.substring(w, 1, 1)), "")
    full = (kind == "person") & (F.col("other") != "")
    short = (kind == "person") & (F.col("other") == "") & (F.col("initial") != "")
    # First what full names answer: initials with a surname, given names, places and initials of organisations.
    own = F.when(full, _key("person", "main", "other")).when(kind == "org", _key("org", "main", "other"))
    first = (
        F.when(full, F.array(_key("si", "main", "initial"), _key("g", "other")))
        .when(kind == "org", F.array(_key("os", "main", "prefix"), _key("om", "main"), _key("l", letters)))
        .when(short, F.array(_key("si", "main", "initial")))
        .when(kind == "given", F.array(_key("g", "other")))
        .when(kind == "place", F.array(_key("os", "main", "prefix"), _key("om", "main")))
        .when(kind == "initials", F.array(_key("l", "main")))
    )
    names = cut_lineage(names.withColumn("entity", own))
    asked = _asked(names.withColumn("key", F.explode(first)))
    asked = asked.groupBy("transcript_id", "surface", "kind", "main", "other", "initial", "n").agg(F.max_by("to", F.when(F.col("to").isNotNull(), F.col("key").startswith("om|"))).alias("to"), F.max("seen").alias("seen"))
    alone = F.when(kind == "place", _key("place", "main")).when(kind == "initials", _key("initials", "main")).when((kind == "given") & F.col("seen"), _key("surface", "surface"))
    asked = cut_lineage(asked.withColumn("entity", F.coalesce("to", alone)))
    # Then what these leave: surnames alone, and given names of which only an initial stands elsewhere.
    left = asked.where("entity is null")
    initials = left.where("kind = 'person'").withColumn("entity", _key("person", "main", F.concat("initial", F.lit("."))))
    keep = ["transcript_id", "surface", "kind", "main", "other", "initial", "n", "entity"]
    second = names.where(full | ((kind == "person") & (F.col("other") == "") & (F.col("initial") == ""))).select(*keep, _key("m", "main").alias("key"))
    second = second.unionByName(initials.select(*keep, F.explode(F.array(_key("m", "main"), _key("i", "initial"))).alias("key"))).unionByName(left.where("kind = 'given'").select(*keep, _key("i", "initial").alias("key")))
    answer = F.when(kind == "given", F.coalesce("to", _key("given", "other"))).otherwise(F.coalesce("to", F.when(~F.col("seen"), _key("person", "main", F.lit(""))), _key("surface", "surface")))
    late = _asked(second).withColumn("entity", answer)
    out = [x.select("transcript_id", "surface", "entity") for x in (names.where("entity is not null"), asked.where("entity is not null"), initials, late)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def registry_pairs(registry: DataFrame, spans: DataFrame | None = None, common_share: float = 0.001) -> DataFrame:
    """Rows transcript_id, ord_a, ord_b: all pairs of registry rows of one transcript that name the same entity, ord_a < ord_b."""
    rows = registry.select("transcript_id", "ord", "surface_key").where("transcript_id is not null and ord is not null and trim(surface_key) <> ''").distinct()
    rows = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([b.column("transcript_id"), b.column("ord"), fold_array(b.column("surface_key"), True)], names=["transcript_id", "ord", "surface"]) for b in batches), f"transcript_id {rows.schema['transcript_id'].dataType.simpleString()}, ord {rows.schema['ord'].dataType.simpleString()}, surface string")
    rows = rows.withColumn("surface", F.regexp_replace(F.trim("surface"), r"\s+", " "))
    linked = cut_lineage(rows.join(link_names(registry, spans, common_share), ["transcript_id", "surface"]).select("transcript_id", "ord", "entity").distinct())
    a = linked.select("transcript_id", "entity", F.col("ord").alias("ord_a"))
    b = linked.select("transcript_id", "entity", F.col("ord").alias("ord_b"))
    return a.join(b, ["transcript_id", "entity"]).where("ord_a < ord_b").select("transcript_id", "ord_a", "ord_b").distinct()
