import random

import pytest
from model import disjoint, structured

from sparkveil.operators.detect import detect, exploded, locate_mentions, merge_spans, regex_spans
from sparkveil.operators import lookup
from sparkveil.operators.numbering import numbered
from sparkveil.plans.pipeline import deidentify, unresolved

TURN = "transcript_id string, turn_id int, speaker string, text string"
MENTION = "transcript_id string, turn_id int, ord int, text string, pii_type string, confidence double"
RESIDUAL = "transcript_id string, turn_id int, ord int, text string"


def run(spark, texts, mentions=(), residuals=(), threshold=0.5, tid="t"):
    turns = spark.createDataFrame([(tid, i, "s", x) for i, x in enumerate(texts)], TURN)
    said = spark.createDataFrame([(tid, a, k, b, c, d) for k, (a, b, c, d) in enumerate(mentions)], MENTION)
    left = spark.createDataFrame([(tid, a, k, b) for k, (a, b) in enumerate(residuals)], RESIDUAL)
    r = deidentify(turns, said, left, threshold)
    out = [x.anonymised_text for x in r.turns.orderBy("turn_id").collect()]
    items = [(x.text, x.reason) for x in r.review_items.orderBy("item_ord").collect()]
    registry = {x.surface_key: x.token for x in r.registry.orderBy("ord").collect()}
    return out, items, r.reports.first().status, registry, r


CASES = [
    (["Alex attended Oak Park School.", "Did Alex enjoy it?"], [(0, "Alex", "person_name", 0.9), (0, "Oak Park School", "school", 0.9)], [], ["[NAME_1] attended [SCHOOL_1].", "Did [NAME_1] enjoy it?"], [], "clean"),
    (["Alex attended school.", "Does alex still see Dr Smith?"], [(0, "Alex", "person_name", 0.9), (0, "school", "school", 0.9), (1, "Dr Smith", "clinician_name", 0.9)], [], ["[NAME_1] attended school.", "Does [NAME_1] still see [NAME_2]?"], [], "clean"),
    (["I saw Smith."], [], [(0, "Smith")], ["I saw [PII_1]."], [("Smith", "gate: auto-corrected")], "clean"),
    (["Maybe Alex was there."], [(0, "Alex", "person_name", 0.2)], [], ["Maybe [NAME_1] was there."], [("Alex", "low-confidence detection")], "needs_review"),
    (["Nothing sensitive here."], [], [(0, "Someone Else Entirely")], ["Nothing sensitive here."], [], "clean"),
    (["Home with the kids in undergrad."], [(0, "the kids", "family_member", 0.9), (0, "undergrad", "school", 0.9)], [(0, "PLACE_1"), (0, "NAME_2")], ["Home with the kids in undergrad."], [], "clean"),
    (["Anna met Ann."], [(0, "Ann", "person_name", 0.9)], [], ["[NAME_1]a met [NAME_1]."], [], "clean"),
    (["Ask Alex, or Alex"], [(0, "Alex,", "person_name", 0.9), (0, "Alex", "school", 0.9)], [], ["Ask [NAME_1] or [SCHOOL_1]"], [], "clean"),
    (["Ask Oak  Park and Oak Park"], [], [(0, "Oak Park")], ["Ask Oak  Park and [PII_1]"], [("Oak Park", "gate: auto-corrected")], "clean"),
    (["x 👍 a.b@x.org é"], [], [], ["x 👍 [EMAIL_1] é"], [], "clean"),
]


MORE = [
    (["Kim", "Kim"], [(0, "Kim", "person_name", 0.9), (1, "Kim", "school", 0.9)], []),  # the first type decides the prefix
    (["Zed and Fox"], [(0, "Zed", "other", 0.9)], [(0, ""), (0, "Fox"), (0, "Fox")]),  # gate numbers go on, the empty hit takes one
    (["Dr Alex came.", "Dr [NAME_1] it is."], [(0, "Alex", "person_name", 0.9)], [(1, "Dr [NAME_1]")]),  # a hit with a token in it
]


@pytest.fixture(scope="module")
def outcome(spark):
    """All cases as transcripts of one run."""
    every = [c[:3] for c in CASES] + MORE
    turns = spark.createDataFrame([(f"t{k}", i, "s", x) for k, c in enumerate(every) for i, x in enumerate(c[0])], TURN)
    said = spark.createDataFrame([(f"t{k}", m[0], i, *m[1:]) for k, c in enumerate(every) for i, m in enumerate(c[1])], MENTION)
    left = spark.createDataFrame([(f"t{k}", m[0], i, m[1]) for k, c in enumerate(every) for i, m in enumerate(c[2])], RESIDUAL)
    r = deidentify(turns, said, left, 0.5)
    out = {f"t{k}": ([], [], None, {}) for k in range(len(every))}
    for x in r.turns.orderBy("turn_id").collect():
        out[x.transcript_id][0].append(x.anonymised_text)
    for x in r.review_items.orderBy("item_ord").collect():
        out[x.transcript_id][1].append((x.text, x.reason))
    for x in r.registry.orderBy("ord").collect():
        out[x.transcript_id][3][x.surface_key] = x.token
    status = {x.transcript_id: x.status for x in r.reports.collect()}
    return {k: (v[0], v[1], status[k], v[3]) for k, v in out.items()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_documented_behaviour(outcome, case):
    assert outcome[f"t{case}"][:3] == CASES[case][3:]


def test_registry_quirks(outcome):
    first, second, third = (outcome[f"t{len(CASES) + k}"] for k in range(3))
    assert first[3] == {"kim": "[NAME_1]"}
    assert second[3] == {"zed": "[PII_1]", "": "[PII_2]", "fox": "[PII_3]"} and [x for x, _ in second[1]] == ["", "Fox"]
    assert third[0] == ["[PII_1] came.", "[PII_1] it is."] and third[3]["dr [name_1]"] == "[PII_1]"


def test_unresolved_lists_what_a_sweep_cannot_reach(spark):
    *_, r = run(spark, ["Annabel"], [], [(0, "Anna")])
    assert [x.text for x in unresolved(r).collect()] == ["Anna"]


def test_nulls_empty_tables_repeats_and_other_columns(spark):
    rows = [("t", 0, "s", None), ("t", 1, "s", ""), ("t", 2, None, "Call 212-555-0147."), ("t", 2, None, "Call 212-555-0147."), (None, 3, "s", "x"), ("u", None, "s", "y")]
    turns = spark.createDataFrame(rows, TURN)
    from pyspark.sql import functions as F

    turns = turns.withColumn("spans", F.lit(1)).withColumn("token", F.lit("x")).withColumn("anonymised_text", F.lit("old"))
    r = deidentify(turns)
    assert [(x.turn_id, x.anonymised_text) for x in r.turns.orderBy("turn_id").collect()] == [(0, None), (1, ""), (2, "Call [PHONE_1].")]
    empty = deidentify(turns.limit(0))
    assert all(getattr(empty, t).count() == 0 for t in ("turns", "spans", "registry", "review_items", "reports"))


def test_structured_spans_as_in_plain_python(spark):
    rng = random.Random(4)
    bits = ["a.b@x.org", "@ann_b.", "https://x.org/é).", "212-555-0147", "(415) 555-0198", "2125550147", "5551234567", "1/2/2020", "March 15, 2020", "3rd of april", "may 2020", "2019", "20191", "12345678", "é9", "²", "👍", "x", " ", " ", ".", "-", "+1 ", "\x1c", " ", "_", "ﬁ", "@", "1", "June", "th"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    turns = spark.createDataFrame([("t", i, "", x) for i, x in enumerate(texts)], TURN)
    got = {}
    for r in regex_spans(turns).collect():
        got.setdefault(r.turn_id, []).append((r.span_start, r.span_end, r.text, r.pii_type))
    merged = {}
    for r in exploded(detect(turns)).collect():
        merged.setdefault(r.turn_id, []).append((r.span_start, r.span_end, r.text, r.pii_type))
    for i, x in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted(structured(x)), x
        assert sorted(merged.get(i, [])) == disjoint(structured(x)), x


def test_merge_keeps_the_leftmost_not_the_longest(spark):
    rows = [("t", 0, a, b, "", "other", 1.0, "llm") for a, b in ((0, 4), (2, 20), (5, 8))]
    spans = spark.createDataFrame(rows, "transcript_id string, turn_id int, span_start int, span_end int, text string, pii_type string, confidence double, source string")
    assert [(r.span_start, r.span_end) for r in merge_spans(spans, ["source"]).collect()] == [(0, 4), (5, 8)]


def test_locate_is_literal(spark):
    turns = spark.createDataFrame([("t", 0, "", "a\\Eb a\\Eb (x) aa"), ("t", 1, "", None)], TURN)
    said = spark.createDataFrame([("t", 0, 0, "a\\Eb", "other", 0.9), ("t", 0, 1, "(x)", "other", 0.9), ("t", 0, 2, "", "other", 0.9), ("t", 0, 3, None, "other", 0.9), ("t", 1, 0, "a", "other", 0.9)], MENTION)
    assert sorted((r.ord, r.span_start, r.span_end) for r in locate_mentions(said, turns).collect()) == [(0, 0, 4), (0, 5, 9), (1, 10, 13)]


def test_numbers_by_blocks_as_by_one_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randint(0, 1), rng.randint(0, 60), rng.randint(0, 5), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, p int, turn_id int, x int, i int")
    got = {r.i: r.n for r in numbered(df, ["g"], ["x", "i"], "n", major=["p"], block_turns=7).collect()}
    expected = {}
    for g in "ab":
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            expected[r[4]] = n + 1
    assert got == expected


def test_large_transcripts_take_the_other_way_to_the_same_result(spark, monkeypatch):
    rng = random.Random(1)
    names = [f"Name{chr(97 + i % 26)}{i}" for i in range(90)]
    texts = [" ".join(rng.choice([*names, "and", "met", "NAMEa0"]) for _ in range(6)) for _ in range(60)]
    mentions = [(0, n, "person_name", 0.9) for n in names]
    texts[0] = " ".join(names)
    monkeypatch.setattr(lookup, "PART", 7)  # words of more turns than this are salted
    out, *_ = run(spark, texts, mentions, [(0, "[NAME_1]")])
    token = {n.lower(): f"[NAME_{i + 1}]" for i, n in enumerate(names)}
    assert out == [" ".join(token.get(w.lower(), w) for w in x.split(" ")) for x in texts]
