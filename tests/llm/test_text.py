"""Problems 1, 2, 6, 7 and 8 against brute force on small tables."""

import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkveil.llm import leak, lookalike, packing, shared, split
from sparkveil.llm.codepoints import from_codepoints, slices, to_codepoints

BITS = ["a", "é", "é", "👍", "", "ﬁ", "​", "Ｘ", "花", "x y. ", "\n\n", "! ", " "]


def noise(rng, n):
    return "".join(rng.choice(BITS) for _ in range(n))


def test_codepoints_there_and_back():
    rng = random.Random(1)
    texts = [None, "", *[noise(rng, rng.randint(0, 9)) for _ in range(200)]]
    column = pa.array(texts, pa.string())
    for part in (column, column.slice(3, 50), pa.array([], pa.string()), pa.array(["ab", "c"])):
        cps, offsets = to_codepoints(part)
        assert from_codepoints(cps, offsets).to_pylist() == [x or "" for x in part.to_pylist()]
        assert [offsets[i + 1] - offsets[i] for i in range(len(part))] == [len(x or "") for x in part.to_pylist()]
    batch = pa.RecordBatch.from_arrays([column], names=["t"])
    assert [x for p in slices(batch, "t", 30) for x in p.column("t").to_pylist()] == texts


def test_equal_looks_come_out_equal():
    same = [("Аrоha", "Aroha"), ("Ｔａｒｎ​wick", "Tarnwick"), ("café", "café"), ("ﬁsh oil", "fish oil"), ("a­b﻿c", "abc"), ("НЕLLО", "HELLO")]
    assert [lookalike.fold_strings([a])[0] for a, _ in same] == [b for _, b in same]
    assert lookalike.fold_strings(["окошко", "καλάθι", "é", "e", "x²", "👩‍🍳", ""]) == ["окошко", "καλάθι", "é", "e", "x²", "👩‍🍳", ""]
    rng = random.Random(2)
    for _ in range(300):
        x = "z" + "".join(rng.choice(["a", "e", "̧", "̣", "́", "̈", "é", "É"]) for _ in range(6))
        a, b, c = lookalike.fold_strings([x + "ü", unicodedata.normalize("NFC", x) + "ü", unicodedata.normalize("NFD", x) + "ü"])
        assert a == b == c


def test_normalise_keeps_rows_and_other_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "Ｘ", "y"), (2, "Ｘ", "y"), (3, "", None)], "k int, text string, more string")
    out = lookalike.normalise_lookalikes(df, ["text", "more"])
    assert sorted(map(str, out.collect())) == sorted(map(str, [r for r in out.collect()])) and [r.text_normal for r in out.orderBy("k").collect()] == [None, "X", "X", ""]
    assert lookalike.normalise_lookalikes(df.limit(0), ["text"]).count() == 0
    with pytest.raises(ValueError):
        lookalike.normalise_lookalikes(df.withColumn("text_normal", F.lit(1)), ["text"])


def test_find_lookalikes(spark):
    turns = [("t", 0, "I met Renée Ashby."), ("t", 0, "I met Renée Ashby."), ("t", 1, None), ("t", 2, "Аnn Lее"), (None, 0, "x")]
    items = [("t", 0, 0, "Renée"), ("t", 1, 0, "RENÉE"), ("t", 2, 0, "renée"), ("t", 3, 0, "Renee"), ("t", 4, 0, " "), ("t", 5, 0, None), ("t", 6, 1, "x"), ("t", 7, 2, "ann lee"), ("t", 7, 2, "ann lee"), ("t", 8, 2, "ann leee"), ("t", 9, 9, "x"), ("t", 10, 0, "Rene\u0301e Ash\u200bby")]
    a = spark.createDataFrame(turns, "transcript_id string, turn_id int, text string").withColumn("item_ord", F.lit(5))
    b = spark.createDataFrame(items, "transcript_id string, item_ord int, turn_id int, text string").withColumn("turn_text", F.lit("clash"))
    assert sorted(r.item_ord for r in lookalike.find_lookalikes(b, a).collect()) == [7, 10]


def check_pieces(text, spans, limit, overlap):
    at = 0
    for k, (a, b) in enumerate(spans):
        assert 0 < b - a <= limit and (a == 0 if k == 0 else at - overlap <= a <= at) and b > at
        at = b
    assert at == len(text)


def test_split_keeps_all_text(spark):
    rng = random.Random(3)
    texts = ["", "x" * 1000, "x" * 1001, "x" * 5000, "word " * 900, *[noise(rng, rng.randint(1, 4000)) for _ in range(30)]]
    df = spark.createDataFrame([(i, x, i) for i, x in enumerate(texts)] + [(99, None, 0)], "k int, text string, piece int")
    got = {}
    for r in split.split_texts(df, ["k"]).collect():
        got.setdefault(r.k, []).append(r)
    assert set(got) == {i for i, x in enumerate(texts) if x}
    for k, rows in got.items():
        rows.sort(key=lambda r: r.piece)
        assert all(texts[k][r.piece_start : r.piece_end] == r.piece_text and r.n_pieces == len(rows) for r in rows)
        check_pieces(texts[k], [(r.piece_start, r.piece_end) for r in rows], 1000, 100)
    assert split.split_texts(df.limit(0), ["k"]).count() == 0


def test_split_prefers_paragraphs_then_sentences_then_words():
    cps = lambda s: to_codepoints(pa.array([s]))[0]
    for mark in ("\n\n", ". ", " "):
        text = "x" * 700 + mark + "y" * 900
        assert split.cut(cps(text))[0] == (0, 700 + len(mark))
    assert split.cut(cps("a. " + "b " * 250 + "\n\n" + "c. " * 400))[0] == (0, 505)


def test_split_files_by_byte_ranges(spark, tmp_path):
    rng = random.Random(4)
    text = "".join(rng.choice(["word ", "été ", "the end. ", "花园", "\n\n", "👍 ", "longword"]) for _ in range(9000))
    (tmp_path / "a.txt").write_text(text, encoding="utf-8")
    (tmp_path / "b.txt").write_text("", encoding="utf-8")
    rows = split.split_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], 300, 40, range_bytes=7001, halo=500).collect()
    rows.sort(key=lambda r: r.piece_start)
    assert all(text[r.piece_start : r.piece_end] == r.piece_text for r in rows)
    check_pieces(text, [(r.piece_start, r.piece_end) for r in rows], 300, 40)


def test_best_fit_takes_the_tightest_container():
    rng = random.Random(5)
    for _ in range(200):
        sizes = sorted((rng.randint(0, 50) for _ in range(rng.randint(0, 60))), reverse=True)
        bins = []
        for s in sizes:
            fit = [left for left in bins if left >= s]
            left = min(fit) if fit else 50
            if fit:
                bins.remove(left)
            bins.append(left - s)
        used = {}
        for s, c in zip(sizes, packing.best_fit(sizes, 50)):
            used[c] = used.get(c, 0) + s
        assert sorted(50 - u for u in used.values()) == sorted(bins)


def test_pack_places_every_document(spark):
    rows = [(i, "word " * (i * 40)) for i in range(60)] + [(3, "word " * 120), (100, None), (101, ""), (102, "a b " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    packed = packing.pack(docs, 2048, shard_docs=30)
    out = packed.collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows}
    used, total = {}, {}
    for r in out:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert max(used.values()) <= 2048 and total[100] == total[101] == 0 and total[102] > 2048
    encode = packing.encoder(f"{packing.TOKENIZER_DIR}/{packing.TOKENIZER_FILE}").encode_ordinary
    assert all(total[i] == len(encode(x or "")) for i, x in rows)
    assert packing.packing_report(packed).first().n_documents == len(total)
    assert packing.packing_report(packing.pack(docs.limit(0))).first().n_documents == 0


def test_leaks_as_by_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(25))) for i in range(8)] + [(8, None), (9, ""), (10, "w1 w2")]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            w = items[rng.randrange(8)][1].split()
            a = rng.randrange(20)
            parts += w[a : a + rng.randint(1, 20)] if rng.random() < 0.7 else [rng.choice(["Zed", *words])]
        docs.append((i, rng.choice([", ", " ", "\n", " — "]).join(x.upper() if rng.random() < 0.3 else x.replace("w", "ｗ") if rng.random() < 0.1 else x for x in parts)))
    docs += [(0, docs[0][1]), (100, None), (101, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    e = spark.createDataFrame(items, "item_id long, item_text string").withColumn("text", F.lit("x"))
    expected = set()
    for i, text in docs:
        seq = re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text or "").lower())
        runs = {tuple(seq[k : k + 10]) for k in range(len(seq) - 9)}
        for j, item in items:
            w = (item or "").split()
            if any(tuple(w[k : k + 10]) in runs for k in range(len(w) - 9)):
                expected.add((i, j))
    for block in (2_000_000, 60):
        found = leak.find_leaks(d, e, block_words=block).collect()
        assert {(r.doc_id, r.item_id) for r in found} == expected and expected
        text = dict(docs)
        assert all(r.n_words >= 10 and len(re.findall(r"[^\W_]+", text[r.doc_id][r.span_start : r.span_end])) == r.n_words for r in found)
    clean = leak.remove_leaks(d, e)
    assert leak.find_leaks(clean, e).count() <= len(expected) and clean.count() == len(text)
    assert leak.find_leaks(d, e.limit(0)).count() == 0 and leak.find_leaks(d.limit(0), e).count() == 0


def brute_shared(docs):
    where = {}
    for i, t in docs.items():
        for k in range(len(t) - 255):
            where.setdefault(t[k : k + 256], set()).add(i)
    out = set()
    for i, t in docs.items():
        on = [False] * len(t)
        for k in range(len(t) - 255):
            if len(where[t[k : k + 256]]) > 1:
                on[k : k + 256] = [True] * 256
        a = None
        for k, x in enumerate([*on, False]):
            if x and a is None:
                a = k
            if not x and a is not None:
                out.add((i, a, k))
                a = None
    return out


@pytest.mark.parametrize("limit", [200_000, 3])
def test_shared_spans_as_by_brute_force(spark, limit):
    rng = random.Random(7)
    letters = "abcdeé 👍"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    base = [make(1500) for _ in range(6)] + ["ab" * 400, "x" * 900, make(256), make(255)]
    docs = {}
    for i in range(70):
        parts = []
        for _ in range(rng.randint(1, 3)):
            b = rng.choice(base)
            a = rng.randrange(max(1, len(b) - 200))
            parts += [b[a : a + rng.choice([200, 255, 256, 257, 300, 700, 2000])], make(rng.randint(0, 60))]
        docs[i] = "".join(parts)
    docs |= {200: base[0], 201: base[0], 202: base[8], 203: base[8], 204: base[9], 205: base[9], 206: "y" + base[7], 207: base[7] * 2}
    rows = [*docs.items(), (0, docs[0]), (300, None), (301, ""), (None, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("copy", F.lit("x")).withColumn("key", F.lit(1)).repartition(5)
    got = {(r.doc_id, r.span_start, r.span_end) for r in shared.shared_spans(df, limit).collect()}
    assert got == brute_shared(docs)
    assert shared.shared_spans(df.limit(0)).count() == 0


def test_shared_report(spark):
    df = spark.createDataFrame([(1, "q" * 300 + "a"), (2, "b" + "q" * 300), (3, "c"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: (r.n_chars, r.shared_chars) for r in shared.shared_report(df).collect()} == {1: (301, 300), 2: (301, 300), 3: (1, 0), 4: (None, 0)}


def test_more_looks():
    assert lookalike.fold_strings(["한글", "Ꮇary", "ⲞⲢⲤ", "ᴀɴɴ lee", "a\tb", "ﬁ" * 50 + "ﬄ"]) == ["한글", "Mary", "OPC", "ann lee", "a b", "fi" * 50 + "ffl"]
    many = "a" + "̧̣́̈" * 6
    assert len({lookalike.fold_strings([unicodedata.normalize(f, many)])[0] for f in ("NFC", "NFD")}) == 1


def test_containment_as_of_strings():
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    parts, texts = [word(rng.randint(0, 4)) for _ in range(500)], [word(rng.randint(0, 12)) for _ in range(500)]
    (a, ao), (b, bo) = to_codepoints(pa.array(parts)), to_codepoints(pa.array(texts))
    assert lookalike.contained(*lookalike._stripped(a, ao), b, bo).tolist() == [bool(x.strip()) and x.strip() in y for x, y in zip(parts, texts)]


@pytest.mark.parametrize("size", [900, 1700])
def test_long_texts_by_ranges(spark, size):
    rng = random.Random(size)
    texts = ["x" * 5000, "word " * 1500, *["".join(rng.choice(BITS) for _ in range(rng.randint(100, 6000))) for _ in range(12)]]
    df = spark.createDataFrame([(i, x, "t") for i, x in enumerate(texts)] + [(None, texts[1], "t"), (3, texts[3], "t"), (50, None, "t")], "k int, text string, lo string")
    got = {}
    for r in split.split_texts(df, ["k"], limit=300, overlap=40, range_chars=size, halo=200).collect():
        got.setdefault(r.k, []).append(r)
    assert set(got) == {*range(len(texts)), None}
    for k, rows in got.items():
        text = texts[1 if k is None else k]
        rows = sorted({(r.piece, r.piece_start, r.piece_end, r.piece_text, r.n_pieces) for r in rows})
        assert [r[0] for r in rows] == list(range(len(rows))) and all(text[a:b] == t and n == len(rows) for _, a, b, t, n in rows)
        check_pieces(text, [(a, b) for _, a, b, _, _ in rows], 300, 40)


def test_leaks_are_removed_by_length_or_coverage(spark):
    item = [f"i{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, "a " + " ".join(item[:12]) + " z"), (2, "a " + " ".join(item[:25]) + " z"), (3, None), (4, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, item_text string")
    left = {r.doc_id: r.text for r in leak.remove_leaks(docs, items, length_limit=100, cover_limit=0.5).collect()}
    assert left == {1: "a " + " ".join(item[:12]) + " z", 2: "a  z", 3: None, 4: "nothing"}
    assert leak.remove_leaks(docs, items, length_limit=12).where("doc_id = 1").first().text == "a  z"
