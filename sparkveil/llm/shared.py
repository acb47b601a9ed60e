"""Problem 8: long spans that stand verbatim in more than one document.

Texts are recompressed: in each round short runs of one symbol and then pairs of symbols get a common name, a hash of what
they stand for, so equal stretches get equal symbols wherever they stand but for a bounded margin at either end (symbols are
bounded in length, hence the margin is). Every window of 256 characters names one of the top symbols in its middle as its
anchor, by the least hash, and so equal windows name equal anchors. Then

1. anchors are exchanged by the hash of the text from the anchor on; those that stand in two documents are kept;
2. windows of kept anchors go, in groups of up to 16 neighbours, by the hash of the 241 characters that all of the group have,
   together with the 15 characters at either side, which tell the windows apart; windows found in two documents are shared;
3. shared windows of a document are united to maximal runs.

What is found shared among the documents of one batch needs no exchange: only one row for each content goes out to tell other
batches. So a passage in a third of all documents costs a row or two a batch. A group that is large all the same is taken
apart into single windows, which are exchanged once more by their own hashes. Exact copies of whole documents are found by
their hash. Hashes are of 64 bits; two are combined for windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.llm.codepoints import from_codepoints, slices, to_codepoints

U = np.uint64
LEAST, ROUNDS, MARGIN = 256, 3, 32  # the margin of 3 rounds is 28: twice 2 + 4 + 8
REACH, CONTEXT, STEP = 140, 84, 16  # an anchor lies within MARGIN..MARGIN+REACH of its window; MARGIN+REACH+CONTEXT = LEAST
CORE = LEAST - STEP + 1
BASE = U(0xD1342543DE82EF95)
BACK = U(pow(int(BASE), -1, 2**64))
GROUP_LIMIT = 200_000
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 21)
        _powers["up"] = np.cumprod(np.r_[U(1), np.full(size - 1, BASE, U)])
        _powers["down"] = np.cumprod(np.r_[U(1), np.full(size - 1, BACK, U)])
    return _powers["up"], _powers["down"]


class Hashes:
    """Hash of any stretch of a code-point array in constant time."""

    def __init__(self, x: np.ndarray) -> None:
        self.up, self.down = _power(len(x) + 1)
        self.total = np.zeros(len(x) + 1, U)
        np.cumsum(_mix(x + U(0x1234567)) * self.up[: len(x)], out=self.total[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.total[b] - self.total[a]) * self.down[a])


def recompress(x: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, their starts) after some rounds. x: code points; first: true where a text begins. A symbol of round k
    (from 0) covers at most 2**(k+1) code points."""
    name, start = _mix(x + U(0x51ED2701)), np.arange(len(x))
    for k in range(rounds):
        limit, end = 2 << k, len(x)
        new = np.r_[True, (name[1:] != name[:-1]) | first[start[1:]]]
        at = np.flatnonzero(new)
        count = np.diff(np.r_[at, len(name)])
        covered = np.diff(np.r_[start[at], end])
        join = (count > 1) & (covered <= limit)
        if join.any():
            name[at[join]] = _mix(name[at[join]] * U(31) + count[join].astype(U))
            keep = new | ~np.repeat(join, count)
            name, start = name[keep], start[keep]
        side = (_mix(name + U(k + 1)) & U(1)).astype(bool)
        size = np.diff(np.r_[start, end])
        pair = np.flatnonzero(~side[:-1] & side[1:] & ~first[start[1:]] & (size[:-1] + size[1:] <= limit))
        name[pair] = _mix(name[pair] * U(0x9E3779B97F4A7C15) + name[pair + 1])
        keep = np.ones(len(name), bool)
        keep[pair + 1] = False
        name, start = name[keep], start[keep]
    return name, start


def windows(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, anchor) of every window of 256 code points inside one text, both counted in the whole array."""
    length = np.diff(offsets)
    span = np.maximum(length - LEAST + 1, 0)
    if not span.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(x), bool)
    first[offsets[:-1][length > 0]] = True
    name, at = recompress(x, first)
    value = np.full(-(-len(x) // REACH) * REACH + 2 * REACH, np.iinfo(np.uint64).max, U)
    value[at] = (_mix(name) & U(0xFFFFFFFF00000000)) | at.astype(U)
    block = value.reshape(-1, REACH)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.repeat(offsets[:-1] - np.r_[0, np.cumsum(span)[:-1]], span) + np.arange(span.sum())
    least = np.minimum(behind[start + MARGIN], ahead[start + MARGIN + REACH - 1])
    return start, (least & U(0xFFFFFFFF)).astype(np.int64)


def _in_two(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(true where the key stands in two documents, true at one row for each key)."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    both = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
    two, one = np.empty(len(key), bool), np.zeros(len(key), bool)
    two[order] = np.repeat(both, np.diff(np.r_[at, len(k)]))
    one[order[at]] = True
    return two, one


def _texts(batches):
    """Slices of the batches: the rows that aren't a copy of an earlier one of the slice, the code points, the offsets."""
    for whole in batches:
        for part in slices(whole, "text"):
            _, rows = np.unique(part.column("copy").to_numpy(zero_copy_only=False), return_index=True)
            part = part.take(pa.array(np.sort(rows)))
            cps, offsets = to_codepoints(part.column("text"))
            yield part, cps.astype(U), offsets


ROW = "key long, doc_id {}, a int, b int, kind byte"  # kind: 0 asks whether the key is in two documents, 1 known, 2 only tells


def _out(key, docs, a, b, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.astype(U).view(np.int64)), docs, pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(kind, pa.int8())], names=["key", "doc_id", "a", "b", "kind"])


def _anchors(batches):
    for part, x, offsets in _texts(batches):
        _, anchor = windows(x, offsets)
        if not len(anchor):
            continue
        at = anchor[np.r_[True, anchor[1:] != anchor[:-1]]]
        key = Hashes(x)(at, at + CONTEXT)
        doc = np.searchsorted(offsets, at, side="right") - 1
        two, one = _in_two(key, doc)
        pos = (at - offsets[doc]).astype(np.int32)
        known, tell = np.flatnonzero(two), np.flatnonzero(two & one)
        ask = np.flatnonzero(~two)
        pick = np.r_[known, tell, ask]
        kind = np.repeat(np.array([1, 2, 0], np.int8), [len(known), len(tell), len(ask)])
        yield _out(key[pick], part.column("doc_id").take(pa.array(doc[pick])), pos[pick], pos[pick], kind)


def _answers(batches):
    """Rows sorted by key and doc_id; gives doc_id, a, b of those known and of those asking whose key is in two documents."""
    held: list[pa.RecordBatch] = []
    proven: int | None = None  # key that is already known to be in two documents

    def answer(table: pa.RecordBatch, last: bool):
        nonlocal held, proven
        key = table.column("key").to_numpy()
        doc = table.column("doc_id").to_numpy(zero_copy_only=False)
        kind = table.column("kind").to_numpy()
        known = kind == 1
        two = np.zeros(len(key), bool)
        rest = np.flatnonzero(~known)
        if len(rest):
            k, d = key[rest], doc[rest]
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[at, len(k)])
            both = (d[at] != d[at + size - 1]) | ((k[at] == proven) if proven is not None else False)
            two[rest] = np.repeat(both, size)
            if not last:
                tail = rest[at[-1] :]
                if both[-1]:
                    proven, held = int(k[-1]), []
                else:
                    proven, held = None, [table.take(pa.array(tail))]
        give = known | (two & (kind == 0))
        return table.select(["doc_id", "a", "b"]).filter(pa.array(give))

    schema = None
    for batch in batches:
        schema = batch.schema
        table = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()
        held = []
        if table:
            yield answer(table[0], False)
    # What is still held stands in one document only.


def _groups(batches):
    """Rows doc_id, text, copy, kept (positions of kept anchors); gives known runs of windows, and groups of windows."""
    for part, x, offsets in _texts(batches):
        start, anchor = windows(x, offsets)
        kept = np.zeros(len(x) + 1, bool)
        lists = part.column("kept")
        at = lists.flatten().to_numpy().astype(np.int64)
        kept[at + np.repeat(offsets[:-1], lists.value_lengths().to_numpy())] = True
        sel = kept[anchor]
        start, anchor = start[sel], anchor[sel]
        if not len(start):
            continue
        doc = np.searchsorted(offsets, start, side="right") - 1
        h = Hashes(x)
        two, one = _in_two(h(start, start + LEAST), doc)
        # Known windows, as runs of neighbours.
        w = np.flatnonzero(two)
        ids = part.column("doc_id")
        if len(w):
            cut = np.r_[True, (np.diff(start[w]) != 1) | (np.diff(doc[w]) != 0)]
            b, e = w[cut], w[np.r_[cut[1:], True]]
            yield _wide(np.zeros(len(b), U), ids.take(pa.array(doc[b])), start[b] - offsets[doc[b]], start[e] - offsets[doc[b]], np.ones(len(b), np.int8), None)
        # Groups: windows of one anchor whose distance to it has the same quotient by STEP.
        part_of = (anchor - start) // STEP
        cut = np.r_[True, (anchor[1:] != anchor[:-1]) | (part_of[1:] != part_of[:-1])]
        group = np.cumsum(cut) - 1
        need = np.bincount(group, ~two | one) > 0
        b, e = np.flatnonzero(cut)[need], np.flatnonzero(np.r_[cut[1:], True])[need]
        core = anchor[b] - part_of[b] * STEP
        j0, j1 = core - start[e], core - start[b]
        d = doc[b]
        around = core[:, None] + np.r_[np.arange(1 - STEP, 0), np.arange(CORE, CORE + STEP - 1)]
        inside = (around >= offsets[d][:, None]) & (around < offsets[d + 1][:, None])
        chars = np.where(inside, x[np.clip(around, 0, len(x) - 1)], U(0)).astype(np.uint32)
        edge = from_codepoints(chars.ravel(), np.arange(len(b) + 1) * (2 * STEP - 2))
        yield _wide(h(core, core + CORE), ids.take(pa.array(d)), core - offsets[d], j0 * STEP + j1, np.zeros(len(b), np.int8), edge)


def _wide(key, docs, a, b, kind, edge) -> pa.RecordBatch:
    edge = pa.nulls(len(kind), pa.string()) if edge is None else edge
    return pa.RecordBatch.from_arrays([*_out(key, docs, a, b, kind).columns, edge], names=["key", "doc_id", "a", "b", "kind", "edge"])


def _expand(table: pa.RecordBatch):
    """For groups: the hash of each of the 16 windows, and which of them are there."""
    n = len(table)
    chars, _ = to_codepoints(table.column("edge"))
    c = chars.reshape(n, 2 * STEP - 2).astype(U) + U(1)
    left, right = np.zeros((n, STEP), U), np.zeros((n, STEP), U)
    for k in range(1, STEP):
        left[:, k] = _mix(left[:, k - 1] * BASE + c[:, STEP - 1 - k])
        right[:, k] = _mix(right[:, k - 1] * BASE + c[:, STEP - 2 + k])
    key = table.column("key").to_numpy().view(U)[:, None]
    j = np.arange(STEP)
    hashes = _mix(key + _mix(left * U(3) + U(5)) + _mix(right[:, ::-1] * U(7) + j.astype(U)))
    span = table.column("b").to_numpy()[:, None]
    return hashes, (j >= span // STEP) & (j <= span % STEP)


def _runs(table: pa.RecordBatch, found: np.ndarray):
    """Windows found in groups, as runs of starts."""
    a = table.column("a").to_numpy()
    pad = np.zeros((len(found), 1), bool)
    change = np.diff(np.hstack([pad, found, pad]).astype(np.int8), axis=1)
    row, j0 = np.nonzero(change == 1)
    _, j1 = np.nonzero(change == -1)
    return row, a[row] - (j1 - 1), a[row] - j0


def _resolve(batches, limit: int = GROUP_LIMIT):
    """Groups sorted by key; gives runs of shared windows (kind 1), and single windows (kind 0) of groups that are too large."""
    held: pa.RecordBatch | None = None
    large: int | None = None

    def apart(table: pa.RecordBatch) -> pa.RecordBatch:
        hashes, there = _expand(table)
        row, j = np.nonzero(there)
        s = table.column("a").to_numpy()[row] - j
        return _out(hashes[row, j], table.column("doc_id").take(pa.array(row)), s, s, np.zeros(len(row), np.int8))

    def together(table: pa.RecordBatch) -> pa.RecordBatch:
        hashes, there = _expand(table)
        row, j = np.nonzero(there)
        _, doc = np.unique(table.column("doc_id").to_numpy(zero_copy_only=False), return_inverse=True)
        two, _ = _in_two(hashes[row, j], doc[row])
        found = np.zeros(there.shape, bool)
        found[row[two], j[two]] = True
        r, s0, s1 = _runs(table, found)
        return _out(np.zeros(len(r), U), table.column("doc_id").take(pa.array(r)), s0, s1, np.ones(len(r), np.int8))

    for batch in batches:
        kind = batch.column("kind").to_numpy()
        known = batch.filter(pa.array(kind == 1))
        if len(known):
            yield known.select(["key", "doc_id", "a", "b", "kind"])
        batch = batch.filter(pa.array(kind != 1))
        if large is not None and len(batch):
            same = batch.column("key").to_numpy() == large
            if same.any():
                yield apart(batch.filter(pa.array(same)))
                batch = batch.filter(pa.array(~same))
        if not len(batch):
            continue
        table = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
        key = table.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield together(table.slice(0, cut))
        held = table.slice(cut)
        if len(held) > limit:
            large = int(key[-1])
            yield apart(held)
            held = None
    if held is not None and len(held):
        yield together(held)


def shared_spans(documents: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Rows doc_id, span_start, span_end: the maximal runs of positions that lie in a span of at least 256 code points which
    stands, character for character, in another document too.

    Null doc_ids, null texts and texts below 256 code points give no row, repeated rows of a document count once, repeats
    within a document do not count. Other columns are left out. `group_limit`: rows of one content a task takes at once.
    """
    docs = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= LEAST))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    row = ROW.format(id_type)
    texts = docs.withColumn("copy", F.xxhash64("text"))
    spread = F.when(F.col("kind") == 1, F.xxhash64("doc_id", "a")).otherwise(F.col("key"))
    anchors = texts.mapInArrow(_anchors, row)
    kept = anchors.repartition(spread).sortWithinPartitions("key", "doc_id").mapInArrow(_answers, f"doc_id {id_type}, a int, b int")
    kept = kept.groupBy("doc_id").agg(F.collect_list("a").alias("kept"))
    groups = texts.join(kept, "doc_id").mapInArrow(_groups, row + ", edge string")
    found = groups.repartition(spread).sortWithinPartitions("key").mapInArrow(lambda batches: _resolve(batches, group_limit), row)
    found = found.repartition(spread).sortWithinPartitions("key", "doc_id").mapInArrow(_answers, f"doc_id {id_type}, a int, b int")
    # Exact copies are shared as a whole.
    whole = docs.select("doc_id", F.length("text").alias("n"), F.md5("text").alias("hash"))
    many = whole.groupBy("hash", "n").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("hash", "n")
    copies = whole.join(many, ["hash", "n"], "left_semi").select("doc_id", F.lit(0).alias("a"), (F.col("n") - LEAST).alias("b"))
    return unite(found.unionByName(copies).select("doc_id", F.col("a").alias("s"), (F.col("b") + LEAST).alias("e")))


def unite(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans (doc_id, s, e) as maximal ones."""
    order = Window.partitionBy("doc_id").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(before >= F.col("s"), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "run").agg(F.min("s").cast("int").alias("span_start"), F.max("e").cast("int").alias("span_end")).drop("run")


def shared_report(documents: DataFrame) -> DataFrame:
    """Rows doc_id, n_chars, shared_chars, share: how much of each document stands elsewhere. A null text has null n_chars."""
    docs = documents.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars"))
    spans = shared_spans(documents).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    out = docs.join(spans, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared", F.lit(0)).cast("long")).drop("shared")
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)))
