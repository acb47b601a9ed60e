"""Problem 7: passages of held-out test items in a training corpus.

The items, in the one form of problem 2 and as word numbers, go into a generalised suffix automaton. Documents stream through
it: at each word the automaton gives the length of the longest stretch ending there that stands in some item; where it
reaches the least length, the items holding the last words are reported. Words are hashed for a whole batch at once, and only
runs of words that occur in some item are walked, as any other word sets the length to 0.

The items are the small side: their words are counted first, and beyond `block_words` words they are taken in several blocks, one
after the other. The driver holds the items of one block, builds its automaton once and sends it to the workers as arrays; each
block is a pass over the documents.

Defined results: null and empty texts and items give no row, an item shorter than the least length can't be found, repeated
documents count once by id, items that share a passage are all reported.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkveil.llm.codepoints import from_codepoints, slices, to_codepoints
from sparkveil.llm.lookalike import fold_codepoints, tables
from sparkveil.storage import cut_lineage

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
MIX = np.uint64(0xBF58476D1CE4E5B9)


def words_of(column: pa.Array):
    """(hash of each word, its row, its start and end in the original text counted in code points)."""
    cps, offsets = to_codepoints(column)
    out, out_off, src = fold_codepoints(cps, offsets, lower=True)
    if not len(out):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    is_word = tables().word[out] | tables().mark[out]
    edge = np.zeros(len(out) + 1, bool)
    edge[out_off] = True  # no word runs from one row into the next
    inside = np.r_[False, is_word, False]
    change = inside[1:] != inside[:-1]
    start = np.flatnonzero(is_word & (change[:-1] | edge[:-1]))
    end = np.flatnonzero(is_word & (change[1:] | edge[1:])) + 1
    hashes = np.empty(len(start), np.uint64)
    step = 1 << 20  # blocks of words, so the powers stay short
    lo = 0
    while lo < len(start):
        hi = min(len(start), max(lo + 1, int(np.searchsorted(start, start[lo] + step))))
        a, b = int(start[lo]), int(end[hi - 1])
        x = (out[a:b].astype(np.uint64) + np.uint64(7)) * MIX
        x ^= x >> np.uint64(31)
        power = np.cumprod(np.r_[np.uint64(1), np.full(b - a - 1, BASE, np.uint64)])
        back = np.cumprod(np.r_[np.uint64(1), np.full(b - a - 1, INVERSE, np.uint64)])
        total = np.r_[np.uint64(0), np.cumsum(x * power)]
        hashes[lo:hi] = (total[end[lo:hi] - a] - total[start[lo:hi] - a]) * back[start[lo:hi] - a]
        lo = hi
    hashes ^= hashes >> np.uint64(29)
    row = np.searchsorted(out_off, start, side="right") - 1
    first = offsets[row]
    return hashes, row, src[start] - first, src[end - 1] + 1 - first


class SuffixAutomaton:
    """Generalised over the items; words are numbers."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for seq in sequences:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self.items: list[set[int]] = [set() for _ in self.next]
        for k, seq in enumerate(sequences):
            at = 0
            for w in seq:
                at = self.next[at][w]
                up = at
                while up > 0 and k not in self.items[up]:
                    self.items[up].add(k)
                    up = self.link[up]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def arrays(self) -> Arrays:
        edges = sorted((state << 32 | w, to) for state, out in enumerate(self.next) for w, to in out.items())
        at = np.r_[0, np.cumsum([len(x) for x in self.items])]
        return Arrays(array("Q", [k for k, _ in edges]), array("I", [to for _, to in edges]), array("i", self.link), array("I", self.length), array("I", at.tolist()), array("I", [k for x in self.items for k in sorted(x)]))


class Arrays:
    """The automaton as it is sent and searched: edges sorted by state and word, items of each state end to end."""

    def __init__(self, *parts: array) -> None:
        self.keys, self.to, self.link, self.length, self.at, self.items = parts

    def _next(self, state: int, w: int) -> int:
        key = state << 32 | w
        k = bisect_left(self.keys, key)
        return self.to[k] if k < len(self.keys) and self.keys[k] == key else 0

    def stretches(self, seq: list[int], least: int):
        """(item, first word, last word + 1) of each maximal stretch of the sequence of at least that length in an item."""
        state = length = 0
        open_at: dict[int, list[int]] = {}
        out = []
        for i, w in enumerate(seq):
            to = self._next(state, w)
            while state and not to:
                state = self.link[state]
                length = self.length[state]
                to = self._next(state, w)
            state, length = (to, length + 1) if to else (0, 0)
            if length >= least:
                up = state
                while self.length[self.link[up]] >= least:
                    up = self.link[up]
                for k in self.items[self.at[up] : self.at[up + 1]]:
                    have = open_at.get(k)
                    if have and have[1] >= i + 1 - least:
                        have[1] = i + 1
                    else:
                        if have:
                            out.append((k, *have))
                        open_at[k] = [i + 1 - least, i + 1]
        out += [(k, *x) for k, x in open_at.items()]
        return out


def _clean(items: DataFrame) -> DataFrame:
    return items.where(F.col("item_id").isNotNull() & (F.col("item_text") != "")).select("item_id", "item_text").distinct()


def _block(items: DataFrame, k: int, n: int) -> tuple[list, list[list[int]], np.ndarray]:
    """Block k of n: ids, word numbers and the sorted hashes of the words."""
    rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "item_text").collect()
    hashes, row, _, _ = words_of(pa.array([r.item_text for r in rows], pa.string()))
    vocabulary, number = np.unique(hashes, return_inverse=True)
    sequences: list[list[int]] = [number[a:b].tolist() for a, b in zip(*(np.searchsorted(row, np.arange(len(rows)) + s) for s in (0, 1)))]
    return [r.item_id for r in rows], sequences, vocabulary


def find_leaks(documents: DataFrame, items: DataFrame, least_words: int = 10, block_words: int = 200_000) -> DataFrame:
    """Rows doc_id, item_id, span_start, span_end (code points of the text as stored), n_words, item_words: each maximal stretch of
    a document of at least `least_words` words that stands in the item. `block_words` bounds what the driver holds and sends."""
    docs = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.col("text") != ""))
    numbers = [T.StructField(c, T.IntegerType()) for c in ("span_start", "span_end", "n_words", "item_words")]
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", items.schema["item_id"].dataType), *numbers])
    clean = _clean(items)
    words = clean.agg(F.sum(F.size(F.split("item_text", r"\s+")))).first()[0] or 0
    n = max(1, -(-words // block_words))
    result = None
    for k in range(n):
        ids, sequences, vocabulary = _block(clean, k, n)
        sent = docs.sparkSession.sparkContext.broadcast((ids, [len(x) for x in sequences], vocabulary, SuffixAutomaton(sequences).arrays()))
        part = docs.mapInArrow(_finder(sent, least_words), schema)
        if n > 1:
            part = cut_lineage(part)
            sent.destroy()
        result = part if result is None else result.unionByName(part)
    return result.distinct()


def _finder(sent, least):
    def run(batches):
        ids, sizes, vocabulary, automaton = sent.value
        id_type = pa.array(ids).type if ids else pa.int64()
        bits = np.zeros(1 << 16, bool)
        bits[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
        for batch in (part for whole in batches for part in slices(whole, "text")):
            hashes, row, start, end = words_of(batch.column("text"))
            known = bits[(hashes >> np.uint64(48)).astype(np.int64)] if len(vocabulary) else np.zeros(len(hashes), bool)
            at = np.flatnonzero(known)
            number = np.minimum(np.searchsorted(vocabulary, hashes[at]), max(len(vocabulary) - 1, 0))
            real = vocabulary[number] == hashes[at] if len(at) else np.zeros(0, bool)
            at, number = at[real], number[real]
            breaks = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(row[at]) != 0)]) if len(at) else np.zeros(0, np.int64)
            lengths = np.diff(np.r_[breaks, len(at)])
            docs, found, s, e, n, size_of = [], [], [], [], [], []
            for b, size in zip(breaks[lengths >= least].tolist(), lengths[lengths >= least].tolist()):
                for k, i, j in automaton.stretches(number[b : b + size].tolist(), least):
                    docs.append(row[at[b]])
                    found.append(ids[k])
                    s.append(start[at[b + i]])
                    e.append(end[at[b + j - 1]])
                    n.append(j - i)
                    size_of.append(sizes[k])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(found, id_type), *(pa.array(x, pa.int32()) for x in (s, e, n, size_of))], names=["doc_id", "item_id", "span_start", "span_end", "n_words", "item_words"])

    return run


def remove_leaks(documents: DataFrame, items: DataFrame, least_words: int = 10, length_limit: int = 10, cover_limit: float = 0.5, block_words: int = 200_000) -> DataFrame:
    """Rows doc_id, text, n_removed: the documents without the stretches that stand in an item and have at least `length_limit`
    words, or at least the share `cover_limit` of the words of the item (and `least_words` in any case). A document without any
    comes out unchanged with n_removed 0; of repeated doc_ids one row comes out; null texts stay null."""
    spans = find_leaks(documents, items, least_words, block_words)
    spans = spans.where((F.col("n_words") >= length_limit) | (F.col("n_words") >= cover_limit * F.col("item_words")))
    spans = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("span_start", "span_end"))).alias("spans"))
    docs = documents.select("doc_id", "text").dropDuplicates(["doc_id"]).join(spans, "doc_id", "left")
    schema = T.StructType([docs.schema["doc_id"], docs.schema["text"], T.StructField("n_removed", T.IntegerType())])

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            cps, offsets = to_codepoints(batch.column("text"))
            keep = np.ones(len(cps), bool)
            for i, spans_of in enumerate(batch.column("spans").to_pylist()):
                for x in spans_of or ():
                    keep[offsets[i] + x["span_start"] : offsets[i] + x["span_end"]] = False
            left = np.r_[0, np.cumsum(keep)][offsets]
            removed = np.diff(offsets) - np.diff(left)
            nulls = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), from_codepoints(cps[keep], left, nulls), pa.array(removed, pa.int32())], names=["doc_id", "text", "n_removed"])

    return docs.mapInArrow(run, schema)
