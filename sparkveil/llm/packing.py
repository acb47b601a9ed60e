"""Problem 6: documents, measured in tokens, into containers of fixed capacity by best-fit decreasing.

Documents are cut into pieces of the capacity only if they alone exceed it; every other document is one piece. Pieces are
spread over shards of bounded size by a hash of the document id, and each shard packs its pieces by decreasing size: a segment
tree over the remaining capacities 0..capacity counts the open containers of each, so the tightest container that still holds
a piece is found in logarithmic time. Shards share no containers; each leaves at most a few containers unfilled.

Defined results: a null or empty text has 0 tokens and is placed like any other (in a container of its shard), repeated rows of
a document count once, ties go to the lower doc_id.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("SPARKVEIL_TOKENIZERS", "/opt/tokenizers")
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
# Fixed value: how this public vocabulary cuts text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The public byte-level BPE vocabulary at path, read once a process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("documents", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Rows doc_id, n_tokens; one row for each doc_id. A text is counted by the words it is cut into, each once a process."""
    path = path or f"{TOKENIZER_DIR}/{TOKENIZER_FILE}"

    def run(batches):
        import regex

        split, encode, known = regex.compile(SPLIT).findall, encoder(path).encode_ordinary, {}
        for batch in batches:
            sizes = []
            for text in batch.column("text").to_pylist():
                n = 0
                for word in split(text) if text else ():
                    size = known.get(word)
                    if size is None:
                        size = len(encode(word))
                        if len(known) < 500_000 and len(word) < 40:
                            known[word] = size
                    n += size
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    docs = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    counted = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")
    return counted.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


class Capacities:
    """Segment tree over 0..capacity: how many open containers have that much space left."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, container: int) -> None:
        self.open[left].append(container)
        i = left + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least space left of at least `need`, or -1."""
        count, i = self.count, need + self.size
        while not count[i]:
            while i & 1:
                i >>= 1
                if i <= 1:
                    return -1
            if i <= 1:
                return -1
            i += 1
        while i < self.size:
            i *= 2
            if not count[i]:
                i += 1
        return i - self.size

    def take(self, left: int) -> int:
        i = left + self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.open[left].pop()


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container of each piece; sizes in decreasing order, none above the capacity."""
    tree, placed, n = Capacities(capacity), [], 0
    for size in sizes:
        left = tree.tightest(size)
        if left < 0:
            container, left, n = n, capacity, n + 1
        else:
            container = tree.take(left)
        tree.add(left - size, container)
        placed.append(container)
    return placed


def pack(documents: DataFrame, capacity: int = 2048, shard_docs: int = 20_000, tokenizer_path: str | None = None) -> DataFrame:
    """Rows doc_id, piece, first_token, n_tokens, container_id ("shard-container"). `shard_docs`: documents a shard aims at."""
    sized = count_tokens(documents, tokenizer_path)
    shards = max(1, -(-documents.count() // shard_docs))
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    id_type = sized.schema["doc_id"].dataType.simpleString()

    def run(key, table):
        ids, tokens = table.column("doc_id"), table.column("n_tokens").to_numpy()
        pieces = np.maximum(1, -(-tokens // capacity))
        row = np.repeat(np.arange(len(tokens)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(tokens[row] - piece * capacity, capacity)
        _, rank = np.unique(ids.to_numpy(), return_inverse=True)
        order = np.lexsort((piece, rank[row], -size))
        placed = np.empty(len(row), np.int64)
        placed[order] = best_fit(size[order].tolist(), capacity)
        name = f"{key[0].as_py()}-"
        return pa.table({"doc_id": ids.take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "first_token": pa.array(piece * capacity, pa.int64()), "n_tokens": pa.array(size, pa.int64()), "container_id": [name + str(c) for c in placed.tolist()]})

    return sized.groupBy("shard").applyInArrow(run, f"doc_id {id_type}, piece int, first_token long, n_tokens long, container_id string")


def packing_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: number of documents, pieces, containers, and the share of the containers that is filled."""
    bins = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"), F.sum(F.when(F.col("piece") == 0, 1).otherwise(0)).alias("docs"))
    return bins.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n_documents"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("n_pieces"), F.count("*").alias("n_containers"), F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("filled"))
