"""Problem 1: oversized items cut at natural boundaries into overlapping pieces.

Giant files are worked on by byte ranges: a worker reads its range with a halo at either side, detects boundaries (ends of
paragraphs, sentences and words) and reports where its section begins, the first boundary of the best kind near the start of
its range, and how many code points there are up to it. The reports, one row a range, are stitched in file order: sections run
from one beginning to the next and prefix sums of their lengths give positions in the whole file. Then each section is read by
its offsets and cut on its own, so no task ever holds more than a section. Texts in a column are worked on in the same way, by
ranges of `range_chars` code points: each range is a row with its halos, so it knows where its own section and the next begin,
and prefix sums over the numbers of pieces number them in the whole text.

A piece ends at the last paragraph end of the second half of what fits, else the last sentence end there, else the last word
end, else where the limit is reached (never before a combining mark). The next piece begins at a sentence, else a word
boundary of the last `overlap` code points before that. Every code point lies in a piece.

Defined results: a text up to the limit is one piece, a null or empty text has none, repeated rows come out as often as they
go in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkveil.llm.codepoints import from_codepoints, slices, to_codepoints
from sparkveil.llm.lookalike import tables

LIMIT, OVERLAP = 1000, 100
WORD, SENTENCE, PARAGRAPH = 1, 2, 3
STOPS = np.array([ord(c) for c in ".!?…"], np.uint32)
WIDE_STOPS = np.array([ord(c) for c in "。！？"], np.uint32)
CLOSERS = np.array([ord(c) for c in "\"')]}”’»"], np.uint32)
SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def boundaries(x: np.ndarray) -> np.ndarray:
    """For each position 0..len(x) of code points: the kind of boundary there (0: none). Spaces belong to what is before."""
    n = len(x)
    kind = np.zeros(n + 1, np.uint8)
    if not n:
        return kind
    space = np.isin(x, SPACES)
    ends = np.flatnonzero(space & np.r_[~space[1:], True]) + 1
    kind[ends] = WORD
    begins = np.flatnonzero(space & np.r_[True, ~space[:-1]])
    breaks = np.r_[0, np.cumsum((x == 10) | (x == 0x2028) | (x == 0x2029))]
    lines = breaks[ends] - breaks[begins]
    last = begins - 1
    for _ in range(3):  # quotes and brackets after a full stop
        closer = (last > 0) & np.isin(x[np.maximum(last, 0)], CLOSERS)
        last = np.where(closer, last - 1, last)
    stop = (last >= 0) & np.isin(x[np.maximum(last, 0)], np.r_[STOPS, WIDE_STOPS])
    kind[ends[stop | (lines == 1)]] = SENTENCE
    kind[ends[(lines > 1) | (x[np.maximum(begins, 0)] == 0x2029)]] = PARAGRAPH
    wide = np.flatnonzero(np.isin(x, WIDE_STOPS)) + 1
    kind[wide] = np.maximum(kind[wide], SENTENCE)
    kind[n] = 0
    return kind


def cut(x: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one text."""
    n, start, out = len(x), 0, []
    if n <= limit:
        return [(0, n)] if n else []
    kind, marks = boundaries(x), tables().mark
    while n - start > limit:
        far = start + limit
        window = kind[start + 1 : far + 1]
        half = limit // 2
        for least, from_ in ((PARAGRAPH, half), (SENTENCE, half), (WORD, overlap)):
            at = np.flatnonzero(window[from_:] >= least)
            if len(at):
                end = start + 1 + from_ + int(at[-1])
                break
        else:
            end = far
            while end > far - 16 and end > start + 1 and marks[x[end]]:
                end -= 1
        out.append((start, end))
        back = kind[max(start + 1, end - overlap) : end]
        at = np.flatnonzero(back >= SENTENCE)
        if not len(at):
            at = np.flatnonzero(back >= WORD)
        start = max(start + 1, end - overlap) + int(at[0]) if len(at) else max(start + 1, end - overlap)
    return [*out, (start, n)]


def _pieces(x, offsets, limit, overlap):
    """Row, number, start, end of the pieces of all texts of a batch."""
    size = np.diff(offsets)
    short = np.flatnonzero((size > 0) & (size <= limit))
    rows = [np.stack([short, np.zeros_like(short), np.zeros_like(short), size[short], np.ones_like(short)], 1)]
    for i in np.flatnonzero(size > limit):
        spans = cut(x[offsets[i] : offsets[i + 1]], limit, overlap)
        rows.append(np.array([(i, k, a, b, len(spans)) for k, (a, b) in enumerate(spans)]))
    table = np.concatenate(rows)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def _gather(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    off = np.r_[0, np.cumsum(size)]
    return from_codepoints(x[np.arange(off[-1]) - np.repeat(off[:-1] - start, size)], off)


RANGE_CHARS = 16_384


def _section_start(x: np.ndarray) -> int:
    """Where a section begins in the first code points of its range: behind the first boundary of the best kind."""
    kind = boundaries(x)[:-1]
    at = next((p for least in (PARAGRAPH, SENTENCE, WORD) if len(p := np.flatnonzero(kind >= least))), None)
    return int(at[0]) if at is not None else 0


def _lead(before: np.ndarray, first: np.ndarray) -> int:
    """How many of the code points before a section its first piece repeats."""
    kind = boundaries(np.r_[before, first])[: len(before)]
    at = next((p for least in (SENTENCE, WORD) if len(p := np.flatnonzero(kind >= least))), None)
    return len(before) - (int(at[0]) if at is not None else 0)


def split_texts(texts: DataFrame, keys: list[str], column: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE_CHARS, halo: int = 2048) -> DataFrame:
    """Rows of the keys with piece, n_pieces, piece_start, piece_end (code points), piece_text.

    Texts longer than `range_chars` are cut by ranges of that many code points; `halo` is where a section looks for its beginning.
    Of repeated rows of a longer text one comes out, as its ranges are told apart by the keys and the text.
    """
    source = texts.select(*keys, F.col(column).alias("whole_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches):
        for part in (p for whole in batches for p in slices(whole, "whole_text")):
            x, offsets = to_codepoints(part.column("whole_text"))
            row, number, a, b, n = _pieces(x, offsets, limit, overlap).T
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(row)) for k in keys), *(pa.array(v, pa.int32()) for v in (number, n, a, b)), _gather(x, offsets[row] + a, offsets[row] + b)], names=[*keys, "piece", "n_pieces", "piece_start", "piece_end", "piece_text"])

    short = source.where(F.length("whole_text") <= range_chars).mapInArrow(run, fields + ", piece int, n_pieces int, piece_start int, piece_end int, piece_text string")
    if halo + overlap >= range_chars:
        raise ValueError("a range must be longer than its halos")

    def sections(batches):
        for part in (p for whole in batches for p in slices(whole, "range_text")):
            x, offsets = to_codepoints(part.column("range_text"))
            out, cps = [], []
            for i, (lo, size) in enumerate(zip(part.column("lo").to_pylist(), part.column("size").to_pylist())):
                y = x[offsets[i] : offsets[i + 1]]  # from `overlap` before the range to `halo` behind it
                at = min(lo, overlap)
                end = at + min(range_chars, size - lo)
                begin = at + (_section_start(y[at : at + halo]) if lo else 0)
                if lo + range_chars < size:
                    end += _section_start(y[end : end + halo])
                if begin >= end:
                    continue
                first = begin - (_lead(y[max(0, begin - overlap) : begin], y[begin : begin + 1]) if begin > at or lo else 0)
                spans = cut(y[first:end], limit, overlap)
                for k, (a, b) in enumerate(spans):
                    out.append((i, k, lo - at + first + a, lo - at + first + b, len(spans)))
                    cps.append(y[first + a : first + b])
            row, number, a, b, n = np.array(out, np.int64).reshape(-1, 5).T
            texts_ = from_codepoints(np.concatenate(cps) if cps else np.zeros(0, np.uint32), np.r_[0, np.cumsum(b - a)].astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(row)) for k in [*keys, "whole_hash", "lo"]), *(pa.array(v, pa.int32()) for v in (number, n, a, b)), texts_], names=[*keys, "whole_hash", "lo", "number", "n", "piece_start", "piece_end", "piece_text"])

    long_ = source.where(F.length("whole_text") > range_chars)
    size = F.length("whole_text")
    ranges = long_.select(*keys, F.xxhash64("whole_text").alias("whole_hash"), size.alias("size"), F.explode(F.sequence(F.lit(0), size - 1, F.lit(range_chars))).alias("lo"), "whole_text")
    ranges = ranges.select(*keys, "whole_hash", "size", "lo", F.substring("whole_text", F.greatest(F.col("lo") - overlap, F.lit(0)) + 1, F.lit(range_chars + overlap + halo) - F.when(F.col("lo") < overlap, overlap - F.col("lo")).otherwise(0)).alias("range_text"))
    found = ranges.mapInArrow(sections, fields + ", whole_hash long, lo int, number int, n int, piece_start int, piece_end int, piece_text string")
    found = found.dropDuplicates([*keys, "whole_hash", "lo", "number"])
    # One row a range is stitched: prefix sums give the number of its first piece.
    counts = found.where("number = 0").select(*keys, "whole_hash", "lo", "n")
    text = Window.partitionBy(*keys, "whole_hash")
    counts = counts.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("whole_hash").alias("_hash"), F.col("lo").alias("_lo"), F.coalesce(F.sum("n").over(text.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("n").over(text).alias("_all"))
    same = (F.col("whole_hash") == F.col("_hash")) & (F.col("lo") == F.col("_lo"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    placed = found.join(counts, same).select(*keys, (F.col("number") + F.col("_before")).cast("int").alias("piece"), F.col("_all").cast("int").alias("n_pieces"), "piece_start", "piece_end", "piece_text")
    return short.unionByName(placed)


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def _read(path: str, lo: int, hi: int) -> np.ndarray:
    """Code points of the bytes lo..hi of a file of UTF-8 text; lo and hi are moved to the next beginning of a character."""
    with _open(path) as f:
        size = f.size()
        f.seek(max(0, lo))
        data = f.read(min(size, hi + 4) - max(0, lo))
    raw = np.frombuffer(data, np.uint8)
    a = b = 0
    while a < len(raw) and a < 4 and (raw[a] & 0xC0) == 0x80:
        a += 1
    b = min(len(raw), hi - max(0, lo))
    while b < len(raw) and (raw[b] & 0xC0) == 0x80:
        b += 1
    return to_codepoints(pa.array([data[a:b].decode("utf-8", "replace")], pa.large_string()))[0]


def _width(x: np.ndarray) -> np.ndarray:
    return 1 + (x > 0x7F).astype(np.int64) + (x > 0x7FF) + (x > 0xFFFF)


def split_files(spark: SparkSession, paths: list[str] | DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 32 << 20, halo: int = 1 << 16) -> DataFrame:
    """Rows path, piece_start, piece_end (code points of the file), piece_text of files of UTF-8 text.

    `range_bytes` is what a task reads; the halo is where a section looks for its beginning. Empty files have no pieces; bytes
    that aren't UTF-8 become U+FFFD.
    """

    def sizes():
        for path in paths:
            with _open(path) as f:
                yield path, f.size()

    files = spark.createDataFrame(list(sizes()), "path string, size long")
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0), F.col("size"), F.lit(range_bytes).cast("long"))).alias("lo")).where("lo < size").repartition("path", "lo")

    def detect(batches):
        for batch in batches:
            out = []
            for path, size, lo in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "lo"))):
                hi = min(size, lo + range_bytes)
                begin = lo
                if lo:
                    x = _read(path, lo, min(hi, lo + halo))
                    kind = boundaries(x)[:-1]
                    at = next((p for least in (PARAGRAPH, SENTENCE, WORD) if len(p := np.flatnonzero(kind >= least))), None)
                    with _open(path) as f:  # bytes of a character that began before the range
                        f.seek(lo)
                        head = f.read(4)
                    skip = next((k for k, c in enumerate(head) if (c & 0xC0) != 0x80), len(head))
                    begin = lo + skip + (int(_width(x[: int(at[0])]).sum()) if at is not None else 0)
                out.append((path, size, lo, begin))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out)], names=["path", "size", "lo", "begin"])

    found = ranges.mapInArrow(detect, "path string, size long, lo long, begin long")
    order = Window.partitionBy("path").orderBy("lo")
    sections = found.withColumn("end", F.coalesce(F.lead("begin").over(order), F.col("size"))).where("begin < end")

    def measure(batches):
        for batch in batches:
            n = [len(_read(p, a, b)) for p, a, b in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "begin", "end")), pa.array(n, pa.int64())], names=["path", "begin", "end", "n"])

    measured = sections.repartition("path", "begin").mapInArrow(measure, "path string, begin long, end long, n long")
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    placed = measured.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))

    def emit(batches):
        for batch in batches:
            for path, begin, end, first in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end", "first"))):
                x = _read(path, begin, end)
                halo_cps = np.zeros(0, np.uint32)
                if begin and overlap:  # the last code points of the section before, for the overlap
                    halo_cps = _read(path, max(0, begin - 4 * overlap - 4), begin)[-overlap:]
                    kind = boundaries(np.r_[halo_cps, x[:1]])[: len(halo_cps)]
                    at = next((p for least in (SENTENCE, WORD) if len(p := np.flatnonzero(kind >= least))), None)
                    halo_cps = halo_cps[int(at[0]) :] if at is not None else halo_cps
                whole = np.r_[halo_cps, x]
                spans = np.array(cut(whole, limit, overlap)).reshape(-1, 2)
                at = spans + (first - len(halo_cps))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(spans), pa.string()), pa.array(at[:, 0], pa.int64()), pa.array(at[:, 1], pa.int64()), _gather(whole, spans[:, 0], spans[:, 1])], names=["path", "piece_start", "piece_end", "piece_text"])

    return placed.repartition("path", "begin").mapInArrow(emit, "path string, piece_start long, piece_end long, piece_text string")
