"""Problem 2: text that looks the same comes out in one consistent form.

A batch of texts becomes one array of code points. A lookup table maps full-width, ligature, font and space characters to
their plain form and drops invisible ones, expansion offsets place the results, marks are composed by pair lookup, and
look-alike letters of other scripts become Latin in words that hold a Latin letter or nothing but look-alikes (so genuine
words of other scripts stay as they are). Nothing is done string by string.

Defined results: null stays null, an empty text stays empty, a text of invisible characters becomes empty, runs of spaces are
kept (only the kind of space changes), letters with accents stay different from letters without.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkveil.llm.codepoints import from_codepoints, slices, to_codepoints

SIZE = 0x110000
# Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    # Cyrillic, capital
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I", "Ї": "Ï", "Ё": "Ë",
    # Cyrillic, small (also the small forms of capitals that look alike)
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ү": "y", "ї": "ï", "ё": "ë", "ɡ": "g",
    # Greek, capital
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X",
    # Greek, small
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    # Armenian and Latin letters of unusual shape
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "ı": "i", "ɑ": "a", "η": "n",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲭ": "x",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮟ": "b", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏼ": "B",
}
INVISIBLE_EXTRA = (0x00AD, 0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
KEPT_TAGS = ("<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>")
JOINERS = (0x200C, 0x200D, 0xFE0E, 0xFE0F)


class Tables:
    """Lookup tables, built once a process from the Unicode data that come with Python."""

    def __init__(self) -> None:
        first = np.arange(SIZE, dtype=np.uint32)
        length = np.ones(SIZE, np.uint8)
        lower = np.arange(SIZE, dtype=np.uint32)
        mark = np.zeros(SIZE, bool)
        latin = np.zeros(SIZE, bool)
        letter = np.zeros(SIZE, bool)
        word = np.zeros(SIZE, bool)
        ccc = np.zeros(SIZE, np.uint8)
        extra: dict[int, list[int]] = {}
        pairs: dict[int, int] = {}
        for c in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x1F200), *range(0xE0000, 0xE0200)]:
            ch = chr(c)
            kind = unicodedata.category(ch)
            if kind == "Cn":
                continue
            if kind == "Cf" or c in INVISIBLE_EXTRA or 0xFE00 <= c <= 0xFE0F or 0x180B <= c <= 0x180F:
                length[c] = 0
                continue
            if kind == "Zs":
                first[c] = 0x20
                continue
            form = unicodedata.decomposition(ch)
            if form.startswith("<"):
                tag = form.split()[0]
                plain = unicodedata.normalize("NFKC", ch)
                if tag in KEPT_TAGS and not plain.startswith(" "):
                    first[c], length[c] = ord(plain[0]), len(plain)
                    if len(plain) > 1:
                        extra[c] = [ord(x) for x in plain]
            elif form:
                plain = unicodedata.normalize("NFC", ch)
                first[c], length[c] = ord(plain[0]), len(plain)
                if len(plain) > 1:
                    extra[c] = [ord(x) for x in plain]
                parts = [int(x, 16) for x in form.split()]
                if len(parts) == 2 and plain == ch:
                    pairs[parts[0] << 21 | parts[1]] = c
        for c in range(0x20000):
            ch = chr(c)
            kind = unicodedata.category(ch)
            if kind[0] == "M":
                mark[c], ccc[c] = True, unicodedata.combining(ch)
            if kind[0] == "L":
                letter[c] = True
                latin[c] = c < 0x250 or 0x1E00 <= c < 0x1F00
            word[c] = kind[0] == "L" or kind[0] == "N"
            small = ch.lower()
            if len(small) == 1:
                lower[c] = ord(small)
        word[0x20000:0x32000] = letter[0x20000:0x32000] = True
        alike = np.zeros(SIZE, np.uint32)
        for a, b in LOOKALIKES.items():
            alike[ord(a)] = ord(b)
            latin[ord(a)] = False
        for c in [*range(0x250, 0x2B0), *range(0x1D00, 0x1D2C), *range(0xA730, 0xA732)]:  # small capitals, by their names
            name = unicodedata.name(chr(c), "")
            if name.startswith("LATIN LETTER SMALL CAPITAL ") and len(name) == 28:
                alike[c], latin[c] = ord(name[-1].lower()), False
        first[9] = 0x20
        self.first, self.length, self.lower, self.mark, self.latin, self.letter = first, length, lower, mark, latin, letter
        self.word, self.ccc, self.alike = word, ccc, alike
        # What a character expands to, end to end, and where that of each begins.
        self.many = np.array([x for c in sorted(extra) for x in extra[c]], np.uint32)
        self.many_at = np.zeros(SIZE, np.int64)
        self.many_at[sorted(extra)] = np.r_[0, np.cumsum([len(extra[c]) for c in sorted(extra)])][:-1]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], np.uint32)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def _expand(x: np.ndarray, size: np.ndarray, first: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Each of x as `size` characters: its first, or those of flat from begin on where there are several."""
    y = np.repeat(first, size)
    several = np.repeat(size > 1, size)
    if several.any():
        place = np.arange(len(y)) - np.repeat(np.cumsum(size) - size, size)
        y[several] = flat[(np.repeat(begin, size) + place)[several]]
    return y


def _hangul(cps: np.ndarray, src: np.ndarray, row: np.ndarray):
    """Letters of a Korean syllable become the syllable, by their numbers."""
    for low, high, make in ((0x1161, 0x1176, "vowel"), (0x11A8, 0x11C3, "end")):
        a, b = cps[:-1].astype(np.int64), cps[1:].astype(np.int64)
        follows = (b >= low) & (b < high) & (row[1:] == row[:-1])
        if make == "vowel":
            at = np.flatnonzero(follows & (a >= 0x1100) & (a < 0x1113))
            whole = 0xAC00 + ((a[at] - 0x1100) * 21 + b[at] - 0x1161) * 28
        else:
            at = np.flatnonzero(follows & (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0))
            whole = a[at] + b[at] - 0x11A7
        if len(at):
            cps = cps.copy()
            cps[at] = whole
            keep = np.ones(len(cps), bool)
            keep[at + 1] = False
            cps, src, row = cps[keep], src[keep], row[keep]
    return cps, src, row


def _compose(cps: np.ndarray, src: np.ndarray, row: np.ndarray, t: Tables):
    """Marks join the letter before them where a composed character exists. Before that, a composed character followed by a
    mark is taken apart and the marks of one letter are brought into canonical order, so equivalent sequences end up equal."""
    apart = np.flatnonzero(np.r_[t.mark[cps[1:]] & (row[1:] == row[:-1]), False] & ~t.mark[cps])
    unique, which = np.unique(cps[apart], return_inverse=True)
    forms = [[ord(x) for x in unicodedata.normalize("NFD", chr(c))] for c in unique.tolist()]
    lengths = np.array([len(x) for x in forms], np.int64)
    if (lengths > 1).any():
        size, begin, first = np.ones(len(cps), np.int64), np.zeros(len(cps), np.int64), cps.copy()
        size[apart] = lengths[which]
        begin[apart] = (np.cumsum(lengths) - lengths)[which]
        cps = _expand(cps, size, first, np.array([x for form in forms for x in form], np.uint32), begin)
        src, row = np.repeat(src, size), np.repeat(row, size)
    while True:  # canonical order by swaps of neighbours; each pass leaves fewer pairs in the wrong order
        c = t.ccc[cps]
        swap = np.flatnonzero((c[:-1] > c[1:]) & (c[1:] > 0) & (row[:-1] == row[1:]))
        if not len(swap):
            break
        swap = swap[np.r_[True, np.diff(swap) > 1]]
        cps[swap], cps[swap + 1] = cps[swap + 1].copy(), cps[swap].copy()
    while True:  # each pass leaves fewer characters
        m = t.mark[cps]
        at = np.flatnonzero(m[1:] & ~m[:-1] & (row[1:] == row[:-1])) + 1
        if not len(at):
            break
        keys = cps[at - 1].astype(np.int64) << 21 | cps[at]
        k = np.minimum(np.searchsorted(t.pair_keys, keys), len(t.pair_keys) - 1)
        hit = t.pair_keys[k] == keys
        if not hit.any():
            break
        cps[at[hit] - 1] = t.pair_to[k[hit]]
        keep = np.ones(len(cps), bool)
        keep[at[hit]] = False
        cps, src, row = cps[keep], src[keep], row[keep]
    return cps, src, row


def fold_codepoints(cps: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded code points, row offsets, for each the index of the code point it came from)."""
    t = tables()
    n = len(offsets) - 1
    total = len(cps)
    if total == 0 or cps.max() < 0x80:
        out = t.first[cps]
        return (t.lower[out] if lower else out), offsets.copy(), np.arange(total)
    # Rows of plain ASCII pass as they are; only the others take the long way.
    high = np.zeros(total + 1, np.int64)
    np.cumsum(cps >= 0x80, out=high[1:])
    rows = np.flatnonzero(high[offsets[1:]] > high[offsets[:-1]])
    lengths = offsets[rows + 1] - offsets[rows]
    row = np.repeat(rows, lengths)
    src = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(offsets[rows], lengths)
    x = cps[src]
    size = t.length[x].astype(np.int64)
    joiner = np.isin(x, JOINERS)
    if joiner.any():  # kept inside emoji and scripts that need them
        before = np.r_[0, x[:-1]]
        kept = joiner & (((before >= 0x900) & (before < 0x1E00)) | (before >= 0x2190) & ~((before >= 0xFB00) & (before < 0xFFF0)))
        size[kept] = 1
    y = _expand(x, size, t.first[x], t.many, t.many_at[x])
    src, row = np.repeat(src, size), np.repeat(row, size)
    if ((y >= 0x1100) & (y < 0x1113)).any():
        y, src, row = _hangul(y, src, row)
    if t.mark[y].any():
        y, src, row = _compose(y, src, row, t)
    other = t.alike[y]
    if (other > 0).any():
        letters = t.letter[y] | t.mark[y]
        start = np.r_[True, (letters[1:] != letters[:-1]) | (row[1:] != row[:-1])]
        word = np.cumsum(start) - 1
        has_latin = np.bincount(word, t.latin[y] & letters, minlength=word[-1] + 1) > 0
        has_foreign = np.bincount(word, letters & ~t.latin[y] & (other == 0), minlength=word[-1] + 1) > 0
        change = (other > 0) & (has_latin | ~has_foreign)[word]
        y = np.where(change, other, y)
    # The folded rows go back among the plain ones.
    new_len = (offsets[1:] - offsets[:-1]).copy()
    new_len[rows] = np.bincount(row, minlength=n)[rows]
    out_off = np.zeros(n + 1, np.int64)
    np.cumsum(new_len, out=out_off[1:])
    out, out_src = np.empty(out_off[-1], np.uint32), np.empty(out_off[-1], np.int64)
    folded = np.zeros(n, bool)
    folded[rows] = True
    flag = np.repeat(folded, new_len)
    out[flag], out_src[flag] = y, src
    old = np.repeat(~folded, offsets[1:] - offsets[:-1])
    out[~flag], out_src[~flag] = t.first[cps[old]], np.flatnonzero(old)
    return (t.lower[out] if lower else out), out_off, out_src


def fold_array(column: pa.Array, lower: bool = False) -> pa.Array:
    cps, offsets = to_codepoints(column)
    out, out_off, _ = fold_codepoints(cps, offsets, lower)
    mask = np.asarray(column.is_null().to_numpy(zero_copy_only=False)) if column.null_count else None
    return from_codepoints(out, out_off, mask)


def fold_strings(texts: list[str], lower: bool = False) -> list[str]:
    return fold_array(pa.array(texts, pa.string()), lower).to_pylist()


def normalise_lookalikes(df: DataFrame, columns: list[str], suffix: str = "_normal", lower: bool = False) -> DataFrame:
    """df with one more column NAME + suffix for each of the columns. Clashing names raise ValueError before any work."""
    taken = [c + suffix for c in columns if c + suffix in df.columns]
    if taken:
        raise ValueError(f"column names already taken: {taken}")
    schema = T.StructType([*df.schema.fields, *[T.StructField(c + suffix, T.StringType()) for c in columns]])
    position = [df.columns.index(c) for c in columns]

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, columns[0])):
            new = [fold_array(batch.column(i), lower) for i in position]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[c + suffix for c in columns]])

    return df.mapInArrow(run, schema)


STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(STEP), -1, 2**64))


def contained(part: np.ndarray, part_off: np.ndarray, text: np.ndarray, text_off: np.ndarray) -> np.ndarray:
    """For each row whether its part stands in its text, for all rows at once: sums over all stretches of the length of the part
    are compared with that of the part, and what agrees is compared character by character. An empty part stands nowhere."""
    size, room = np.diff(part_off), np.diff(text_off)
    out = np.zeros(len(size), bool)
    rows = np.flatnonzero((size > 0) & (size <= room))
    if not len(rows):
        return out

    def sums(x: np.ndarray):
        v = (x.astype(np.uint64) + np.uint64(11)) * np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(29)
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(x), STEP, np.uint64)])
        return np.r_[np.uint64(0), np.cumsum(v * power[: len(x)])], np.cumprod(np.r_[np.uint64(1), np.full(len(x), BACK, np.uint64)])

    (ps, pd), (ts, td) = sums(part), sums(text)
    asked = (ps[part_off[rows + 1]] - ps[part_off[rows]]) * pd[part_off[rows]]
    count = room[rows] - size[rows] + 1
    k = np.repeat(np.arange(len(rows)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + text_off[rows][k]
    hit = np.flatnonzero((ts[start + size[rows][k]] - ts[start]) * td[start] == asked[k])
    if len(hit):
        _, one = np.unique(k[hit], return_index=True)  # a second agreement of a row says no more than the first
        at, row = start[hit[one]], rows[k[hit[one]]]
        n = size[row]
        i = np.repeat(np.arange(len(row)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = text[at[i] + place] == part[part_off[row][i] + place]
        out[row] = np.logical_and.reduceat(same, np.cumsum(n) - n)
    return out


def _stripped(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without spaces and line ends at either end."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    solid = np.flatnonzero(~np.isin(x, (9, 10, 11, 12, 13, 32)))
    lo, hi = offsets[:-1].copy(), offsets[:-1].copy()
    if len(solid):
        row, first = np.unique(rows[solid], return_index=True)
        last = np.r_[first[1:], len(solid)] - 1
        lo[row], hi[row] = solid[first], solid[last] + 1
    at = np.arange(len(x))
    return x[(at >= lo[rows]) & (at < hi[rows])], np.r_[0, np.cumsum(hi - lo)]


def find_lookalikes(items: DataFrame, turns: DataFrame) -> DataFrame:
    """Items that are not in their turn's text as stored but look like a stretch of it, ignoring case both times.

    items: transcript_id, item_ord, turn_id, text; turns: transcript_id, turn_id, text. Other columns are left out. Null or
    blank items, items of missing turns and turns without text give no row; repeated rows count once.
    """
    left = items.select("transcript_id", "item_ord", "turn_id", F.col("text").alias("item_text")).where(F.trim("item_text") != "").distinct()
    right = turns.select("transcript_id", "turn_id", F.col("text").alias("turn_text")).where(F.col("turn_text") != "")
    pairs = left.join(right, ["transcript_id", "turn_id"]).where(~F.lower("turn_text").contains(F.lower("item_text")))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "turn_text")):
            (a, a_off, _), (b, b_off, _) = (fold_codepoints(*to_codepoints(batch.column(c)), lower=True) for c in ("item_text", "turn_text"))
            yield batch.select(["transcript_id", "item_ord", "turn_id"]).filter(pa.array(contained(*_stripped(a, a_off), b, b_off)))

    schema = T.StructType([pairs.schema[c] for c in ("transcript_id", "item_ord", "turn_id")])
    return pairs.mapInArrow(run, schema).distinct()
