"""Column functions over spans: where patterns match, which overlapping spans stay, text with spans replaced.

Positions count code points from 0, ends are exclusive. They come from the lengths of what matched and what stands between, so
the UTF-16 positions of the JVM's matcher never show.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
SPAN = "struct<start:int,end:int,text:string>"


def find_all(text: str, pattern: str, guard: str | None = None) -> str:
    """SQL for array<struct<start, end, text>> of all non-overlapping matches of a pattern that never matches the empty text.

    text and pattern are SQL, guard a condition that holds wherever there is a match; null texts have none. Written as SQL text:
    built of Column calls it takes longer to build than to run on small tables."""
    sum_of = lambda xs, n: f"aggregate(slice({xs}, 1, {n}), 0, (acc, x) -> acc + length(x))"
    one = f"transform(array({sum_of('b.s', 'i + 1')} + {sum_of('b.m', 'i')}), st -> named_struct('start', st, 'end', st + length(m), 'text', m))[0]"
    found = f"transform(array(struct(regexp_extract_all({text}, {pattern}, 0) as m, split({text}, {pattern}, -1) as s)), b -> transform(b.m, (m, i) -> {one}))[0]"
    condition = f"rlike({text}, {pattern})" if guard is None else f"{guard} and rlike({text}, {pattern})"
    return f"coalesce(if({condition}, {found}, null), cast(array() as array<{SPAN}>))"


def without_overlaps(spans: Column, element_type: str) -> Column:
    """Of spans whose fields begin with start, the negative length and a rank: the leftmost and then longest and then lowest
    ranked ones that overlap none kept before."""
    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<{element_type}>"), lambda kept, s: F.when((F.size(kept) == 0) | (s["start"] >= F.element_at(kept, -1)["end"]), F.concat(kept, F.array(s))).otherwise(kept))


def spliced(text: Column, spans: Column) -> Column:
    """The text with each of the disjoint spans (start, end, token) replaced by its token."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["token"]).alias("out"), s["end"].alias("at"))
    return F.aggregate(F.array_sort(spans), first, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
