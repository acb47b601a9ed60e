"""Column functions over strings: matching keys, literal patterns, generic words, token texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkveil import types as t
from sparkveil.functions.patterns import SPACE, STRIPPED, TOKEN, TOKEN_ARTIFACT, W

_WHITE = rf"(?U)[{SPACE}]+"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def matching_key_sql(x: str) -> str:
    ends, white = rf"(?U)^[{SPACE}]+|[{SPACE}]+$", _WHITE
    chars = STRIPPED.replace("\\", "\\\\").replace('"', '\\"')
    return f"""regexp_replace(regexp_replace(btrim(lower({x}), "{chars}"), r'{white}', ' '), r'{ends}', '')"""


def matching_key(x: str) -> Column:
    """Lower case, without punctuation and spaces at either end, white space collapsed."""
    return F.expr(matching_key_sql(x))


def registry_key(x: Column) -> Column:
    """Lower case with white space collapsed; punctuation stays."""
    return trimmed(F.regexp_replace(F.lower(x), _WHITE, " "))


def literal(x: Column) -> Column:
    r"""The text as a pattern that matches just itself. A \E in it ends the quotation and is quoted on its own."""
    return F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def bounded(x: Column, more: str = "") -> Column:
    """Pattern of the literal text, ignoring case, not inside a longer word. more: two characters that must not stand at its
    left and right either."""
    left, right = (("\\" + c for c in more) if more else ("", ""))
    return F.concat(F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_{left}])"), literal(x), F.lit(rf"(?![\p{{L}}\p{{N}}_{right}])"))


def masked_tokens(x: Column) -> Column:
    return F.regexp_replace(x, TOKEN, " ")


def is_token_artifact(x: Column) -> Column:
    return trimmed(x).rlike(TOKEN_ARTIFACT)


def token_text(prefix: Column, n: Column) -> Column:
    return F.concat(F.lit("["), prefix, F.lit("_"), n.cast("string"), F.lit("]"))


def prefix_of(pii_type: Column) -> Column:
    pairs = [F.lit(v) for kv in t.PREFIXES.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), pii_type), F.lit("PII"))


def _list(words: tuple[str, ...]) -> str:
    return ", ".join(f'"{w}"' for w in words)


def _skipped(prefixes: tuple[str, ...], words: str, name: str) -> str:
    # without the leading words of the list: cut at the first other word
    other = f"array_position(transform({words}, w -> w in ({_list(prefixes)})), false)"
    return f"transform(array({other}), {name} -> if({name} > 0, slice({words}, cast({name} as int), size({words})), slice({words}, 1, 0)))[0]"


def is_generic(column: str) -> Column:
    """Whether a text names nobody and nothing: a title, a pronoun, a common word, also behind prepositions and articles, or a
    phrase with a pronoun or question word. The empty text isn't generic, for null the result is null.

    Written as one SQL expression: made of Column calls it takes longer to build than to run on small tables."""
    bare = _list(sum(t.BARE_GENERIC.values(), ()))
    rest = f"""transform(array({_skipped(t.PLACE_PREFIXES, "b.words", "p")}), v -> transform(array({_skipped(t.ROLE_PREFIXES, "v", "q")}), r ->
        array_join(r, ' ') in ({bare}, {_list(t.TITLES)}) or (size(r) > 0 and forall(r, w -> w in ({_list(t.COMMON_WORDS)}))))[0])[0]"""
    return F.expr(f"""transform(array({matching_key_sql(column)}), k -> transform(array(struct(filter(split(k, ' '), w -> w <> '') as words)), b ->
        k in ({_list(t.TITLES)}, {_list(t.NON_NAME_WORDS)}, {bare}) or exists(b.words, w -> w in ({_list(t.PHRASE_WORDS)})) or {rest})[0])[0]""")


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def longest_word(x: Column) -> Column:
    """The longest word of a text in lower case, the first of equals; null if it has none. Where the text stands in another one
    between word boundaries, so does the word."""
    words = F.regexp_extract_all(folded(x), F.lit(rf"({W}+)"), F.lit(1))
    best = F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))
    return best["w"]


def folded(x: Column) -> Column:
    """One form for texts that patterns take as equal when they ignore case."""
    return F.lower(F.upper(F.translate(x, "\u1e9e\u0130", "\u00dfi")))


def words_of(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(folded(x), F.lit(rf"({W}+)"), F.lit(1)))
