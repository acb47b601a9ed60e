"""Problem 5: personal information in free text, found and replaced by typed placeholders.

Contexts are learned by bootstrapping, in column expressions over all turns. Everything that might be an identifier (runs of
capitalised words, runs of digits) is a candidate with its surroundings; the identifiers that an existing pipeline has marked
are the seeds. The words beside a candidate, its own first and last word and its shape are patterns, and Spark scores the graph
of patterns and instances in rounds: a pattern is worth the mean belief in its instances, an unmarked instance is believed as
far as its other patterns say. So instances that were discovered give weight to patterns that no seed stands beside, and these
discover further ones. Marked and discovered instances also induce templates, the up to three words at either side together; a
template is scored against all that stands between its words in the corpus, whatever it looks like.

Texts are then searched in one consistent form (look-alikes of problem 2) without time stamps, fillers and sound annotations:
formats tell e-mail addresses, numbers and street addresses, also spelt out or disguised, unless what stands beside a number says
that it is none; templates and believed candidates tell the rest. Positions lead back to the text as stored. Which searches
could find something in a text is asked of whole columns at once, so most texts are spared most searches.

What goes to the workers is bounded: a pattern must hold at least `least_share` of all candidates' rows (and three), so there
are at most 7 / least_share patterns and 1 / least_share templates, whose sides of three words are counted in the corpus.

Contexts are fitted on all spans and turns, and every text is searched whole. Defined results: null and empty
texts have no identifiers and come out as they are, placeholders such as [NAME_1] are none, repeated rows count once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.llm.codepoints import from_codepoints, slices, to_codepoints
from sparkveil.llm.lookalike import fold_codepoints
from sparkveil.storage import cut_lineage
from sparkveil.llm.turns import CLOCK, FILLERS, SOUND, STAMP

TYPES = ("person_name", "email", "phone", "id_number", "address")
PERSONS = ("person_name", "nickname", "family_member", "clinician_name")
# The placeholder of each type.
PLACEHOLDER = {"person_name": "NAME", "email": "EMAIL", "phone": "PHONE", "id_number": "ID", "address": "ADDRESS"}
NOISE = re.compile(rf"(?=[\[(<*{{\duehmayiskl])(?:(?:{SOUND.pattern})|{STAMP}(?:\s*-->)?|\d\d:\d\d:\d\d(?:\.\d+|\s*-->)|^{CLOCK}(?:\s*-->)?|(?<![\w'-]){FILLERS}(?:\.\.\.|…|,|\s-(?!\w)|-(?!\w))|(?<![\w'-])like,(?=\s|$))\s?")
TOKEN = re.compile(r"\[[a-z]+_\d+\]")
STOP = re.compile(r"[.!?;]")
SENTENCE_END = re.compile(r"[.!?;](?=\s|$)|$")
UNITS = "zero|oh|nought|one|two|three|four|five|six|seven|eight|nine"
VALUE = {w: str(max(0, k - 2)) for k, w in enumerate(UNITS.split("|"))}
TEENS = "ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen"
TENS = "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety"
NUMBER_WORD = rf"(?:(?:{TENS})(?:[- ](?:{UNITS}))?|{TEENS}|one|two|three|four|five|six|seven|eight|nine)"
SUFFIX = "street|st|road|rd|avenue|ave|av|lane|ln|crescent|cres|court|ct|terrace|terr|way|row|drive|dr|parade|pde|close|cl|place|pl|boulevard|blvd|square|sq|grove|gardens|gdns|mews|hill|walk|quay|esplanade"
EMAIL = re.compile(r"[a-z0-9](?:[\w.+-]*\w)?(?:@|\(at\)|\[at\]| @ | ?\(at\) | ?\[at\] )[\w-]+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?)[\w-]+)+")
EMAIL_WORDS = re.compile(r"(?<![\w.+-])[\w.+-]+ at [\w-]+(?: dot [\w-]+)+")
ADDRESS = re.compile(rf"(?<![\w$£€.,/])(?:(?:flat|unit|apartment|apt|suite|number|no\.?) )?(?:\d{{1,4}}[a-z]?(?:[-/]\d{{1,4}}[a-z]?)?(?:, \d{{1,4}}[a-z]?(?:-\d{{1,4}})?)?|{NUMBER_WORD}) (?:[^\W\d][\w'’-]+ ){{1,2}}?(?:{SUFFIX})\b\.?(?:, [^\W\d][\w'’-]+(?:-[\w-]+)*)?(?: [a-z]{{1,2}}\d{{1,2}}[a-z]? \d[a-z]{{2}}\b)?")
NUMBER = re.compile(r"(?<![\w$£€.,/:-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?)?\d(?:[\d ./-]{4,}\d)(?![\w:]|[.,]\d)")
STREETS_BEFORE = "rue|avenue|av|boulevard|bd|place|chemin|impasse|quai|calle|avenida|paseo|plaza|via|viale|corso|piazza|rua|largo|ulica|ul"
STREET_FIRST = re.compile(rf"(?<![\w$£€.,/])\d{{1,4}}(?: ?[a-z]|(?: bis| ter))?,? (?:{STREETS_BEFORE})\b\.?(?: (?:d[ei]|la|las|los|le|les|du|des|del|della|dos|da|l'))*(?: ?[^\W\d][\w'’-]+){{1,3}}?(?=[^\w'’-]|$)")
STREETS = ("straße", "strasse", "gasse", "weg", "allee", "straat", "laan", "gatan", "vej")
NUMBER_LAST = re.compile(rf"(?<![\w'’-])[^\W\d][\w'’-]*(?:{'|'.join(STREETS)}) \d{{1,4}}[a-z]?\b")
GROUPED = re.compile(r"^[1-9]\d{0,2}([ .])\d{3}(?:\1\d{3})+$")  # an amount: thousands set apart
DATE = re.compile(r"^(?:\d{1,2}([/.-])\d{1,2}\1\d{2,4}|\d{4}([/.-])\d{1,2}\2\d{1,2})$")
CODE = re.compile(r"(?<![\w/.-])(?:[a-z]{1,3}[-/]?\d[\d/-]{4,}\d|[a-z]{2}(?: \d\d){3} [a-z])(?![\w/-])")
SPOKEN = re.compile(rf"\b(?=[znotfsed])(?:(?:{UNITS}|double|triple)[ ,]+){{6,}}(?:{UNITS})\b")
# What stands in every text in which a search finds something, in the dialect of Arrow, which asks a whole column at once. The
# searches look behind and ahead and know all digits; these let pass more, never less.
_DIGIT = r"[0-9\x{80}-\x{10ffff}]"
_BEFORE, _AFTER = "(?:^|[^a-z0-9_])", "(?:[^a-z]|$)"
NOISY = rf"[(<*{{]|\[[^_\]]*\]|{_DIGIT}:{_DIGIT}|{_BEFORE}(?:{FILLERS}(?:\.\.\.|…|,|(?s:.)?-)|like,)".replace(" ", r"\s")
MAY_HOLD = (
    r"@|at[)\]]| dot ",
    rf"(?:(?:{UNITS}|double|triple)[ ,]+){{6}}(?:{UNITS})",
    rf"(?:{_DIGIT}[a-z]?|{NUMBER_WORD}) (?:[^ ]+ ){{1,2}}(?:{SUFFIX}){_AFTER}",
    rf"{_DIGIT}(?: ?[a-z]| bis| ter)?,? (?:{STREETS_BEFORE}){_AFTER}",
    rf"(?:{'|'.join(STREETS)}) {_DIGIT}",
    rf"{_DIGIT}[0-9\x{{80}}-\x{{10ffff}} ./-]{{4,}}{_DIGIT}",
)
MAIL, DIGIT_WORDS, STREET, STREET_BEFORE, STREET_BEHIND, NUMBERS = (1 << k for k in range(len(MAY_HOLD)))
EVERY = (1 << len(MAY_HOLD)) - 1
NOT_NAMES = frozenset("a an the my your his her our their its this that these those he she it they we you i me him them us who what which somebody someone nobody anybody everyone another and or but not no yes in on at to of for from with after before early late twice".split())

TITLES = frozenset("dr mr mrs ms st prof rev".split())
PEOPLE = frozenset("friend man woman boy girl child person nurse doctor teacher neighbour colleague classmate volunteer stranger trainee lady gentleman guy relative visitor patient couple few lot bit".split())


class Prepared:
    """One text in the form it is searched in, in lower case and as written, and the way back to positions in the text it was
    made from."""

    __slots__ = ("starts", "text", "to", "written")

    def __init__(self, text: str, written: str = "", noisy: bool = True) -> None:
        if "\n" in text or "\t" in text:
            text = text.replace("\n", " ").replace("\t", " ")
        self.starts, self.to = [0], [0]
        self.text, self.written = text, written
        if not noisy:
            return
        parts, as_written, at, done = [], [], 0, 0
        for m in NOISE.finditer(text):
            parts.append(text[at : m.start()])
            as_written.append(written[at : m.start()])
            done += m.start() - at
            at = m.end()
            self.starts.append(done)
            self.to.append(at)
        if parts:
            self.text, self.written = "".join([*parts, text[at:]]), "".join([*as_written, written[at:]])

    def back(self, start: int, end: int) -> tuple[int, int]:
        k, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        return self.to[k] + start - self.starts[k], self.to[last] + end - 1 - self.starts[last] + 1


def left_context(text: str) -> str:
    """The up to three words before a span, from the beginning of its sentence on."""
    words = text.rstrip().rsplit(" ", 3)[-3:]
    for k in range(len(words) - 1, -1, -1):
        if words[k][-1:] in (".", "!", "?", ";", ":"):
            return " ".join(words[k + 1 :])
    return " ".join(words)


def right_context(text: str) -> str:
    """The up to three words after a span, with what joins them to it; "." if its sentence ends."""
    part = STOP.split(" ".join(text.split(" ", 4)[:4]), maxsplit=1)[0].rstrip().rstrip(",")
    return part or "."


def spoken_digits(words: str) -> str:
    out, times = "", 1
    for w in words.replace(",", " ").split():
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
        else:
            out, times = out + VALUE[w] * times, 1
    return out


def is_book(d: str) -> bool:
    """Whether digits are an international book number."""
    return len(d) == 13 and d[:3] in ("978", "979") and not sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(d)) % 10


def formats(t: str, may: int = EVERY):
    """(type, start, end) of identifiers that their form alone tells; may: which of MAY_HOLD stand in the text."""
    out = []
    if may & MAIL:
        if "@" in t or "at)" in t or "at]" in t:
            out += [("email", *m.span()) for m in EMAIL.finditer(t)]
        if " dot " in t:
            out += [("email", *m.span()) for m in EMAIL_WORDS.finditer(t)]
    for m in SPOKEN.finditer(t) if may & DIGIT_WORDS else ():
        n = len(d := spoken_digits(m[0]))
        if n >= 7:
            out.append(("phone" if n in (10, 11, 12) or (d[0] == "0" and n > 9) else "id_number", *m.span()))
    addresses = [m.span() for sign, x in ((STREET, ADDRESS), (STREET_BEFORE, STREET_FIRST), (STREET_BEHIND, NUMBER_LAST)) if may & sign for m in x.finditer(t)]
    out += [("address", *x) for x in addresses]
    if may & NUMBERS:
        numbers = []
        for m in NUMBER.finditer(t):
            x = m[0]
            d = re.sub(r"\D", "", x)
            if len(d) < 7 or DATE.match(x) or GROUPED.match(x) or is_book(d) or any(a < m.end() and m.start() < b for a, b in addresses):
                continue
            groups = [len(g) for g in re.findall(r"\d+", x)]
            phone = x[0] == "+" or "(" in x or (len(d) == 11 and d[0] in "01") or (len(d) == 10 and (groups in ([3, 3, 4], [10]) and d[0] in "23456789" or d[0] == "0"))
            numbers.append(("phone" if phone and 8 <= len(d) <= 15 and groups[-1] > 2 else "id_number", *m.span()))
        for m in CODE.finditer(t):
            if sum(c.isdigit() for c in m[0]) >= 6 and not any(a < m.end() and m.start() < b for _, a, b in numbers) and not any(a < m.end() and m.start() < b for a, b in addresses):
                numbers.append(("id_number", *m.span()))
        out += numbers
    return out


def fits(kind: str, filler: str) -> bool:
    """Whether what stands in a context may be of that type."""
    x = TOKEN.sub(" ", filler)
    if kind == "person_name":
        words = re.findall(r"[^\W\d_][\w'’-]*", x)
        initial = len(words) > 1 and words[0] in ("a", "i") and words[1] not in PEOPLE
        return 0 < len(words) <= 5 and any(len(w) > 1 for w in words) and (initial or words[0] not in NOT_NAMES) and not any(c.isdigit() or c in "@/" for c in x)
    if kind == "email":
        return "@" in x or (" at " in x or "at)" in x or "at]" in x) and ("dot" in x or "." in x)
    if kind in ("phone", "id_number"):
        return sum(c.isdigit() for c in x) >= 6 or len(re.findall(rf"\b(?:{UNITS})\b", x)) >= 6
    return bool(re.match(rf"^\W*(?:(?:flat|unit|number|no\.?) )?(?:\d+|{NUMBER_WORD})\b.*[^\W\d]{{2}}", x))


class Contexts:
    """Learned patterns (left, right, type), found by their longer side with one Aho-Corasick pass over a text."""

    def __init__(self, patterns: list[tuple[str, str, str]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        anchors: dict[str, list] = {}
        for p in patterns:
            left, right, _ = p
            if len(right) > len(left):
                anchors.setdefault(right, []).append((p, False))
            elif left:
                anchors.setdefault(left + " ", []).append((p, True))
        for a, p in anchors.items():
            self.automaton.add_word(a, (len(a), p))
        if anchors:
            self.automaton.make_automaton()
        self.empty = not anchors

    def find(self, t: str):
        """(pattern, start, end) of what stands in the contexts."""
        if self.empty:
            return
        for end, (size, patterns) in self.automaton.iter(t):
            begin = end + 1 - size
            for p, from_left in patterns:
                left, right, kind = p
                if from_left:
                    if begin and t[begin - 1].isalnum():
                        continue
                    a = end + 1
                    b = self._sentence_end(t, a) if right == "." else t.find(right, a)
                else:
                    if end + 1 < len(t) and t[end + 1].isalnum():
                        continue
                    b = begin
                    if left:
                        k = t.rfind(left + " ", 0, b)
                        while k > 0 and t[k - 1].isalnum():
                            k = t.rfind(left + " ", 0, k)
                        if k < 0:
                            continue
                        a = k + len(left) + 1
                    else:
                        a = self._sentence_start(t, b)
                if a < b:
                    yield p, a, b

    @staticmethod
    def _sentence_end(t: str, a: int) -> int:
        for m in SENTENCE_END.finditer(t, a):
            word = t[a : m.start()].rsplit(" ", 1)[-1]
            if m.start() > a and ((len(word) > 1 and word not in TITLES) or m.end() >= len(t)):
                return m.start()
        return len(t)

    @staticmethod
    def _sentence_start(t: str, b: int) -> int:
        at = b
        while at > 0:
            at = max(t.rfind(c, 0, at) for c in ".!?;:-\n")
            if at < 0:
                return 0
            after = at + 1
            while after < b and t[after].isspace():
                after += 1
            if after == at + 1:
                continue
            word = t[max(0, at - 30) : at].rsplit(" ", 1)[-1]
            if t[at] != "." or (len(word) > 1 and word not in TITLES):
                return after
        return 0


# Candidates: runs of capitalised words, with small words of names between them, and runs of digits.
_SMALL = "(?: (?:de|da|di|do|du|dos|del|della|la|le|van|von|der|den|ter|bin|al|el|of))"
_SHORT = r"\p{Lu}\p{Ll}{0,3}\.(?= )"  # initials and titles
_WORD = r"\p{Lu}[\p{L}\p{M}'’-]*+(?![\p{N}_@])"
CAPITALS = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}_@/.'’\[-])(?:{_SHORT}|{_WORD})(?:{_SMALL}{{0,2}} (?:{_SHORT}|{_WORD}))*"
DIGITS = r"(?=[+(\p{Nd}])(?<![\p{L}\p{N}_$£€.,/:-])[+(]?\p{Nd}[\p{Nd} ()./-]{5,}\p{Nd}"


@lru_cache(maxsize=2)
def capitals(plain: bool = False) -> re.Pattern:
    """CAPITALS in the dialect of Python; plain: for ASCII, where fewer letters are to be told apart."""
    upper = [c for c in range(0x41, 0x80 if plain else 0x1F200) if chr(c).isupper()]
    first = f"[{''.join(f'\\U{a:08x}-\\U{b:08x}' for a, b in _runs(upper))}]"
    rest = r"(?:[^\W\d_]{0,3}\.(?= )|(?:[^\W\d_]++|[\u0300-\u036f'’-]++)*+(?![\d_@]))"
    # A letter first, then what stands before it: a search can skip to the next of the letters.
    return re.compile(rf"{first}(?<![\w@/.'’\[-]{first}){rest}(?:{_SMALL}{{0,2}} {first}{rest})*")


def _runs(numbers: list[int]):
    at = [0, *[i for i in range(1, len(numbers)) if numbers[i] != numbers[i - 1] + 1], len(numbers)]
    return [(numbers[a], numbers[b - 1]) for a, b in zip(at, at[1:])]


def hashed(pattern: str) -> int:
    """The number of a pattern, as xxhash64 of a column gives it."""
    import xxhash

    h = xxhash.xxh64_intdigest(pattern.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def pieces_of(start: int, surface: str, at_start: bool):
    """A run at the beginning of a sentence is its first word and the rest: the first is written large in any case."""
    head, space, rest = surface.partition(" ")
    if at_start and space:
        return ((start, start + len(head), head, "i"), (start + len(head) + 1, start + len(surface), rest, "m"))
    return ((start, start + len(surface), surface, "i" if at_start else "m"),)


def begins_sentence(text: str, at: int) -> bool:
    at -= 1
    while at >= 0 and text[at] == " ":
        at -= 1
    return at < 0 or text[at] in ".!?:;\"“—-\n]"


def shape_of(surface: str, place: str) -> str:
    n = surface.count(" ") + 1
    return f"{place}{min(n, 3)}{'A' if len(surface) > 2 and surface.upper() == surface else ''}"


def patterns_of(left: str, right: str, low: str, shape: str) -> list[str]:
    """The patterns of a candidate: words beside it, its own first and last word and the whole of it, its shape."""
    l, r, w = left.split(" "), right.split(" "), low.replace(".", "").split(" ")
    return [f"l {l[-1]}", f"m {' '.join(l[-2:])}", f"r {' '.join(r[:2])}", f"q {' '.join(r[:3])}", f"w {w[0]}", f"v {w[-1]}", f"x {low}", f"s {shape}"]


ENDS = [*".!?;:"]
OPENERS = [*".!?:;\"“—-\n]"]


def _candidates(turns: DataFrame) -> DataFrame:
    """Rows transcript_id, turn_id, a, b, surface, kind (name, number), lefts, rights, place, shape: every candidate."""
    text = turns.select("transcript_id", "turn_id", "text").where("text <> ''")
    # One search: each match is set between two control characters, and the text taken apart at the first of them.
    parts = F.split(F.regexp_replace(F.replace(F.replace("text", F.lit("\x01"), F.lit(" ")), F.lit("\x02"), F.lit(" ")), F.lit(f"{CAPITALS}|{DIGITS}"), F.lit("\x01$0\x02")), "\x01")
    found = text.select("transcript_id", "turn_id", parts.alias("parts")).where("size(parts) > 1")
    found = found.select("*", F.explode(F.expr("sequence(2, size(parts))")).alias("j"))
    # Three parts at either side hold three words or all there are.
    plain = lambda x: F.replace(F.array_join(x, ""), F.lit("\x02"), F.lit(""))
    found = found.select(
        "transcript_id", "turn_id", F.expr("aggregate(slice(parts, 1, j - 1), 2 - j, (n, x) -> n + length(x))").alias("start"), F.substring_index(F.element_at("parts", F.col("j")), "\x02", 1).alias("run"),
        plain(F.slice("parts", F.greatest(F.lit(1), F.col("j") - 3), F.least(F.lit(3), F.col("j") - 1))).alias("before"), plain(F.slice("parts", F.col("j"), F.lit(3))).alias("behind"),
    )
    found = found.withColumn("start", F.when(F.col("start") < 0, 0).otherwise(F.col("start")))
    trimmed = F.rtrim("before")
    opens = (trimmed == "") | F.right(trimmed, F.lit(1)).isin(*OPENERS)
    found = found.select("*", opens.alias("opens"), F.instr("run", " ").alias("space"), F.when(F.substring("run", 1, 1).rlike(r"\p{Lu}"), "name").otherwise("number").alias("kind"))
    piece = lambda first, surface, place: F.struct(first.cast("int").alias("at"), surface.alias("written"), place.alias("place"))
    head, rest = F.substring("run", F.lit(1), F.col("space") - 1), F.substring("run", F.col("space") + 1, F.length("run"))
    both = F.array(piece(F.lit(0), head, F.lit("i")), piece(F.col("space"), rest, F.lit("m")), piece(F.lit(0), F.col("run"), F.lit("w")))  # w: for templates only
    one = F.array(piece(F.lit(0), F.col("run"), F.when(F.col("opens"), "i").otherwise("m")))
    each = found.select("transcript_id", "turn_id", "start", "before", "behind", "run", "kind", F.explode(F.when((F.col("kind") == "name") & F.col("opens") & (F.col("space") > 0), both).otherwise(one)).alias("p"))
    each = each.select("transcript_id", "turn_id", "kind", "p.place", "p.written", (F.col("start") + F.col("p.at")).alias("a"), F.concat("before", F.substring("run", F.lit(1), F.col("p.at"))).alias("before"), F.substring("behind", F.col("p.at") + F.length("p.written") + 1, F.length("behind")).alias("behind"), F.lower("p.written").alias("surface"))
    each = each.where(~F.col("surface").isin(*NOT_NAMES) & (F.length("surface") > 1))
    # A single word at the beginning of a sentence only says something of itself: most are written large for their place.
    bare = (F.col("place") == "i") & (F.col("kind") == "name")
    each = each.withColumn("left", F.when(F.col("place") == "m", F.lower(F.substring_index(F.rtrim("before"), " ", -3))).otherwise("")).withColumn("right", F.when(bare, "").otherwise(F.lower(F.substring_index("behind", " ", 4))))
    left = F.when(F.right("left", F.lit(1)).isin(*ENDS), "").when(F.col("left").rlike("[.!?;:] "), F.regexp_replace("left", r"^.*[.!?;:] ", "")).otherwise(F.col("left"))
    right = F.when(bare, "").otherwise(F.rtrim(F.rtrim(F.regexp_extract("right", r"^[^.!?;]*", 0)), F.lit(",")))
    shape = F.concat("place", F.least(F.length("surface") - F.length(F.replace("surface", F.lit(" "))) + 1, F.lit(3)).cast("string"), F.when((F.length("written") > 2) & (F.upper("written") == F.col("written")), "A").otherwise(""))
    return each.select("transcript_id", "turn_id", "a", (F.col("a") + F.length("surface")).alias("b"), "surface", "kind", left.alias("lefts"), F.when((right == "") & ~bare, ".").otherwise(right).alias("rights"), "place", shape.alias("shape"))


def _patterns() -> Column:
    """The numbers of the patterns of a candidate, as `patterns_of` and `hashed` give them."""
    words = F.replace("surface", F.lit("."), F.lit(""))
    name = lambda tag, x: F.xxhash64(F.concat(F.lit(tag + " "), x))
    beside = [name("l", F.substring_index("lefts", " ", -1)), name("m", F.substring_index("lefts", " ", -2)), name("r", F.substring_index("rights", " ", 2)), name("q", F.substring_index("rights", " ", 3))]
    own = [name("w", F.substring_index(words, " ", 1)), name("v", F.substring_index(words, " ", -1)), name("x", F.col("surface")), name("s", F.col("shape"))]
    return F.when(F.col("place") == "w", F.array().cast("array<bigint>")).when(F.col("kind") != "name", F.array(*beside)).when(F.col("place") == "i", F.array(*own)).otherwise(F.array(*beside, *own))


def _class(column: str):
    return F.when(F.col(column).isin(*PERSONS), "person_name").otherwise(F.col(column))


def _logit(x: Column) -> Column:
    return F.log(x / (1 - x))


NEVER = -6.0  # score of a word that stands often and is never marked: nothing beside it makes a name of it
DAMP = 0.6  # patterns of a candidate repeat each other, so each counts less than in full


class Learned(list):
    """Templates (left, right, type); scores: log odds of a person by pattern, less those of any candidate; numbers: for a
    pattern beside a number the shares of telephone numbers, identity numbers and neither."""

    def __init__(self, templates=(), prior: float = -9.0, scores: dict[int, float] | None = None, numbers: dict[int, tuple] | None = None) -> None:
        super().__init__(templates)
        self.prior, self.scores, self.numbers = prior, scores or {}, numbers or {}
        self.read: dict[str, float] = {}

    def score(self, pattern: str) -> float:
        known = self.read.get(pattern)
        if known is None:
            if len(self.read) > 300_000:
                self.read.clear()
            known = self.read[pattern] = self.scores.get(hashed(pattern), 0.0)
        return known

    def person(self, patterns: list[str]) -> float:
        """Log odds that a candidate with these patterns is a person. The shape, the last of them, which every candidate has,
        counts in full."""
        said = [self.score(p) for p in patterns]
        return self.prior + DAMP * sum(said[:-1]) + said[-1]

    def evidence(self, patterns: list[str]) -> float:
        """What the words after a candidate and its own say."""
        return DAMP * sum(self.score(p) for p in patterns[2:-1])

    def opens_name(self, word: str) -> bool:
        """Whether a word is a title or a given name, even at the beginning of a sentence."""
        return self.score(f"w {word}") > 1 and self.score(f"x {word}") > -2

    def number(self, left: str, right: str) -> tuple | None:
        """Mean shares of what the words beside a number say; None if they are not known."""
        if not self.numbers:
            return None
        said = [x for p in patterns_of(left, right, "", "")[:4] if (x := self.numbers.get(hashed(p)))]
        return tuple(sum(x) / len(said) for x in zip(*said)) if said else None


def learn_contexts(turns: DataFrame, spans: DataFrame, rounds: int = 2, least_support: int = 3, threshold: float = 0.5, least_share: float = 2e-5) -> Learned:
    """Patterns worth using, fitted on all marked spans and all turns."""
    seeds = spans.select("transcript_id", "turn_id", "span_start", "span_end", _class("pii_type").alias("mark")).where("span_start is not null and span_end > span_start and mark is not null")
    marks = seeds.groupBy("transcript_id", "turn_id").agg(F.collect_set(F.struct("span_start", "span_end", "mark")).alias("marks"))
    every = _candidates(turns).join(marks, ["transcript_id", "turn_id"], "left").dropDuplicates(["transcript_id", "turn_id", "a", "place"])
    # A whole run at the beginning of a sentence is marked if it is from its first word on. Rows that say the same count together.
    every = every.withColumn("mark", F.when(F.size("marks") > 0, F.expr("get(filter(marks, m -> m.span_start < if(place = 'w', a + 1, b) and a < m.span_end and (place <> 'w' or m.span_end >= b)), 0).mark")))
    every = every.groupBy("kind", "surface", "lefts", "rights", "place", "shape", "mark").agg(F.count("*").alias("n"))
    every = cut_lineage(every.withColumn("patterns", _patterns()).drop("place", "shape"))
    # An instance counts once for a pattern, however often it stands there: the share of its rows that are marked.
    part = lambda condition: (F.sum(F.when(F.expr(condition), F.col("n")).otherwise(0)) / F.sum("n")).alias
    edges = every.select("kind", F.xxhash64("surface").alias("instance"), "mark", F.explode("patterns").alias("p"), "n")
    # What an instance itself says counts by rows: a word that is never marked, however often it stands, is no name.
    own = F.xxhash64(F.concat(F.lit("x "), F.col("surface")))
    alone = every.where("kind = 'name' and size(patterns) > 0").groupBy("surface").agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("mark") == "person_name", F.col("n")).otherwise(0)).cast("double").alias("person")).select(own.alias("p"), "n", "person")
    edges = edges.groupBy("kind", "instance", "p")
    edges = cut_lineage(edges.agg(part("mark = 'person_name'")("person"), part("mark = 'phone'")("phone"), part("mark = 'id_number'")("id"), part("mark is null")("open")))
    size, marked = edges.agg(F.count("*"), F.sum(1 - F.col("open"))).first()
    if not marked:
        return Learned()
    least = max(least_support, int(size * least_share / 7))
    # Patterns with enough instances: at most 7 / least_share, so their table may go to all workers.
    base = cut_lineage(edges.groupBy("kind", "p").agg(F.count("*").cast("double").alias("n"), *[F.sum(c).alias(c) for c in ("person", "phone", "id", "open")]).where(F.col("n") >= least))
    alone = alone.where(F.col("n") >= least)
    names = base.where("kind = 'name'").select("p", "n", "person").join(alone.select("p"), "p", "left_anti")
    share = edges.where("kind = 'name'").agg((F.sum("person") + 0.5) / (F.count("*") + 1.0)).first()[0] or 0.01
    prior = float(np.log(share / (1 - share)))
    unmarked = edges.where("kind = 'name' and open > 0").select("instance", "p", "open")
    said = lambda total: (_logit((total + F.lit(share)) / (F.col("n") + 1.0)) - prior)
    scores = cut_lineage(names.select("p", said(F.col("person")).alias("score")))
    for _ in range(rounds):
        # What the other patterns of an instance say of it; each leaves out what it says itself.
        held = unmarked.join(F.broadcast(scores), "p")
        others = F.sum("score").over(Window.partitionBy("instance")) - F.col("score")
        seen = F.count("*").over(Window.partitionBy("instance")) - 1
        # An instance has many contexts: their mean, as if it had one of each kind.
        logit = F.lit(prior) + DAMP * others / F.greatest(seen, F.lit(1)) * F.least(seen, F.lit(6))
        belief = held.select("p", "open", (1 / (1 + F.exp(-logit))).alias("belief")).groupBy("p").agg(F.sum(F.col("open") * F.col("belief")).alias("discovered"))
        scores = cut_lineage(names.join(belief, "p", "left").select("p", said(F.col("person") + F.coalesce("discovered", F.lit(0.0))).alias("score")))
    scores = cut_lineage(scores.unionByName(alone.select("p", said(F.col("person")).alias("score"))))
    logit = F.lit(prior) + DAMP * F.sum("score")
    discovered = every.where("kind = 'name' and mark is null").withColumn("row", F.xxhash64("surface", "lefts", "rights")).select("row", "surface", "lefts", "rights", F.explode("patterns").alias("p"))
    discovered = discovered.join(F.broadcast(scores), "p").groupBy("row", "surface", "lefts", "rights").agg(logit.alias("logit")).where(F.col("logit") > 2.2).select("surface", "lefts", "rights", F.lit("person_name").alias("mark"))
    return Learned(_templates(turns, every.where(F.col("mark").isin(*TYPES)).select("surface", "lefts", "rights", "mark").unionByName(discovered), every, least, threshold), prior, {r.p: r.score for r in scores.where("abs(score) > 0.05").collect()}, {r.p: (r.phone / r.n, r.id / r.n, r.open / r.n) for r in base.where("kind = 'number'").collect()})


def _standing(turns: DataFrame, sides: list[str]) -> DataFrame:
    """Rows words, stands: how often each of the three words stand in the corpus, whatever is beside them."""
    if not sides:
        return turns.sparkSession.createDataFrame([], "words string, stands bigint")

    def run(batches):
        import ahocorasick

        automaton, count = ahocorasick.Automaton(), [0] * len(sides)
        for k, words in enumerate(sides):
            automaton.add_word(f" {words} ", k)
        automaton.make_automaton()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, k in automaton.iter(f" {text} "):
                    count[k] += 1
        found = [k for k, n in enumerate(count) if n]
        yield pa.RecordBatch.from_arrays([pa.array([sides[k] for k in found], pa.string()), pa.array([count[k] for k in found], pa.int64())], names=["words", "stands"])

    return turns.where("text <> ''").select(F.lower("text")).mapInArrow(run, "words string, stands bigint").groupBy("words").agg(F.sum("stands").alias("stands"))


def _templates(turns: DataFrame, instances: DataFrame, every: DataFrame, least: int, threshold: float) -> list[tuple[str, str, str]]:
    """Templates of enough different instances that hold, of all that stands at their place, mostly instances of one type."""
    good = instances.where("length(lefts) >= 4 or length(rights) >= 4").groupBy("lefts", "rights", "mark").agg(F.count_distinct("surface").alias("different")).where(F.col("different") >= least)
    good = cut_lineage(good)
    held = every.join(F.broadcast(good.select("lefts", "rights").distinct()), ["lefts", "rights"]).groupBy("lefts", "rights").agg(F.sum("n").alias("all"))
    by_type = instances.join(F.broadcast(good), ["lefts", "rights", "mark"], "left_semi").join(every.where("mark is not null").select("surface", "lefts", "rights", "mark", "n").groupBy("surface", "lefts", "rights", "mark").agg(F.sum("n").alias("n")), ["surface", "lefts", "rights", "mark"], "left").groupBy("lefts", "rights", "mark").agg(F.sum(F.coalesce("n", F.lit(1))).alias("n"))
    side = lambda c, n: F.when(F.size(F.split(F.ltrim(c), " ")) == n, F.ltrim(F.col(c)))
    sides = good.select(F.explode(F.array(side("lefts", 3), side("rights", 3))).alias("words")).where("words is not null").distinct()
    counts = cut_lineage(_standing(turns, sorted(r.words for r in sides.collect())))
    both = by_type.join(held, ["lefts", "rights"]).withColumn("lw", side("lefts", 3)).withColumn("rw", side("rights", 3))
    # Without three words on one side, two on both are enough: then what else stands there is known of candidates only.
    both = both.where((F.coalesce("lw", "rw").isNotNull()) | (side("lefts", 2).isNotNull() & side("rights", 2).isNotNull()))
    both = both.join(F.broadcast(counts.select(F.col("words").alias("lw"), F.col("stands").alias("ln"))), "lw", "left").join(F.broadcast(counts.select(F.col("words").alias("rw"), F.col("stands").alias("rn"))), "rw", "left")
    total = F.greatest(F.least("ln", "rn"), F.col("all"), F.col("n"))
    kept = both.withColumn("score", F.col("n") / total).where(F.col("score") >= threshold).groupBy("lefts", "rights").agg(F.max_by("mark", "score").alias("mark"))
    return [(r.lefts, r.rights, r.mark) for r in kept.orderBy("lefts", "rights").collect()]


def search(p: Prepared, contexts: Contexts, learned: Learned, may: int = EVERY, types_only: bool = False):
    """(type, start, end) of the identifiers in a prepared text; if only types are wanted, one person is enough."""
    t, out = p.text, []
    for kind, a, b in formats(t, may) if may else ():
        if kind in ("phone", "id_number") and (said := learned.number(left_context(t[:a]), right_context(t[b:]))):
            phone, own, none = said
            if none > 0.95:
                continue
            if max(phone, own) > 0.95:
                kind = "phone" if phone > own else "id_number"
        out.append((kind, a, b))
    taken = list(out)
    for (_, _, kind), a, b in contexts.find(t):
        if kind in PLACEHOLDER and t.count(" ", a, b) < 12 and fits(kind, t[a:b]) and not any(x < b and a < y for _, x, y in out):
            out.append((kind, a, b))
    if p.written and learned.scores and not (types_only and any(kind == "person_name" for kind, _, _ in out)):
        for m in capitals(p.written.isascii()).finditer(p.written):
            start, surface = m.start(), m[0]
            if " " not in surface and (len(surface) < 2 or t[start : m.end()] in NOT_NAMES):
                continue
            opens = begins_sentence(p.written, start)
            if opens and " " in surface and learned.opens_name(t[start : start + surface.index(" ")].strip(".")):
                opens = False
            for a, b, piece, place in pieces_of(start, surface, opens):
                low = t[a:b]
                if b - a < 2 or low in NOT_NAMES or learned.score(f"x {low}") < NEVER or any(x < b and a < y for _, x, y in taken):
                    continue
                patterns = patterns_of(left_context(t[:a]), right_context(t[b:]), low, shape_of(piece, place))
                # A single word at the beginning of a sentence, or all in capitals, needs evidence besides its place and shape.
                bare = " " not in piece and (place == "i" or (len(piece) > 2 and piece.upper() == piece))
                if learned.person(patterns) > 0 and (not bare or learned.evidence(patterns) > 1) and fits("person_name", low):
                    out.append(("person_name", a, b))
                    if types_only:
                        return out
    return out


def prepare(texts: list[str], written: list[str]) -> tuple[list[Prepared], list[int]]:
    """Texts in the form they are searched in, and for each which of MAY_HOLD stand in it."""
    noisy = pc.match_substring_regex(pa.array(texts, pa.large_string()), NOISY).to_pylist()
    prepared = [Prepared(t, w, n) for t, w, n in zip(texts, written, noisy)]
    column = pa.array([p.text for p in prepared], pa.large_string())
    may = np.zeros(len(prepared), np.int64)
    for k, sign in enumerate(MAY_HOLD):
        may |= pc.match_substring_regex(column, sign).to_numpy(zero_copy_only=False).astype(np.int64) << k
    return prepared, may.tolist()


def _prepared(column: pa.Array):
    """Texts of a column folded to lower case and as written; for each the position in the stored text of each folded character."""
    cps, offsets = to_codepoints(column)
    folded, off, src = fold_codepoints(cps, offsets)
    written = from_codepoints(folded, off).to_pylist()
    low = [w.lower() for w in written]
    for i, (a, b) in enumerate(zip(low, written)):
        if len(a) != len(b):  # letters whose small form is longer stay as they are, so that positions agree
            low[i] = "".join(x if len(x := c.lower()) == 1 else c for c in b)
    return low, written, off, src, offsets


def _folded(column: pa.Array):
    """Texts of a column as `_prepared` gives them, without positions: plain ASCII needs no folding."""
    column = pc.fill_null(column, "")
    plain = pc.string_is_ascii(column)
    written = pc.replace_substring(column, "\t", " ")
    low, written = pc.ascii_lower(written).to_pylist(), written.to_pylist()
    other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
    for i, a, b in zip(other.tolist(), *_prepared(column.take(pa.array(other)))[:2]) if len(other) else ():
        low[i], written[i] = a, b
    return low, written


def find_types(turns: DataFrame, patterns: Learned) -> DataFrame:
    """Rows transcript_id, turn_id, field_name, pii_type: the types of which a field holds at least one."""
    source = turns.select("transcript_id", "turn_id", "text", "anonymised_text").where("text <> '' or anonymised_text <> ''")
    types = {c: source.schema[c].dataType.simpleString() for c in ("transcript_id", "turn_id")}

    def run(batches):
        contexts = Contexts(patterns)
        for part in (p for whole in batches for p in slices(whole, "text")):
            rows, fields, kinds = [], [], []
            done: list[tuple] = [()] * len(part)
            same = pc.fill_null(pc.equal(part.column("text"), part.column("anonymised_text")), False).to_numpy(zero_copy_only=False)
            for name, left in (("text", np.arange(len(part))), ("anonymised_text", np.flatnonzero(~same))):
                # A field that is as the first one has what that has.
                hits = list(done) if name == "anonymised_text" else done
                for i, p, may in zip(left.tolist(), *prepare(*_folded(part.column(name).take(pa.array(left))))):
                    hits[i] = tuple({k for k, _, _ in search(p, contexts, patterns, may, types_only=True)}) if p.text else ()
                for i, hit in enumerate(hits):
                    for k in hit:
                        rows.append(i)
                        fields.append(name)
                        kinds.append(k)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("transcript_id").take(at), part.column("turn_id").take(at), pa.array(fields, pa.string()), pa.array(kinds, pa.string())], names=["transcript_id", "turn_id", "field_name", "pii_type"])

    return source.mapInArrow(run, f"transcript_id {types['transcript_id']}, turn_id {types['turn_id']}, field_name string, pii_type string").distinct()


def redact_text(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each found identifier replaced by its typed placeholder; of overlapping ones the first and longest."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{PLACEHOLDER[kind]}]"]
            at = b
    return "".join([*out, text[at:]])


def redact(turns: DataFrame, patterns: Learned) -> DataFrame:
    """Rows transcript_id, turn_id, text, anonymised_text, n_found: both fields with typed placeholders; one row for each key."""
    source = turns.select("transcript_id", "turn_id", "text", "anonymised_text").where("transcript_id is not null").dropDuplicates(["transcript_id", "turn_id"])
    types = {c: source.schema[c].dataType.simpleString() for c in ("transcript_id", "turn_id")}

    def run(batches):
        contexts = Contexts(patterns)
        for part in (p for whole in batches for p in slices(whole, "text")):
            count, columns = np.zeros(len(part), np.int32), []
            for name in ("text", "anonymised_text"):
                stored = part.column(name).to_pylist()
                texts, written, low_off, src, offsets = _prepared(part.column(name))
                out = []
                for i, (text, p, may) in enumerate(zip(stored, *prepare(texts, written))):
                    found = []
                    if p.text:
                        for kind, a, b in search(p, contexts, patterns, may):
                            while a < b and p.text[a] in " .,;":
                                a += 1
                            while b > a and p.text[b - 1] in " ,;":
                                b -= 1
                            if a == b or TOKEN.fullmatch(p.text[a:b]):
                                continue
                            x, y = p.back(a, b)
                            found.append((kind, int(src[low_off[i] + x] - offsets[i]), int(src[low_off[i] + y - 1] + 1 - offsets[i])))
                    count[i] += len(found)
                    out.append(redact_text(text, found) if found else text)
                columns.append(pa.array(out, pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("transcript_id"), part.column("turn_id"), *columns, pa.array(count)], names=["transcript_id", "turn_id", "text", "anonymised_text", "n_found"])

    return source.mapInArrow(run, f"transcript_id {types['transcript_id']}, turn_id {types['turn_id']}, text string, anonymised_text string, n_found int")
