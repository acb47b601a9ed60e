"""Problem 4: speech transcripts as clean, ordered speaker turns.

Rows are read on their own first: the label (in its own field, broken in two by a time stamp, or at the head of the text), the
time, and what is left of the text without time stamps, fillers and sound annotations. Empty rows go. Then a semi-Markov
conditional model cuts each transcript into segments, each a whole turn of one speaker. A segment scores how well the labels of
its rows fit its speaker, how long it is, and how it follows the segment before: who spoke, the pause before it, the words it
shares with the row before and whether that row ended a sentence. It begins at a row whose label fits somebody, as a row that
names no speaker belongs to the speaker of the row before it. Labels are read through a
noisy channel: known forms of a speaker (code, role, display name), abbreviated or with typing errors, give probabilities of the
transcript's speakers, so a label never seen before still tells something and one that fits two speakers is decided by the rest.
Weights are fitted by conditional likelihood on a bounded sample of transcripts whose labels are certain, after noise has been
put on their labels (`fit`).

Lengths up to `LENGTHS` rows have a score each, beyond that each further row has the same, so the best segmentation is found in
time linear in the rows. Long transcripts are decoded in blocks: a block is first reduced to the best score between any two
states at its ends, these matrices are multiplied (max, plus) in groups of bounded size, level by level, and each block is then
decoded between the states that the best path of the whole transcript has at its ends. Blocks change nothing in the result.

Defined results: null text or text of which nothing is left drops the row, rows of null transcript_id or turn_id are left out,
repeated rows count once by (transcript_id, turn_id), rows before the first label that fits a speaker belong to that speaker;
a transcript without any such label, or without speakers, is one turn with a null speaker_code. A label that fits nobody counts
as none, and stays in the text if it stood there.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.llm.codepoints import slices
from sparkveil.llm.lookalike import fold_array
from sparkveil.llm.names import distance
from sparkveil.storage import cut_lineage

# Words for each role, and the letters and short forms that transcripts usually have for them.
ROLES = {
    "interviewer": ["interviewer", "researcher", "moderator", "int", "intv", "iv", "i", "q"],
    "participant": ["participant", "interviewee", "respondent", "client", "part", "partic", "resp", "p", "a"],
    "clinician": ["clinician", "therapist", "doctor", "clin"],
    "interpreter": ["interpreter", "translator", "interp"],
    "family": ["family member", "family", "relative", "fam"],
}
FILLERS = r"(?:u+m+|u+h+m*|e+r+m*|h+m+|mm+|ah+|you know|i mean|sort of|kind of)"
CLOCK = r"\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,3})?)?"
STAMP = rf"(?:\[{CLOCK}\]|\({CLOCK}\)|<{CLOCK}>|<\d+m\d+s>|\[\d+m\d+s\])"
HEAD = re.compile(rf"^(?:\s*(?:{STAMP}|{CLOCK})(?:\s*-->)?)+\s*")
TAIL = re.compile(rf"\s*(?:{STAMP}|{CLOCK}\.\d+|{CLOCK}\s*-->|{CLOCK})\s*$")
INNER = re.compile(rf"{STAMP}(?:\s*-->)?|\d\d:\d\d:\d\d(?:\.\d+|\s*-->)")
# An annotation is letters in brackets; in round ones, which also hold what is said aside, up to five words.
_SAID = r"[^\W\d_]+(?:[ '-]+[^\W\d_]+)*"
SOUND = re.compile(rf"\(\({_SAID}\)\)|(?<![a-z0-9])(?:\[(?!at\]|dot\])(?=\w{{2}}){_SAID}\]|\((?!at\)|dot\))(?=\w{{2}})[^\W\d_]+(?:[ '-]+[^\W\d_]+){{0,4}}\)|<(?=\w{{2}}){_SAID}>|\*(?=\w{{2}}){_SAID}\*|\{{(?=\w{{2}}){_SAID}\}})(?![a-z0-9])", re.I)
FILLER = re.compile(rf"(?<![\w'-]){FILLERS}(?:\.\.\.|…|[,.]|\s?-(?!\w))?(?![\w'])|(?<![\w'-])like,(?=\s|$)", re.I)
NOISY = re.compile(r"[\[(<*{:]|\b(?:u+m|u+h|e+r+m?|hm+|mm+|ah|you know|i mean|sort of|kind of|like,)", re.I)
ASIDE = re.compile(r"\s*(?:[-–]\s*cont(?:inued|'d)?\.?|\((?:cont\.?|by phone|on screen|continued)\)|\[(?:on screen|cont\.?|by phone)\])\s*$", re.I)
NAMELESS = {"", "-", "--", "unknown", "unk", "?", "n/a", "none", "speaker"}
BROKEN = re.compile(r"^[\[(<]?\d{1,2}$")
LABELLED = re.compile(r"^([^:\n]+?)\s*(?::|\s[-–])(?:\s+|$)")
TIME = re.compile(r"(?:(\d{1,2}):)?(\d{1,2}):(\d{2})(?!\d)|<(\d+)m(\d+)s>")
LENGTHS = 4
BLOCK_ROWS = 1024
FLOOR = 1e-3  # least probability of a speaker, whatever the label


# ---- reading rows


def plain_label(label: str) -> str | None:
    """A label in one form, without time stamps and asides; None if it names nobody."""
    x = label.replace("\u00a0", " ").strip()
    while True:
        y = ASIDE.sub("", TAIL.sub("", HEAD.sub("", x))).strip().rstrip(":").strip()
        if y == x:
            break
        x = y
    x = " ".join(x.lower().split())
    return None if x in NAMELESS or x.isdigit() else x


def clean_text(text: str) -> str:
    """The text without time stamps, sound annotations and fillers; "" if nothing else is left."""
    x = text
    if NOISY.search(x):
        x = TAIL.sub("", HEAD.sub("", x))
        x = FILLER.sub(" ", SOUND.sub(" ", INNER.sub(" ", x)))
        x = re.sub(r"[ \t]{2,}", " ", x)
    x = x.strip()
    return x if any(c.isalnum() for c in x) else ""


def read_row(speaker: str | None, text: str) -> tuple[str | None, str, str]:
    """(label, what a label at the head of the text looks like there, text without it) of one row."""
    speaker = speaker or ""
    broken = bool(BROKEN.match(speaker.strip()))
    if broken:
        text = f"{speaker.strip()}:{text}"
    label = plain_label(speaker) if speaker and not broken else None
    if label is None and (broken or ":" in text or " -" in text or " –" in text):
        rest = HEAD.sub("", text)
        m = LABELLED.match(rest)
        inner = plain_label(m[1]) if m else None
        if inner:
            return inner, rest[: m.end()], rest[m.end() :]
        return None, "", rest if broken else text
    return label, "", text


def seconds_of(*fields: str | None) -> int | None:
    """The first time stamp in the fields."""
    for x in fields:
        if x and (":" in x or "m" in x):
            m = TIME.search(x)
            if m:
                return int(m[4]) * 60 + int(m[5]) if m[4] else int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3])
    return None


def signature(text: str) -> int:
    """The words of a text as 63 bits."""
    bits = 0
    for w in text.lower().split():
        if len(w) > 4:
            bits |= 1 << (crc32(w.encode()) % 63)
    return bits


ROW = "label string, head string, text string, at int, bits long, form byte"


def _rows(batches):
    for part in (p for whole in batches for p in slices(whole, "text", 4_000_000)):
        speaker = fold_array(part.column("speaker")).to_pylist()
        labels, heads, texts, at, bits, form, left = [], [], [], [], [], [], []
        for s, t in zip(speaker, part.column("text").to_pylist()):
            label, head, rest = read_row(s, t or "")
            rest = clean_text(rest)
            bare = not rest and bool(head) and bool(clean_text(head))  # only kept if the head turns out to be no label
            left.append(bool(rest) or bare)
            labels.append(label)
            heads.append(head or None)
            texts.append(rest)
            # A stamp in the label or at the head of the text; times told in the text itself are none.
            at.append(seconds_of(s) if s and not s.strip().isdigit() else None)
            if at[-1] is None and t and not t[:1].isalpha() and (m := HEAD.match(t)):
                at[-1] = seconds_of(m[0])
            bits.append(signature(rest))
            form.append((rest[-1:] in ".!?\"')”") + 2 * rest[:1].islower() + 4 * bare)
        columns = [pa.array(labels, pa.string()), pa.array(heads, pa.string()), pa.array(texts, pa.string()), pa.array(at, pa.int32()), pa.array(bits, pa.int64()), pa.array(form, pa.int8())]
        table = pa.RecordBatch.from_arrays([part.column("transcript_id"), part.column("turn_id"), *columns], names=["transcript_id", "turn_id", "label", "head", "text", "at", "bits", "form"])
        yield table.filter(pa.array(left))


# ---- labels


def words_of_label(x: str) -> tuple[str, ...]:
    return tuple(re.sub(r"(?<=[^\W\d_])(?=\d)", " ", re.sub(r"[._,:]+", " ", x)).split())


@lru_cache(maxsize=100_000)
def forms_of(speakers: tuple) -> tuple[dict, list]:
    """(speakers of each exact form, all forms as (words, speaker)) for speakers ((code, role, number in role, name), ...)."""
    exact: dict[tuple, set] = {}
    for k, (code, role, rank, name) in enumerate(speakers):
        forms = {words_of_label((code or "").lower())}
        digits = re.sub(r"\D", "", code or "")
        if digits:
            forms |= {(w, digits) for w in ("s", "spk", "speaker")}
        for r in ROLES.get(role or "", [role.lower()] if role else []):
            forms |= {words_of_label(r), (*words_of_label(r), str(rank))}
        parts = words_of_label((name or "").lower())
        if parts:
            forms |= {parts, parts[:1]}
            if len(parts) > 1:
                forms |= {(parts[-1], *parts[:-1]), parts[-1:], (parts[0], parts[-1][:1])}
        for f in forms:
            if f:
                exact.setdefault(f, set()).add(k)
    return exact, [(f, k) for f, ks in exact.items() for k in ks]


def word_cost(x: str, form: str) -> float | None:
    """Minus log likelihood of a typed word, given the word meant: none, an abbreviation, typing errors; None if it can't be."""
    if x == form:
        return 0.0
    if x.isdigit() or form.isdigit() or not form or len(x) < 2:
        return None
    if form.startswith(x):
        return 1.5
    most = len(form) // 4
    d = distance(x, form, most) if most else 1
    if d <= most:
        return 2.5 * d
    if len(x) > 2 and x[0] == form[0] and len(x) < len(form):
        at = iter(form)
        if all(c in at for c in x):
            return 2.5
    return None


@lru_cache(maxsize=200_000)
def reading(label: str, speakers: tuple) -> tuple[tuple[float, ...], bool] | None:
    """(probability of each speaker, whether the label is one of the known forms); None if the label fits nobody."""
    exact, forms = forms_of(speakers)
    words = words_of_label(label)
    known = exact.get(words)
    if known:
        p = [1.0 if k in known else 0.0 for k in range(len(speakers))]
    else:
        p = [0.0] * len(speakers)
        for form, k in forms:
            if len(form) == len(words):
                costs = [word_cost(x, f) for x, f in zip(words, form)]
                if None not in costs:
                    p[k] = max(p[k], float(np.exp(-sum(costs))))
    total = sum(p)
    return (tuple(x / total for x in p), bool(known)) if total else None


# ---- the model

FEATURES = ["known", "read", *(f"stay{k}" for k in range(1, LENGTHS + 1)), *(f"end{k}" for k in range(1, LENGTHS + 1)), "begin", "pause", "words", "sentence", "small", "asks", "answers", "others"]
AT = {name: k for k, name in enumerate(FEATURES)}
BEGIN = [AT[x] for x in ("begin", "pause", "words", "sentence", "small")]
TURN_OVER = ("asks", "answers", "others")
LOW = -1e9


def followed(at: list, bits: np.ndarray, form: np.ndarray, before: dict | None = None) -> np.ndarray:
    """(rows, 5) features of a change of speaker at each row: one, pause, shared words, sentence ended before, small letter.
    before: the row before the first."""
    at = [before["at"] if before else None, *at]
    bits, form = (np.r_[before[c] if before else 0, x].astype(np.int64) for c, x in (("bits", bits), ("form", form)))
    gap = [(b - a) if a is not None and b is not None and b >= a else 0 for a, b in zip(at, at[1:])]
    both = np.bitwise_count(bits[1:] & bits[:-1]) / np.maximum(1, np.minimum(np.bitwise_count(bits[1:]), np.bitwise_count(bits[:-1])))
    return np.stack([np.ones(len(gap)), np.log1p(np.array(gap, float)), both, form[:-1] & 1, form[1:] >> 1 & 1], 1).astype(float)


def change_features(roles: np.ndarray) -> np.ndarray:
    """roles: (B, K), true for interviewers. (B, K, K) index of the feature of a change from one speaker to another."""
    a, b = roles[:, :, None], roles[:, None, :]
    return np.where(a & ~b, 0, np.where(~a & b, 1, 2))


class Batch:
    """Sequences padded to one shape. fit: (n, K) log probabilities of labels, by kind (2); begin: (n, 5); seen: (n,) a speaker may begin."""

    def __init__(self, sequences: list[dict]) -> None:
        self.size = np.array([len(s["begin"]) for s in sequences])
        self.count, self.n = len(sequences), int(self.size.max())
        self.k = max(1, max(len(s["roles"]) for s in sequences))
        b, n, k = self.count, self.n, self.k
        self.labels = np.zeros((n, b, k, 2))
        self.begin = np.zeros((n, b, 5))
        self.there = np.zeros((b, k), bool)
        self.seen = np.zeros((n, b), bool)
        roles = np.zeros((b, k), bool)
        for i, s in enumerate(sequences):
            m, q = len(s["begin"]), len(s["roles"])
            self.labels[:m, i, :q] = s["labels"]
            self.begin[:m, i] = s["begin"]
            self.seen[:m, i] = s["seen"]
            self.there[i, :q] = True
            roles[i, :q] = s["roles"]
        self.change = change_features(roles)

    def scores(self, w: np.ndarray):
        emit = self.labels @ w[:2] + np.where(self.there, 0.0, LOW)
        change = w[[AT[x] for x in TURN_OVER]][self.change] + np.where(np.eye(self.k, dtype=bool), LOW, 0.0)
        return emit, self.begin @ w[BEGIN] + np.where(self.seen, 0.0, LOW), w[2 : 2 + LENGTHS], w[2 + LENGTHS : 2 + 2 * LENGTHS], change


def best_states(batch: Batch, w: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None, ends_only: bool = False):
    """(best score at each last state, path): states are 0 before any label, then 1 + speaker * LENGTHS + length - 1.

    start: (B, S) scores of the states before the first row, the state 0 if not given. end: (B,) the state to end in; the best
    if not given, negative too. path: (n, B) states. ends_only: instead of the path, (B, S) the state of the row with the first
    label on the best path from state 0 to each last state.
    """
    emit, begin, stay, close, change = batch.scores(w)
    n, b, k, size = batch.n, batch.count, batch.k, LENGTHS
    states = 1 + k * size
    score = np.full((b, states), LOW)
    score[:, 0] = 0.0
    if start is not None:
        score = start.copy()
    back = np.zeros((0 if ends_only else n, b, states), np.int32)
    known = np.zeros((b, states), np.int32)
    rows = np.arange(b)
    ids = 1 + np.arange(k)[:, None] * size + np.arange(size)
    for i in range(n):
        s = score[:, 1:].reshape(b, k, size)
        new = np.full((b, k, size), LOW)
        origin = np.zeros((b, k, size), np.int32)
        grown = s + stay
        new[:, :, 1:] = grown[:, :, :-1]
        origin[:, :, 1:] = ids[None, :, :-1]
        last = grown[:, :, -1] > new[:, :, -1]
        new[:, :, -1] = np.where(last, grown[:, :, -1], new[:, :, -1])
        origin[:, :, -1] = np.where(last, ids[None, :, -1], origin[:, :, -1])
        ended = s + close
        best_l = ended.argmax(2)
        top = np.take_along_axis(ended, best_l[:, :, None], 2)[:, :, 0]
        moved = top[:, :, None] + change
        source = moved.argmax(1)
        move = np.take_along_axis(moved, source[:, None, :], 1)[:, 0] + begin[i][:, None]
        first = score[:, :1] + np.where(batch.seen[i], 0.0, LOW)[:, None]  # the first label begins the first segment
        lead = first >= move
        new[:, :, 0] = np.where(lead, first, move)
        origin[:, :, 0] = np.where(lead, 0, 1 + source * size + np.take_along_axis(best_l, source, 1))
        new += emit[i][:, :, None]
        out = np.empty((b, states))
        out[:, 0] = np.where(batch.seen[i], LOW, score[:, 0])
        out[:, 1:] = np.maximum(new.reshape(b, -1), LOW)
        over = i >= batch.size
        source_of = np.where(over[:, None], np.arange(1, states), origin.reshape(b, -1))
        if ends_only:
            known[:, 1:] = np.where(source_of == 0, np.arange(1, states), np.take_along_axis(known, source_of, 1))
        else:
            back[i, :, 1:] = source_of
        score = np.where(over[:, None], score, out)
    if ends_only:
        return score, known
    at = score.argmax(1) if end is None else np.where(end < 0, score.argmax(1), end)
    path = np.empty((n, b), np.int32)
    for i in range(n - 1, -1, -1):
        path[i] = at
        at = back[i, rows, at]
    return score, path


def _logsum(x: np.ndarray, axis) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def expected(batch: Batch, w: np.ndarray) -> tuple[float, np.ndarray]:
    """(sum of log partition functions, expected feature counts). The first row begins a segment."""
    emit, begin, stay, close, change = batch.scores(w)
    n, b, k, size = batch.n, batch.count, batch.k, LENGTHS
    alpha = np.full((n, b, k, size), LOW)
    alpha[0, :, :, 0] = emit[0]
    live = [i < batch.size for i in range(n)]
    for i in range(1, n):
        s = alpha[i - 1]
        grown = s + stay
        alpha[i, :, :, 1:] = grown[:, :, :-1]
        alpha[i, :, :, -1] = np.logaddexp(alpha[i, :, :, -1], grown[:, :, -1])
        alpha[i, :, :, 0] = _logsum(_logsum(s + close, 2)[:, :, None] + change, 1) + begin[i][:, None]
        alpha[i] += emit[i][:, :, None]
        alpha[i] = np.where(live[i][:, None, None], alpha[i], s)
    z = _logsum(alpha[-1].reshape(b, -1), 1)
    counts = np.zeros(len(FEATURES))
    beta = np.zeros((b, k, size))
    for i in range(n - 1, -1, -1):
        on = live[i]
        here = np.exp(np.minimum(alpha[i] + beta - z[:, None, None], 0)) * on[:, None, None]
        counts[:2] += (here.sum(2)[:, :, None] * batch.labels[i]).sum((0, 1))
        if not i:
            break
        s, after = alpha[i - 1], beta + emit[i][:, :, None]
        nxt = np.concatenate([after[:, :, 1:], after[:, :, -1:]], 2)
        p_stay = np.exp(np.minimum(s + stay + nxt - z[:, None, None], 0)) * on[:, None, None]
        counts[2 : 2 + size] += p_stay.sum((0, 1))
        arrive = after[:, :, 0] + begin[i][:, None]
        change_out = _logsum(change + arrive[:, None, :], 2)
        p_end = np.exp(np.minimum(s + close + change_out[:, :, None] - z[:, None, None], 0)) * on[:, None, None]
        counts[2 + size : 2 + 2 * size] += p_end.sum((0, 1))
        p_pair = np.exp(np.minimum(_logsum(s + close, 2)[:, :, None] + change + arrive[:, None, :] - z[:, None, None], 0)) * on[:, None, None]
        counts[BEGIN] += p_pair.sum((1, 2)) @ batch.begin[i]
        for f, name in enumerate(TURN_OVER):
            counts[AT[name]] += p_pair[batch.change == f].sum()
        beta = np.where(on[:, None, None], np.logaddexp(stay + nxt, close + change_out[:, :, None]), beta)
    return float(z.sum()), counts


def observed(batch: Batch, gold: list[list[int]]) -> np.ndarray:
    """Feature counts of known segmentations."""
    counts = np.zeros(len(FEATURES))
    for b, path in enumerate(gold):
        length = 0
        for i, y in enumerate(path):
            counts[:2] += batch.labels[i, b, y]
            if i and y == path[i - 1]:
                counts[1 + min(length, LENGTHS)] += 1
            elif i:
                counts[1 + LENGTHS + min(length, LENGTHS)] += 1
                counts[BEGIN] += batch.begin[i, b]
                counts[AT[TURN_OVER[batch.change[b, path[i - 1], y]]]] += 1
                length = 0
            length += 1
    return counts


def sequence(speakers: tuple, labels: list, at: list, bits, form, before: dict | None = None) -> dict:
    """One transcript, or a block of one, as the model sees it."""
    readings = [reading(x, speakers) if x and speakers else None for x in labels]
    fit = np.zeros((len(labels), max(1, len(speakers)), 2))
    seen = np.array([r is not None for r in readings], bool)
    for i, r in enumerate(readings):
        if r:
            fit[i, :, 0 if r[1] else 1] = np.log(np.maximum(r[0], FLOOR))
    return {"labels": fit, "seen": seen, "begin": followed(at, np.asarray(bits, np.int64), np.asarray(form, np.int64), before), "roles": [s[1] == "interviewer" for s in speakers] or [False]}


def noisy(label: str, rng: random.Random) -> str:
    """A label as someone might have typed it: cut short, or with one or two typing errors."""
    if len(label) < 4 or any(c.isdigit() for c in label):
        return label
    if rng.random() < 0.3:
        return label[: rng.randint(2, len(label) - 1)]
    for _ in range(rng.choice((1, 1, 2))):
        k = rng.randrange(1, len(label))
        c = rng.choice("abcdefghijklmnopqrstuvwxyz")
        label = label[:k] + rng.choice([label[k + 1 :], c + label[k:], c + label[k + 1 :], label[k + 1 : k + 2] + label[k : k + 1] + label[k + 2 :]])
    return label


def fit(transcripts: list[tuple[tuple, list[dict]]], noise: float = 0.3, drop: float = 0.15, rounds: int = 60, seed: int = 4) -> np.ndarray:
    """Weights of highest conditional likelihood (with a normal prior) on transcripts (speakers, rows with label, at, bits, form).

    Rows whose label is a known form of one speaker tell the truth, unlabelled ones go on with the speaker before; a transcript
    is used up to its first other label. Then labels are made noisy with the given probability, and some that repeat the
    speaker are dropped.
    """
    rng = random.Random(seed)
    sequences, gold = [], []
    for speakers, rows in transcripts:
        path, used = [], []
        for r in rows:
            found = reading(r["label"], speakers) if r["label"] else None
            if r["label"] and (found is None or not found[1] or max(found[0]) < 1):
                break
            if found is None and not path:
                continue
            path.append(int(np.argmax(found[0])) if found else path[-1])
            label = r["label"]
            if label and len(path) > 1 and path[-1] == path[-2] and rng.random() < drop:
                label = None
            if label and rng.random() < noise:
                other = noisy(label, rng)
                says = reading(other, speakers)
                if not (says and says[1]):  # a form of somebody else is no typing error
                    label = other
            used.append({**r, "label": label})
        if len(path) > 1:
            sequences.append(sequence(speakers, [r["label"] for r in used], [r["at"] for r in used], [r["bits"] for r in used], [r["form"] for r in used]))
            gold.append(path)
    w = np.array([START.get(x, 0.0) for x in FEATURES])
    if not sequences:
        return w
    batch = Batch(sequences)
    truth = observed(batch, gold)
    total = batch.size.sum()
    m, v, w0 = np.zeros(len(w)), np.zeros(len(w)), w.copy()
    for t in range(1, rounds + 1):
        grad = (truth - expected(batch, w)[1]) / total - 1e-4 * (w - w0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w + 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w


#: Where fitting starts, and the mean of the prior: a label is believed.
START = {"known": 3.0, "read": 1.0}


# ---- transcripts


def speaker_table(speakers: DataFrame) -> DataFrame:
    """Rows transcript_id, who: JSON of the speakers [[code, role, number in role, name], ...] in order of their codes."""
    one = speakers.where("transcript_id is not null and speaker_code is not null").groupBy("transcript_id", "speaker_code").agg(F.max("speaker_role").alias("speaker_role"), F.max("display_name").alias("display_name"))
    listed = one.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("speaker_code", "speaker_role", "display_name"))).alias("who"))
    return listed.select("transcript_id", F.to_json("who", {"ignoreNullFields": "false"}).alias("who"))


@lru_cache(maxsize=100_000)
def speakers_of(who: str | None) -> tuple:
    out, met = [], {}
    for x in json.loads(who) if who else ():
        met[x["speaker_role"]] = met.get(x["speaker_role"], 0) + 1
        out.append((x["speaker_code"], x["speaker_role"], met[x["speaker_role"]], x["display_name"]))
    return tuple(out)


def _grouped(batches):
    """Whole blocks of rows that are sorted by transcript and block, many at a time: (table, starts of its blocks)."""
    held: pa.Table | None = None

    def starts(t: pa.Table) -> np.ndarray:
        tid = t.column("transcript_id").combine_chunks().dictionary_encode()
        tid = np.asarray((tid.combine_chunks() if isinstance(tid, pa.ChunkedArray) else tid).indices)
        blk = t.column("block").to_numpy()
        return np.flatnonzero(np.r_[True, (tid[1:] != tid[:-1]) | (blk[1:] != blk[:-1])])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        if not len(table):
            continue
        at = starts(table)
        if len(at) > 1 and (at[-1] >= 4096 or len(batch) < 4096):
            yield table.slice(0, int(at[-1])), at[:-1]
            held = table.slice(int(at[-1]))
        else:
            held = table
    if held is not None and len(held):
        yield held, starts(held)


def _blocks(table: pa.Table, starts: np.ndarray):
    """For each block: its first row (what is known of it) as a dict, the places of its distinct rows, and its sequence."""
    ends = np.r_[starts[1:], len(table)]
    turn = table.column("turn_id").to_pylist()
    label, at = table.column("label").to_pylist(), table.column("at").to_pylist()
    bits, form = table.column("bits").to_pylist(), table.column("form").to_pylist()
    facts = table.select([c for c in table.column_names if c not in ("text", "head", "label")]).take(pa.array(starts)).to_pylist()
    for fact, a, b in zip(facts, starts.tolist(), ends.tolist()):
        who = speakers_of(fact["who"])
        rows = [i for i in range(a + 1, b) if (i == a + 1 or turn[i] != turn[i - 1]) and not (form[i] & 4 and who and reading(label[i], who))]
        if rows:
            yield fact, rows, who, sequence(who, [label[i] for i in rows], [at[i] for i in rows], np.array([bits[i] for i in rows], np.int64), np.array([form[i] for i in rows], np.int64), fact["last"])


def _alike(blocks: list, copies: bool = False):
    """Blocks of like length together, so that little is padded; copies: of equally many speakers, as each is taken from every
    state."""
    order = sorted(range(len(blocks)), key=lambda i: (len(blocks[i][2]) if copies else 0, len(blocks[i][1])))
    part: list[int] = []
    for i in order:
        n, k = len(blocks[i][1]), 1 + max(1, len(blocks[i][2])) * LENGTHS
        size = (len(part) + 1) * n * k * (k if copies else 1)
        if part and (size > 8_000_000 or len(blocks[part[0]][1]) * 2 + 8 < n or (copies and len(blocks[part[0]][2]) != len(blocks[i][2]))):
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def _reduce(w: np.ndarray):
    """Blocks as matrices: the best score from each state before a block to each at its end."""

    def run(batches):
        for table, starts in _grouped(batches):
            blocks, out = list(_blocks(table, starts)), []
            for part in _alike(blocks, copies=True):
                states = 1 + max(1, len(blocks[part[0]][2])) * LENGTHS
                start = np.tile(np.where(np.eye(states, dtype=bool), 0.0, LOW), (len(part), 1))
                score, known = best_states(Batch([blocks[i][3] for i in part for _ in range(states)]), w, start, ends_only=True)
                for j, i in enumerate(part):
                    fact, at = blocks[i][0], slice(j * states, (j + 1) * states)
                    out.append((fact["transcript_id"], fact["block"], score[at].ravel().tolist(), known[at.start].tolist()))
            yield _matrices(out, table.schema.field("transcript_id").type)

    return run


def _matrices(rows: list, id_type) -> pa.RecordBatch:
    tid, block, m, first = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(tid, id_type), pa.array(block, pa.int64()), pa.array(m, pa.list_(pa.float64())), pa.array(first, pa.list_(pa.int32()))], names=["transcript_id", "block", "matrix", "first"])


def _product(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(matrix, first speakers) of consecutive blocks, and for each block the best state before it by the state at its end."""
    total, first, back = rows[0][0], rows[0][1], []
    for matrix, own in rows[1:]:
        both = total[:, :, None] + matrix[None]
        best = both.argmax(1)
        total = np.take_along_axis(both, best[:, None, :], 1)[:, 0]
        first = np.where(best[0] == 0, own, first[best[0]])
        back.append(best)
    return total, first, back


def boundary_states(matrices: DataFrame, id_type: str, group: int = 512) -> DataFrame:
    """Rows transcript_id, block, before, after, first: the states at the ends of each block on the best path of its transcript,
    and the state of the row with the transcript's first label (0 if it has none). Groups of up to `group` blocks are taken at
    once, and their products level by level."""
    schema = f"transcript_id {id_type}, block long, before int, after int, first int"

    def listed(table):
        t = table.sort_by("block")
        states = [np.array(x) for x in t.column("first").to_pylist()]
        return t, [(np.array(m).reshape(len(f), -1), f) for m, f in zip(t.column("matrix").to_pylist(), states)]

    def path(t, rows, start, end, known):
        total, first, back = _product(rows)
        if end is None:
            end = int(total[start].argmax())
        if known is None:
            known = int(first[end]) if start == 0 else 0
        after = [end]
        for best in reversed(back):
            after.append(int(best[start, after[-1]]))
        after = after[::-1]
        return pa.table({"transcript_id": t.column("transcript_id"), "block": t.column("block"), "before": pa.array([start, *after[:-1]], pa.int32()), "after": pa.array(after, pa.int32()), "first": pa.array([known] * len(after), pa.int32())})

    def whole(_, table):
        t, rows = listed(table)
        return path(t, rows, 0, None, None)

    if (matrices.agg(F.max("block")).first()[0] or 0) < group:
        return matrices.groupBy("transcript_id").applyInArrow(whole, schema)

    def shorter(_, table):
        t, rows = listed(table)
        total, first, _ = _product(rows)
        return pa.Table.from_batches([_matrices([(t.column("transcript_id")[0].as_py(), t.column("block")[0].as_py() // group, total.ravel().tolist(), first.tolist())], t.schema.field("transcript_id").type)])

    upper = F.floor(F.col("block") / group)
    parents = cut_lineage(matrices.groupBy("transcript_id", upper.alias("upper")).applyInArrow(shorter, f"transcript_id {id_type}, block long, matrix array<double>, first array<int>"))
    above = boundary_states(parents, id_type, group).select("transcript_id", F.col("block").alias("upper"), "before", "after", "first")

    def within(_, table):
        t, rows = listed(table.select(["transcript_id", "block", "matrix", "own"]).rename_columns(["transcript_id", "block", "matrix", "first"]))
        return path(t, rows, table.column("before")[0].as_py(), table.column("after")[0].as_py(), table.column("first")[0].as_py())

    inner = matrices.withColumnRenamed("first", "own").withColumn("upper", upper).join(above, ["transcript_id", "upper"])
    return inner.groupBy("transcript_id", "upper").applyInArrow(within, schema)


def _decode(w: np.ndarray, names: list[str]):
    """Blocks as clean turns: those that may go on in the block before or after are marked as open."""

    def run(batches):
        for table, starts in _grouped(batches):
            blocks = list(_blocks(table, starts))
            text, head, turn = (table.column(c).to_pylist() for c in ("text", "head", "turn_id"))
            out = []
            for part in _alike(blocks):
                batch = Batch([blocks[i][3] for i in part])
                states = 1 + batch.k * LENGTHS
                start = np.full((len(part), states), LOW)
                end = np.full(len(part), -1)
                for j, i in enumerate(part):
                    fact = blocks[i][0]
                    start[j, fact["before"] or 0] = 0.0
                    end[j] = fact["after"] if fact["after"] is not None else -1
                path = best_states(batch, w, start, end)[1]
                for j, i in enumerate(part):
                    fact, rows, who, seq = blocks[i]
                    states_of = path[: len(rows), j]
                    known = states_of[states_of > 0]
                    lead = fact["first"] or (int(known[0]) if len(known) and not fact["before"] else 0)
                    speaker = np.where(states_of > 0, states_of - 1, lead - 1) // LENGTHS
                    begins = np.flatnonzero(np.r_[True, speaker[1:] != speaker[:-1]])
                    before = (fact["before"] or lead) - 1
                    goes_on = bool(fact["block"]) and before // LENGTHS == speaker[0]
                    several = fact["after"] is not None
                    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(rows)]):
                        at = rows[a:b]
                        said = [clean_text(head[q] + text[q]) if head[q] and not seq["seen"][p] else text[q] for p, q in zip(range(a, b), at)]
                        code = who[speaker[a]][0] if who and speaker[a] >= 0 else None
                        out.append((fact["transcript_id"], turn[at[0]], turn[at[-1]], b - a, code, " ".join(said), fact["block"], several and (a == 0 or b == len(rows)), goes_on and a == 0))
            columns = list(zip(*out)) if out else [()] * 9
            kinds = [table.schema.field("transcript_id").type, *[table.schema.field("turn_id").type] * 2, pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def sampled(read: DataFrame, who: DataFrame, transcripts: int, rows: int) -> list[tuple[tuple, list[dict]]]:
    """The rows numbered below `rows` of that many transcripts, chosen by hash."""
    ids = [r[0] for r in who.select("transcript_id").orderBy(F.xxhash64("transcript_id"), "transcript_id").limit(transcripts).collect()]
    if not ids:
        return []
    names = {r.transcript_id: speakers_of(r.who) for r in who.where(F.col("transcript_id").isin(ids)).collect()}
    found: dict = {}
    for r in read.where(F.col("transcript_id").isin(ids) & (F.col("turn_id") < rows)).select("transcript_id", "turn_id", "label", "at", "bits", "form").distinct().collect():
        found.setdefault(r.transcript_id, {})[r.turn_id] = r.asDict()
    return [(names[t], [found[t][k] for k in sorted(found[t])]) for t in sorted(found)]


def clean_turns(turns: DataFrame, speakers: DataFrame, block_rows: int = BLOCK_ROWS, sample_transcripts: int = 256, sample_rows: int = 48, weights: np.ndarray | None = None, group: int = 512) -> DataFrame:
    """Rows transcript_id, first_turn_id, last_turn_id, n_rows, speaker_code, text: the clean turns, in turn_id order of rows.

    The model is fitted on the rows below `sample_rows` of `sample_transcripts` transcripts, unless weights are given.
    """
    source = turns.select("transcript_id", "turn_id", "speaker", "text").where("transcript_id is not null and turn_id is not null and text <> ''")
    types = {c: source.schema[c].dataType.simpleString() for c in ("transcript_id", "turn_id")}
    keys = f"transcript_id {types['transcript_id']}, turn_id {types['turn_id']}"
    read = cut_lineage(source.mapInArrow(_rows, f"{keys}, {ROW}"))
    who = speaker_table(speakers)
    w = fit(sampled(read, who, sample_transcripts, sample_rows)) if weights is None else weights
    read = read.withColumn("block", F.floor(F.col("turn_id") / block_rows))
    last = F.max_by(F.struct("at", "bits", "form"), F.when(F.col("form") < 4, F.col("turn_id")))
    facts = read.groupBy("transcript_id", "block").agg(last.alias("last"))
    facts = facts.withColumn("last", F.lag("last").over(Window.partitionBy("transcript_id").orderBy("block")))
    facts = cut_lineage(facts.join(who, "transcript_id", "left"))
    open_ends = [F.lit(None).cast("int").alias(c) for c in ("before", "after", "first")]
    long_ = facts.join(facts.where("block > 0").select("transcript_id").distinct(), "transcript_id", "left_semi")
    alone = long_.isEmpty()
    if alone:
        facts = facts.select("*", *open_ends)
    else:
        id_type = types["transcript_id"]
        rows = read.join(facts.where("block > 0").select("transcript_id").distinct(), "transcript_id", "left_semi")
        matrices = _ordered(rows, long_.select("*", *open_ends)).mapInArrow(_reduce(w), f"transcript_id {id_type}, block long, matrix array<double>, first array<int>")
        facts = facts.join(boundary_states(cut_lineage(matrices), id_type, group), ["transcript_id", "block"], "left")
    names = ["transcript_id", "first_turn_id", "last_turn_id", "n_rows", "speaker_code", "text", "block", "open", "goes_on"]
    out = _ordered(read, facts).mapInArrow(_decode(w, names), f"transcript_id {types['transcript_id']}, first_turn_id {types['turn_id']}, last_turn_id {types['turn_id']}, n_rows int, speaker_code string, text string, block long, open boolean, goes_on boolean")
    final = names[:6]
    if alone:
        return out.select(final)
    out = cut_lineage(out)
    parts = out.where("open")
    parts = parts.withColumn("turn", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(Window.partitionBy("transcript_id").orderBy("first_turn_id")))
    joined = parts.groupBy("transcript_id", "turn").agg(F.min("first_turn_id").alias("first_turn_id"), F.max("last_turn_id").alias("last_turn_id"), F.sum("n_rows").cast("int").alias("n_rows"), F.min("speaker_code").alias("speaker_code"), F.sort_array(F.collect_list(F.struct("first_turn_id", "text"))).alias("parts"))
    joined = joined.withColumn("text", F.concat_ws(" ", "parts.text"))
    return out.where(~F.col("open")).select(final).unionByName(joined.select(final))


def _ordered(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows and, before the rows of each block, what is known of it: one exchange, each block in one piece."""
    rows = rows.withColumns({"fact": F.lit(False), "who": F.lit(None).cast("string"), "last": F.lit(None).cast("struct<at:int,bits:bigint,form:tinyint>"), **{c: F.lit(None).cast("int") for c in ("before", "after", "first")}})
    facts = facts.withColumn("fact", F.lit(True))
    both = rows.unionByName(facts, allowMissingColumns=True)
    spread = F.when(F.col("block") > 0, F.xxhash64("transcript_id", "block")).otherwise(F.xxhash64("transcript_id"))
    return both.repartition(spread).sortWithinPartitions("transcript_id", "block", F.desc("fact"), "turn_id").drop("fact")
