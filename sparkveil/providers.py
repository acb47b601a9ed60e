"""Detectors of contextual identifiers: tables, gazetteers, Python functions, a model behind an HTTP address.

Each gives mentions (transcript_id, turn_id, ord, text, pii_type, confidence) for `detect`, or residuals (transcript_id,
turn_id, ord, text) for the gate. A provider's rows are computed once and kept (`cut_lineage`): an answer of a model must not
be asked for again by each table that is made from it, nor differ between them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkveil import types as t
from sparkveil.options import Options
from sparkveil.storage import cut_lineage

DETECTION_PROMPT = (
    "You mark personal information in one turn of an interview. Answer with JSON: {\"mentions\": [{\"text\", \"pii_type\", \"confidence\"}]}. "
    "text is copied exactly from the turn; pii_type is one of " + ", ".join(t.PII_TYPES) + "; confidence is from 0 to 1. "
    "Mark names of people (also nicknames, relatives and clinicians), schools, named organisations and places, street addresses, post codes, phone numbers, "
    "years that tell someone's birth or age, school years, and the work of the speaker or of relatives where it is told of a person. "
    "Don't mark general words for people, places and work, pronouns, or questions that only ask for such information."
)
RESIDUAL_PROMPT = (
    "The turn has been de-identified; [WORDS_1] in brackets stand for what was removed. Answer with JSON: {\"identifiers\": [text, ...]}, "
    "the personal information that is still there, copied exactly. Leave out placeholders and parts of them, general words, public figures, works of fiction and well-known brands. The list may be empty."
)


def from_gazetteer(turns: DataFrame, names: DataFrame) -> DataFrame:
    """Mentions of listed names: rows text, pii_type, confidence of `names` that stand in a turn. The names are met word by word,
    so a long list costs no more than the words of the turns; texts come back to what was met only."""
    from sparkveil.functions.text import longest_word, words_of

    listed = names.select("text", "pii_type", "confidence").where("text <> ''").distinct().withColumn("word", longest_word(F.col("text"))).where("word is not null")
    words = turns.select("transcript_id", "turn_id", F.explode(words_of(F.col("text"))).alias("word"))
    met = words.join(listed, "word").drop("word").join(turns.select("transcript_id", "turn_id", F.col("text").alias("turn")), ["transcript_id", "turn_id"]).where(F.contains("turn", "text"))
    return met.select("transcript_id", "turn_id", F.instr("turn", F.col("text")).alias("ord"), "text", "pii_type", "confidence").distinct()


@dataclass(frozen=True)
class Answers:
    """What a detector said of the turns, and transcripts of which it failed on a turn: rows transcript_id, message."""

    rows: DataFrame
    errors: DataFrame


FAILURES = (RuntimeError, ValueError, OSError, KeyError, IndexError, TypeError)  # of a model or the way to it


def _answers(turns: DataFrame, column: str, ask: Callable[[], Callable[[int, str], list[tuple]]], schema: T.StructType) -> Answers:
    """ask() is called once a partition and gives the function of (turn_id, text). A transcript is asked no further in a
    partition once it has failed there."""
    names = [f.name for f in schema.fields]
    kinds = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[f.dataType.simpleString()] for f in schema.fields]

    def run(batches):
        one, failed = ask(), set()
        for batch in batches:
            rows: list[tuple] = []
            for tid, turn, text in zip(*(batch.column(c).to_pylist() for c in ("transcript_id", "turn_id", column))):
                if text is None or tid in failed:
                    continue
                try:
                    rows += [(tid, turn, k, *x, None) for k, x in enumerate(one(turn, text))]
                except FAILURES as error:
                    failed.add(tid)
                    rows.append((tid, turn, *[None] * (len(names) - 2), f"{type(error).__name__}: {error}"))
            yield _batch(rows, [*names, "failure"], [*kinds, pa.string()])

    out = cut_lineage(turns.select("transcript_id", "turn_id", column).mapInArrow(run, T.StructType([*schema.fields, T.StructField("failure", T.StringType())])))
    errors = out.where("failure is not null").groupBy("transcript_id").agg(F.min_by("failure", "turn_id").alias("message"))
    return Answers(out.where("failure is null").drop("failure"), errors)


def _all_or_nothing(answers: Answers) -> DataFrame:
    first = answers.errors.first()
    if first:
        raise RuntimeError(f"{first.transcript_id}: {first.message}")
    return answers.rows


def from_function(turns: DataFrame, detect: Callable[[int, str], list[tuple[str, str, float]]]) -> DataFrame:
    """Mentions by a Python function of (turn_id, text) that gives (text, pii_type, confidence) tuples. An error in it is raised."""
    return _all_or_nothing(_answers(turns, "text", lambda: detect, t.MENTION))


def residuals_from_function(turns: DataFrame, residual: Callable[[int, str], list[str]]) -> DataFrame:
    """Residuals by a Python function of (turn_id, anonymised text). An error in it is raised."""
    return _all_or_nothing(_answers(turns, "anonymised_text", lambda: lambda turn, text: [(x,) for x in residual(turn, text)], t.RESIDUAL))


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)], names=names)


def parse_answer(content: object) -> dict:
    """The JSON object of a model's answer. What follows the first complete value is ignored; anything else is a RuntimeError."""
    if isinstance(content, dict):
        return content
    if not isinstance(content, str):
        raise RuntimeError("the model's answer is not a text")
    try:
        value, _ = json.JSONDecoder().raw_decode(content.lstrip())
    except ValueError as error:
        raise RuntimeError("the model's answer is not JSON") from error
    if not isinstance(value, dict):
        raise RuntimeError("the model's answer is not an object")
    return value


def mentions_of(answer: dict) -> list[tuple[str, str, float]]:
    """Mentions of a parsed answer; a type that doesn't exist or a text that is none is a RuntimeError."""
    out = []
    for m in answer.get("mentions", []):
        if not isinstance(m, dict) or not isinstance(m.get("text"), str) or m.get("pii_type") not in t.PII_TYPES:
            raise RuntimeError(f"not a mention: {m!r}")
        out.append((m["text"], m["pii_type"], float(m.get("confidence", 0.9))))
    return out


class Client:
    """Structured requests to a chat-completions address, at temperature 0, over one connection that is kept open."""

    def __init__(self, options: Options) -> None:
        self.options, self.connection = options, None

    def _send(self, path: str, body: bytes) -> bytes:
        import http.client
        from urllib.parse import urlsplit

        url = urlsplit(self.options.base_url)
        if self.connection is None:
            kind = http.client.HTTPSConnection if url.scheme == "https" else http.client.HTTPConnection
            self.connection = kind(url.hostname, url.port, timeout=self.options.timeout_seconds)
        try:
            self.connection.request("POST", url.path + path, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.options.api_key}"})
            reply = self.connection.getresponse()
            data = reply.read()
        except (OSError, http.client.HTTPException) as error:
            self.close()
            raise RuntimeError(f"no answer of the model: {error}") from error
        if reply.status != 200:
            raise RuntimeError(f"the model's address answered {reply.status}")
        return data

    def close(self) -> None:
        if self.connection is not None:
            self.connection.close()
            self.connection = None

    def ask(self, system: str, text: str, schema: dict) -> dict:
        body = {"model": self.options.model, "temperature": 0, "stream": False, "messages": [{"role": "system", "content": system}, {"role": "user", "content": text}], "response_format": {"type": "json_schema", "json_schema": {"name": "answer", "strict": True, "schema": schema}}}
        return parse_answer(json.loads(self._send("/chat/completions", json.dumps(body).encode()))["choices"][0]["message"]["content"])


def list_models(options: Options, opener: Callable | None = None) -> list[str]:
    import urllib.request

    request = urllib.request.Request(f"{options.base_url}/models", headers={"Authorization": f"Bearer {options.api_key}"})
    with (opener or urllib.request.urlopen)(request, timeout=options.timeout_seconds) as reply:
        return [m["id"] for m in json.loads(reply.read())["data"]]


def model_digest(options: Options, opener: Callable | None = None) -> str | None:
    """The digest of a model that a provider on this machine serves; None elsewhere; RuntimeError if it has no such model."""
    import urllib.request

    if options.provider != "ollama" or not options.loopback:
        return None
    root = options.base_url.removesuffix("/v1")
    with (opener or urllib.request.urlopen)(f"{root}/api/tags", timeout=options.timeout_seconds) as reply:
        digests = {m["name"]: m.get("digest") for m in json.loads(reply.read()).get("models", [])}
    for name in (options.model, f"{options.model}:latest"):
        if name in digests:
            return digests[name]
    raise RuntimeError(f"the provider has no model {options.model}")


_MENTIONS_SCHEMA = {"type": "object", "properties": {"mentions": {"type": "array", "items": {"type": "object", "properties": {"text": {"type": "string"}, "pii_type": {"type": "string", "enum": list(t.PII_TYPES)}, "confidence": {"type": "number"}}, "required": ["text", "pii_type", "confidence"], "additionalProperties": False}}}, "required": ["mentions"], "additionalProperties": False}
_RESIDUAL_SCHEMA = {"type": "object", "properties": {"identifiers": {"type": "array", "items": {"type": "string"}}}, "required": ["identifiers"], "additionalProperties": False}


def from_model(turns: DataFrame, options: Options) -> Answers:
    """Mentions by the model of the options: one request a turn, from the executors, over a connection for each partition."""

    def ask():
        client = Client(options)
        return lambda _, text: mentions_of(client.ask(DETECTION_PROMPT, text, _MENTIONS_SCHEMA))

    return _answers(turns, "text", ask, t.MENTION)


def residuals_from_model(turns: DataFrame, options: Options) -> Answers:
    def ask():
        client = Client(options)
        return lambda _, text: [(x,) for x in client.ask(RESIDUAL_PROMPT, text, _RESIDUAL_SCHEMA).get("identifiers", []) if isinstance(x, str)]

    return _answers(turns, "anonymised_text", ask, t.RESIDUAL)
