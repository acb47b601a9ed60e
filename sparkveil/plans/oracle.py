"""The same results in SQL for DuckDB, which has no look-around: boundaries are tested on the characters beside a match."""

from __future__ import annotations

from sparkveil import types as t

_W = r"[\p{L}\p{N}_]"
_NOT_W = r"[^\p{L}\p{N}_]"
_D = r"\p{Nd}"
_S = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
# The patterns, in the dialect of DuckDB and in the order that decides ties.
_MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_END = rf"(?:{_NOT_W}|$)"
_X = r"\p{L}\p{N}_"

# (name, type, anchored pattern with the match as group 1, what the first character must be, cheap test of the whole text)
_PATTERNS = [
    ("email", "email", rf"^([{_X}.+-]+@[{_X}-]+(?:\.[{_X}-]+)*\.[{_X}-]*{_W}){_END}", rf"[{_X}.+-]", "@"),
    ("url", "url", rf"^(https?://[^{_S}]+)", "h", "://"),
    ("phone", "phone", rf"^((?:\+?1[-.{_S}]?)?\(?[2-9]{_D}{{2}}\)?[-.{_S}]?[2-9]{_D}{{2}}[-.{_S}]?{_D}{{4}}){_END}", r"[+(\p{Nd}]", rf"{_D}{{4}}"),
    ("date_numeric", "date", rf"^({_D}{{1,2}}[/-]{_D}{{1,2}}[/-]{_D}{{2,4}}){_END}", _D, rf"{_D}[/-]{_D}"),
    ("date_month_year", "date", rf"(?i)^({_MONTH}(?:[{_S}]+{_D}{{1,2}}(?:st|nd|rd|th)?)?,?[{_S}]+{_D}{{4}}){_END}", "[a-zA-Z]", rf"{_D}{{4}}"),
    ("date_day_month", "date", rf"(?i)^({_D}{{1,2}}(?:st|nd|rd|th)?[{_S}]+(?:of[{_S}]+)?{_MONTH}){_END}", _D, _D),
    ("year", "date", rf"^((?:19|20){_D}{{2}}){_END}", _D, rf"{_D}{{4}}"),
    ("id", "id_number", rf"^({_D}{{7,}}){_END}", _D, rf"{_D}{{7}}"),
    ("handle", "social_media_handle", r"^(@[A-Za-z][A-Za-z0-9_.]+)", "@", "@"),
]
_TURN = "SELECT DISTINCT transcript_id, turn_id, text, anonymised_text FROM turns"
_SPANS = "SELECT DISTINCT transcript_id, turn_id, span_start, span_end, text, pii_type, confidence, source FROM spans"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _word(x: str) -> str:
    return f"regexp_full_match({x}, {_q(_W)})"


def _pattern_spans(name: str, source: str, k: int) -> str:
    """Matches of one pattern in the column body of source(transcript_id, turn_id, body): leftmost ones that don't overlap."""
    _, kind, pattern, first, guard = next(p for p in _PATTERNS if p[0] == name)
    before, here = "substr(body, p - 1, 1)", "substr(body, p, 1)"
    edge = f"(CASE WHEN p = 1 THEN false ELSE {_word(before)} END) <> {_word(here)}" if name == "email" else f"(p = 1 OR NOT {_word(before)})"
    return f"""(SELECT transcript_id, turn_id, m.s AS span_start, m.s + length(m.m) AS span_end, m.m AS text, {_q(kind)} AS pii_type, CAST(1.0 AS DOUBLE) AS confidence, 'regex' AS source, {k} AS k FROM (
      SELECT transcript_id, turn_id, unnest(list_reduce(list(list_value({{'s': p - 1, 'm': m}}) ORDER BY p), lambda a, b: CASE WHEN b[1].s >= a[len(a)].s + length(a[len(a)].m) THEN list_concat(a, b) ELSE a END)) AS m FROM (
        SELECT *, regexp_extract(substr(body, p), {_q(pattern)}, 1) AS m FROM (
          SELECT transcript_id, turn_id, body, unnest(range(1, length(body) + 1)) AS p FROM {source} WHERE regexp_matches(body, {_q(guard)}))
        WHERE regexp_matches({here}, {_q(first)}) AND {edge}) WHERE m <> '' GROUP BY transcript_id, turn_id))"""


def _all_patterns(source: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM {_pattern_spans(p[0], source, k)}" for k, p in enumerate(_PATTERNS))


def _fold(source: str, rank: str) -> str:
    """Disjoint spans of source: leftmost, longest, lowest rank first."""
    item = "{'s': span_start, 'e': span_end, 't': text, 'y': pii_type, 'c': confidence, 'o': source}"
    return f"""(SELECT transcript_id, turn_id, m.s AS span_start, m.e AS span_end, m.t AS text, m.y AS pii_type, m.c AS confidence, m.o AS source FROM (
      SELECT transcript_id, turn_id, unnest(list_reduce(list(list_value({item}) ORDER BY span_start, span_start - span_end, {rank}), lambda a, b: CASE WHEN b[1].s >= a[len(a)].e THEN list_concat(a, b) ELSE a END)) AS m FROM {source} GROUP BY transcript_id, turn_id))"""


_BODY = f"body AS (SELECT transcript_id, turn_id, text AS body FROM ({_TURN}))"
_MASK = r"regexp_replace(anonymised_text, '\[[A-Z]+_\p{Nd}+\]', ' ', 'g')"
_MERGED = f"known AS ({_SPANS}), merged AS (SELECT * FROM {_fold('known', 'source, pii_type, confidence')})"


def _collapsed(x: str) -> str:
    return f"regexp_replace({x}, '[{_S}]+', ' ', 'g')"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_S}]+|[{_S}]+$', '', 'g')"


def _registry_key(x: str) -> str:
    return _trim(_collapsed(f"lower({x})"))


def _match_key(x: str) -> str:
    return _trim(_collapsed(f"trim(lower({x}), ' .,!?:;\"''()[]{{}}')"))


_PHRASES = """phrases AS (SELECT DISTINCT text FROM (
  SELECT array_to_string(list_slice(w, i, i + n - 1), ' ') AS text FROM (SELECT w, i, unnest(range(1, least(3, len(w) - i + 1) + 1)) AS n FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT string_split(text, ' ') AS w FROM turns WHERE text <> '')))
  UNION ALL SELECT text FROM spans UNION ALL SELECT text FROM review_items) WHERE text IS NOT NULL)"""


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


_BARE = sum(t.BARE_GENERIC.values(), ())


def _generic(x: str) -> str:
    key = _match_key(x)
    words = f"list_filter(string_split({key}, ' '), lambda w: w <> '')"

    def skipped(prefixes: tuple[str, ...], w: str) -> str:
        return f"(CASE WHEN len(list_filter({w}, lambda v: NOT list_contains({_list(prefixes)}, v))) = 0 THEN [] ELSE list_slice({w}, list_position(list_transform({w}, lambda v: list_contains({_list(prefixes)}, v)), false), len({w})) END)"

    rest = skipped(t.ROLE_PREFIXES, skipped(t.PLACE_PREFIXES, words))
    reduced = f"coalesce(array_to_string({rest}, ' '), '')"
    return f"""(list_contains({_list(t.TITLES + t.NON_NAME_WORDS)}, {key}) OR list_contains({_list(_BARE)}, {key})
      OR len(list_filter({words}, lambda w: list_contains({_list(t.PHRASE_WORDS)}, w))) > 0
      OR list_contains({_list(_BARE)}, {reduced}) OR list_contains({_list(t.TITLES)}, {reduced})
      OR (len({rest}) > 0 AND len(list_filter({rest}, lambda w: NOT list_contains({_list(t.COMMON_WORDS)}, w))) = 0))"""


_PREFIX = "CASE pii_type " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in t.PREFIXES.items()) + " ELSE 'PII' END"
_REGISTRY = f"""firsts AS (SELECT transcript_id, surface_key, arg_min(pii_type, turn_id * 1000000 + span_start) AS pii_type, min(turn_id * 1000000 + span_start) AS place FROM (SELECT *, {_registry_key("text")} AS surface_key FROM merged) GROUP BY ALL),
  prefixed AS (SELECT *, {_PREFIX} AS prefix FROM firsts),
  tokens AS (SELECT transcript_id, surface_key, prefix, CAST(row_number() OVER (PARTITION BY transcript_id, prefix ORDER BY place) AS INTEGER) AS n, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY place) - 1 AS INTEGER) AS ord FROM prefixed),
  reg AS (SELECT transcript_id, surface_key, prefix, n, '[' || prefix || '_' || n || ']' AS token, ord FROM tokens)"""
_HITS = f"""body AS (SELECT transcript_id, turn_id, {_MASK} AS body FROM ({_TURN})),
  found AS ({_all_patterns("body")}),
  hits AS (SELECT DISTINCT transcript_id, turn_id, item_ord AS hit_ord, text FROM review_items WHERE reason = 'gate: auto-corrected' AND text IS NOT NULL
    UNION ALL SELECT transcript_id, turn_id, CAST(1000000000 + row_number() OVER (PARTITION BY transcript_id, turn_id ORDER BY k, span_start) - 1 AS INTEGER), text FROM found)"""
_CONFIRMED = rf"""{_HITS}, confirmed AS (SELECT h.transcript_id, h.turn_id, h.text, min(hit_ord) AS hit_ord FROM hits h JOIN ({_TURN}) t USING (transcript_id, turn_id)
    WHERE NOT regexp_full_match({_trim("h.text")}, '\[?[A-Z]+_\p{{Nd}}+\]?') AND NOT {_generic("h.text")} AND contains(lower(t.anonymised_text), lower(h.text)) GROUP BY ALL)"""
_LOW = f"""low AS (SELECT transcript_id, turn_id, span_start, text, pii_type, confidence FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, turn_id, text ORDER BY span_start, span_end) AS i FROM merged WHERE confidence < 0.8 AND NOT {_generic("text")}) WHERE i = 1)"""
_QUEUE = """queue AS (SELECT transcript_id, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY part, turn_id, place, text) - 1 AS INTEGER) AS item_ord, turn_id, text, reason, pii_type, confidence FROM (
    SELECT transcript_id, turn_id, 0 AS part, span_start AS place, text, 'low-confidence detection' AS reason, pii_type, confidence FROM low
    UNION ALL SELECT transcript_id, turn_id, 1, hit_ord, text, 'gate: auto-corrected', NULL, 1.0 FROM confirmed))"""
_REPORTS = """reps AS (SELECT t.transcript_id, CASE WHEN coalesce(weak, 0) = 1 THEN 'needs_review' ELSE 'clean' END AS status, CAST(coalesce(n_spans, 0) AS INTEGER) AS n_spans, CAST(coalesce(n_items, 0) AS INTEGER) AS n_review_items
    FROM (SELECT DISTINCT transcript_id FROM turns) t LEFT JOIN (SELECT transcript_id, count(*) AS n_spans FROM merged GROUP BY 1) USING (transcript_id)
    LEFT JOIN (SELECT transcript_id, count(*) AS n_items, max(CASE WHEN reason = 'low-confidence detection' THEN 1 ELSE 0 END) AS weak FROM queue GROUP BY 1) USING (transcript_id))"""
_LINES = rf"""lines AS (SELECT transcript_id, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY i) - 1 AS INTEGER) AS turn_id, line FROM (
    SELECT transcript_id, i, {_trim("l[i]")} AS line FROM (SELECT transcript_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
      SELECT CAST(doc_id AS VARCHAR) AS transcript_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM (SELECT DISTINCT doc_id, text FROM documents)))) WHERE line <> ''),
  said AS (SELECT transcript_id, turn_id, CASE WHEN regexp_matches(line, '(?s)^[^:]{{1,80}}:') THEN {_trim("regexp_extract(line, '(?s)^([^:]{1,80}):(.*)$', 1)")} ELSE 'unknown' END AS speaker,
    CASE WHEN regexp_matches(line, '(?s)^[^:]{{1,80}}:') THEN regexp_replace(regexp_extract(line, '(?s)^([^:]{{1,80}}):(.*)$', 2), '^[{_S}]+', '') ELSE line END AS text FROM lines)"""
_FLAT = "transcript_id, turn_id, CAST(span_start AS INTEGER) AS span_start, CAST(span_end AS INTEGER) AS span_end, text, pii_type, confidence, source"
_LOCATED = f"""asked AS (SELECT DISTINCT transcript_id, turn_id, span_start AS ord, text AS mention, pii_type, confidence FROM ({_SPANS}) WHERE source = 'llm' AND text <> ''),
  pieces AS (SELECT a.*, string_split(t.text, mention) AS w FROM asked a JOIN ({_TURN}) t USING (transcript_id, turn_id) WHERE contains(t.text, mention)),
  located AS (SELECT transcript_id, turn_id, ord, CAST(list_sum(list_transform(list_slice(w, 1, i), lambda v: length(v))) + (i - 1) * length(mention) AS INTEGER) AS span_start, mention AS text, pii_type, confidence FROM (SELECT *, unnest(range(1, len(w))) AS i FROM pieces))"""
_DETECTED = f"""{_LOCATED}, {_BODY},
  every AS (SELECT transcript_id, turn_id, span_start, span_start + length(text) AS span_end, text, pii_type, confidence, 'llm' AS source, ord AS k FROM located WHERE NOT {_generic("text")}
    UNION ALL SELECT transcript_id, turn_id, span_start, span_end, text, pii_type, confidence, source, 1000000 + k FROM ({_all_patterns("body")})),
  detected AS (SELECT * FROM {_fold("every", "k, span_end, text, pii_type, confidence")})"""


def _contextual(source: str) -> str:
    place = "turn_id * 1000000 + span_start"
    return f"""ctx AS (SELECT transcript_id, match_key, pii_type, arg_max(text, {place}) AS text, arg_max(confidence, {place}) AS confidence, CAST(min({place}) // 1000000 AS INTEGER) AS first_turn, CAST(min({place}) % 1000000 AS INTEGER) AS first_start
      FROM (SELECT *, {_match_key("text")} AS match_key FROM {source} WHERE source = 'llm') WHERE length(match_key) >= 3 GROUP BY transcript_id, match_key, pii_type)"""


_PROPAGATED = f"""{_DETECTED}, {_contextual("detected")},
  near AS (SELECT c.*, t.turn_id, t.text AS body FROM ctx c JOIN ({_TURN}) t USING (transcript_id) WHERE contains(lower(t.text), lower(c.text))),
  places AS (SELECT *, unnest(range(1, length(body) - length(text) + 2)) AS p FROM near),
  repeats AS (SELECT transcript_id, turn_id, p - 1 AS span_start, p - 1 + length(text) AS span_end, substr(body, p, length(text)) AS text, pii_type, confidence, 'llm' AS source, first_turn * 1000000 + first_start AS k, pii_type AS k2 FROM places
    WHERE lower(substr(body, p, length(text))) = lower(text) AND (p = 1 OR NOT {_word("substr(body, p - 1, 1)")}) AND NOT {_word("substr(body, p + length(text), 1)")}),
  both_ AS (SELECT *, -1 AS k, '' AS k2 FROM detected UNION ALL SELECT * FROM repeats)"""


# The pipeline as a whole: propagated spans, their registry and tokens, the redacted turns, what is left in them, the sweep.
_ALL_SPANS = f"""{_PROPAGATED}, every_span AS (SELECT * FROM {_fold("both_", "k, k2")})"""
_ALL_REGISTRY = _REGISTRY.replace("FROM merged", "FROM every_span")
_ALL_REDACTED = f"""marked AS (SELECT m.*, r.token, coalesce(lag(span_end) OVER (PARTITION BY m.transcript_id, m.turn_id ORDER BY span_start), 0) AS prev FROM every_span m JOIN reg r ON r.transcript_id = m.transcript_id AND r.surface_key = {_registry_key("m.text")}),
  put AS (SELECT m.transcript_id, m.turn_id, string_agg(substr(t.text, prev + 1, span_start - prev) || token, '' ORDER BY span_start) AS head, max(span_end) AS done FROM marked m JOIN ({_TURN}) t USING (transcript_id, turn_id) GROUP BY ALL),
  redacted AS (SELECT t.transcript_id, t.turn_id, CASE WHEN head IS NULL THEN t.text ELSE head || substr(t.text, done + 1) END AS anonymised_text FROM ({_TURN}) t LEFT JOIN put USING (transcript_id, turn_id))"""
_ALL_CONFIRMED = (
    _CONFIRMED.replace(f"FROM ({_TURN})", "FROM redacted").replace(f"JOIN ({_TURN})", "JOIN redacted").replace("body AS (", "left_body AS (").replace("found AS (", "left_found AS (").replace("FROM found", "FROM left_found").replace("FROM body WHERE", "FROM left_body WHERE")
)
_ADDED = f"""fresh AS (SELECT transcript_id, surface_key, min(CAST(turn_id AS BIGINT) * 10000000000 + hit_ord) AS place FROM (SELECT *, {_registry_key("text")} AS surface_key FROM confirmed) GROUP BY ALL),
  added AS (SELECT f.transcript_id, f.surface_key, row_number() OVER (PARTITION BY f.transcript_id ORDER BY place) AS k FROM fresh f ANTI JOIN reg r ON r.transcript_id = f.transcript_id AND r.surface_key = f.surface_key),
  last AS (SELECT transcript_id, max(CASE WHEN prefix = 'PII' THEN n END) AS last_n, max(ord) AS last_ord FROM reg GROUP BY 1),
  full_reg AS (SELECT * FROM reg UNION ALL SELECT transcript_id, surface_key, 'PII', CAST(k + coalesce(last_n, 0) AS INTEGER), '[PII_' || (k + coalesce(last_n, 0)) || ']', CAST(k + coalesce(last_ord, -1) AS INTEGER) FROM added LEFT JOIN last USING (transcript_id))"""
_ALL_LOW = _LOW.replace("FROM merged", "FROM every_span").replace("confidence < 0.8", "confidence < 0.5")


def _all(*more: str) -> str:
    return "WITH " + ", ".join([_ALL_SPANS, _ALL_REGISTRY, _ALL_REDACTED, _ALL_CONFIRMED, *more])


def _swept(turns: str, registry: str) -> str:
    """swept: turns with all surfaces of the registry replaced, longest first, in the transcripts of confirmed."""
    edge = (_q(rf"(?i)(^|[^{_X}\[])"), _q(rf"($|[^{_X}\]])"))
    once = lambda x: f"regexp_replace({x}, {edge[0]} || regexp_escape(b.s) || {edge[1]}, '\\1' || b.t || '\\2', 'g')"
    return f"""surfaces AS (SELECT DISTINCT r.* FROM {registry} r SEMI JOIN confirmed USING (transcript_id) WHERE surface_key <> ''),
      near_turns AS (SELECT t.transcript_id, t.turn_id, list_prepend({{'s': '', 't': '', 'x': any_value(t.anonymised_text)}}, list({{'s': surface_key, 't': token, 'x': ''}} ORDER BY -length(surface_key), ord, surface_key, token)) AS l
        FROM {turns} t JOIN surfaces s USING (transcript_id) WHERE contains(lower(t.anonymised_text), s.surface_key) OR contains(s.surface_key, '[') GROUP BY ALL),
      swept AS (SELECT transcript_id, turn_id, list_reduce(l, lambda a, b: {{'s': '', 't': '', 'x': {once(once("a.x"))}}}).x AS y FROM near_turns)"""


def oracle_sql() -> dict[str, str]:
    flat = f"SELECT {_FLAT} FROM "
    out = {f"spans_{p[0]}": f"WITH {_BODY} {flat}{_pattern_spans(p[0], 'body', 0)}" for p in _PATTERNS}
    structured = f"WITH {_BODY}, found AS ({_all_patterns('body')}) "
    out["regex_spans_all"] = structured + flat + "found"
    out["merged_spans"] = structured + flat + _fold("found", "k")
    out["merged_known_spans"] = f"WITH {_MERGED} {flat} merged"
    out["text_source_turns"] = f"WITH {_LINES} SELECT transcript_id, turn_id, speaker, text FROM said"
    out["speakers_of_lines"] = f"WITH {_LINES} SELECT speaker, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM said GROUP BY speaker"
    out["normalise_keys"] = f"WITH {_PHRASES} SELECT text, {_match_key('text')} AS match_key, {_registry_key('text')} AS registry_key FROM phrases"
    out["generic_predicate"] = f"WITH {_PHRASES} SELECT text, {_generic('text')} AS generic FROM phrases"
    out["generic_filter"] = f"SELECT * FROM ({_SPANS}) WHERE NOT {_generic('text')}"
    out["located_mentions"] = f"WITH {_LOCATED} SELECT transcript_id, turn_id, ord, span_start, CAST(span_start + length(text) AS INTEGER) AS span_end, text, pii_type, confidence, 'llm' AS source FROM located"
    out["contextual_dictionary"] = f"WITH {_MERGED}, {_contextual('merged')} SELECT * FROM ctx"
    out["propagated_spans"] = f"WITH {_PROPAGATED} {flat}{_fold('both_', 'k, k2')}"
    out["token_registry_of_spans"] = f"WITH {_MERGED}, {_REGISTRY} SELECT * FROM reg"
    out["redacted_turns"] = f"""WITH {_MERGED}, {_REGISTRY}, marked AS (SELECT m.*, r.token, coalesce(lag(span_end) OVER (PARTITION BY m.transcript_id, m.turn_id ORDER BY span_start), 0) AS prev FROM merged m JOIN reg r ON r.transcript_id = m.transcript_id AND r.surface_key = {_registry_key("m.text")}),
      put AS (SELECT m.transcript_id, m.turn_id, string_agg(substr(t.text, prev + 1, span_start - prev) || token, '' ORDER BY span_start) AS head, max(span_end) AS done FROM marked m JOIN ({_TURN}) t USING (transcript_id, turn_id) GROUP BY ALL)
      SELECT t.transcript_id, t.turn_id, CASE WHEN head IS NULL THEN t.text ELSE head || substr(t.text, done + 1) END AS anonymised_text FROM ({_TURN}) t LEFT JOIN put USING (transcript_id, turn_id)"""
    out["masked_texts"] = f"SELECT transcript_id, turn_id, {_MASK} AS masked_text FROM ({_TURN})"
    out["token_artifacts"] = rf"WITH {_PHRASES} SELECT text, regexp_full_match({_trim('text')}, '\[?[A-Z]+_\p{{Nd}}+\]?') AS artifact FROM phrases"
    out["gate_hits"] = f"WITH {_HITS} SELECT * FROM hits"
    out["gate_confirmed"] = f"WITH {_CONFIRMED} SELECT * FROM confirmed"
    out["gate_registry"] = f"""WITH {_MERGED}, {_REGISTRY}, {_CONFIRMED},
      fresh AS (SELECT transcript_id, surface_key, min(CAST(turn_id AS BIGINT) * 10000000000 + hit_ord) AS place FROM (SELECT *, {_registry_key("text")} AS surface_key FROM confirmed) GROUP BY ALL),
      added AS (SELECT f.transcript_id, f.surface_key, row_number() OVER (PARTITION BY f.transcript_id ORDER BY place) AS k FROM fresh f ANTI JOIN reg r ON r.transcript_id = f.transcript_id AND r.surface_key = f.surface_key),
      last AS (SELECT transcript_id, max(CASE WHEN prefix = 'PII' THEN n END) AS last_n, max(ord) AS last_ord FROM reg GROUP BY 1)
      SELECT * FROM reg UNION ALL SELECT transcript_id, surface_key, 'PII', CAST(k + coalesce(last_n, 0) AS INTEGER), '[PII_' || (k + coalesce(last_n, 0)) || ']', CAST(k + coalesce(last_ord, -1) AS INTEGER) FROM added LEFT JOIN last USING (transcript_id)"""
    out["swept_turns"] = f"WITH {_CONFIRMED}, turns_ AS ({_TURN}), {_swept('turns_', 'registry')} SELECT transcript_id, turn_id, coalesce(y, anonymised_text) AS anonymised_text FROM turns_ LEFT JOIN swept USING (transcript_id, turn_id)"
    out["low_confidence_spans"] = f"WITH {_MERGED}, {_LOW} SELECT * FROM low"
    out["review_queue"] = f"WITH {_MERGED}, {_LOW}, {_CONFIRMED}, {_QUEUE} SELECT * FROM queue"
    out["transcript_reports"] = f"WITH {_MERGED}, {_LOW}, {_CONFIRMED}, {_QUEUE}, {_REPORTS} SELECT * FROM reps"
    out["batch_summary"] = f"WITH {_MERGED}, {_LOW}, {_CONFIRMED}, {_QUEUE}, {_REPORTS} SELECT count(*) AS processed, count(*) FILTER (status = 'needs_review') AS needs_review, CAST(0 AS BIGINT) AS failed, CAST(sum(n_spans) AS BIGINT) AS replacements, CAST(sum(n_review_items) AS BIGINT) AS review_items FROM reps"
    out["spans_by_type"] = structured + f"SELECT pii_type, count(*) AS n_spans, count(DISTINCT transcript_id) AS n_transcripts, CAST(sum(span_end - span_start) AS BIGINT) AS n_chars FROM {_fold('found', 'k')} GROUP BY 1"
    out["deidentify_end_to_end"] = f"{_all(_ADDED, _swept('redacted', 'full_reg'))} SELECT transcript_id, turn_id, coalesce(y, anonymised_text) AS anonymised_text FROM redacted LEFT JOIN swept USING (transcript_id, turn_id)"
    out["end_to_end_registry"] = f"{_all(_ADDED)} SELECT * FROM full_reg"
    out["end_to_end_review_items"] = f"{_all(_ALL_LOW, _QUEUE)} SELECT * FROM queue"
    out["end_to_end_reports"] = f"{_all(_ALL_LOW, _QUEUE, _REPORTS.replace('FROM merged', 'FROM every_span'))} SELECT * FROM reps"
    out["anonymised_documents"] = "SELECT transcript_id, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY turn_id) - 1 AS INTEGER) AS place, turn_id, coalesce(speaker, 'unknown') AS speaker, coalesce(anonymised_text, '') AS text FROM (SELECT DISTINCT transcript_id, turn_id, speaker, anonymised_text FROM turns)"
    out["report_documents"] = f"""WITH {_MERGED}, {_REGISTRY}, {_LOW}, {_CONFIRMED}, {_QUEUE}, {_REPORTS}, tokened AS (SELECT m.*, r.token FROM merged m JOIN reg r ON r.transcript_id = m.transcript_id AND r.surface_key = {_registry_key("m.text")})
      SELECT reps.transcript_id, status, n_spans, CAST(coalesce(n_tokens, 0) AS INTEGER) AS n_tokens, n_review_items, coalesce(tokens_in_order, '') AS tokens_in_order, coalesce(surfaces, '') AS surfaces FROM reps
      LEFT JOIN (SELECT transcript_id, string_agg(token, ',' ORDER BY turn_id, span_start, span_end) AS tokens_in_order FROM tokened GROUP BY 1) USING (transcript_id)
      LEFT JOIN (SELECT transcript_id, count(*) AS n_tokens, string_agg(surface_key, '|' ORDER BY surface_key) AS surfaces FROM reg GROUP BY 1) USING (transcript_id)"""
    out["queue_documents"] = f"WITH {_MERGED}, {_LOW}, {_CONFIRMED}, {_QUEUE} SELECT transcript_id, item_ord AS place, turn_id, text, reason, pii_type, confidence FROM queue"
    out["json_source_turns"] = "SELECT transcript_id, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY turn_id) - 1 AS INTEGER) AS turn_id, coalesce(speaker, 'unknown') AS speaker, coalesce(text, '') AS text FROM (SELECT DISTINCT transcript_id, turn_id, speaker, text FROM turns WHERE transcript_id IS NOT NULL AND turn_id IS NOT NULL)"
    out["text_files_turns"] = out["text_source_turns"]
    out["source_errors"] = f"""WITH files AS (SELECT DISTINCT '/in/j-' || transcript_id || '-' || item_ord AS name, coalesce(text, '') AS text FROM review_items)
      SELECT name || '.json' AS path, CASE WHEN starts_with(text, chr(65279)) THEN 'JSON begins with a byte order mark' WHEN NOT json_valid(text) THEN 'not JSON' ELSE 'JSON is not an object' END AS message FROM files
      UNION ALL SELECT name || '.txt', 'no turns were found' FROM files WHERE {_trim("regexp_replace(text, '^' || chr(65279), '')")} = ''"""
    out["validated_turns"] = f"""WITH {_MERGED}, {_LOW}, {_CONFIRMED} SELECT transcript_id, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY part, turn_id, place, text) - 1 AS INTEGER) AS item_ord, turn_id, text, reason, pii_type, confidence FROM (
      SELECT transcript_id, turn_id, 1 AS part, span_start AS place, text, 'low-confidence detection' AS reason, pii_type, confidence FROM low UNION ALL SELECT transcript_id, turn_id, 0, hit_ord, text, 'residual PII (gate)', NULL, 1.0 FROM confirmed)"""
    return out
