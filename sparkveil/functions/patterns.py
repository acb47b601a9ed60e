"""Patterns of structured identifiers in the regular-expression dialect of the JVM.

Word characters are letters, numbers and the underscore of any script, digits are those of any script; \\w, \\d and \\b of the
JVM mean ASCII, so they aren't used. Fixed values: the patterns, in the order that decides ties.
"""

W = r"[\p{L}\p{N}_]"
D = r"\p{Nd}"
SPACE = r"\s\x1c-\x1f"
EDGE = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"
MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"

# (name, identifier type, pattern, cheap pattern that must match for it to match at all)
STRUCTURED = [
    ("email", "email", rf"{EDGE}[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+(?:\.[\p{{L}}\p{{N}}_-]+)+{EDGE}", "@"),
    ("url", "url", rf"(?U)(?<!{W})https?://[^{SPACE}]+", "://"),
    ("phone", "phone", rf"(?U)(?<!{W})(?:\+?1[-.{SPACE}]?)?\(?[2-9]{D}{{2}}\)?[-.{SPACE}]?[2-9]{D}{{2}}[-.{SPACE}]?{D}{{4}}(?!{W})", rf"{D}{{4}}"),
    ("date_numeric", "date", rf"(?<!{W}){D}{{1,2}}[/-]{D}{{1,2}}[/-]{D}{{2,4}}(?!{W})", rf"{D}[/-]{D}"),
    ("date_month_year", "date", rf"(?iuU)(?<!{W}){MONTH}(?:[{SPACE}]+{D}{{1,2}}(?:st|nd|rd|th)?)?,?[{SPACE}]+{D}{{4}}(?!{W})", rf"{D}{{4}}"),
    ("date_day_month", "date", rf"(?iuU)(?<!{W}){D}{{1,2}}(?:st|nd|rd|th)?[{SPACE}]+(?:of[{SPACE}]+)?{MONTH}(?!{W})", D),
    ("year", "date", rf"(?<!{W})(?:19|20){D}{{2}}(?!{W})", rf"{D}{{2}}"),
    ("id", "id_number", rf"(?<!{W}){D}{{7,}}(?!{W})", rf"{D}{{7}}"),
    ("handle", "social_media_handle", rf"(?<!{W})@[A-Za-z][A-Za-z0-9_.]{{1,}}", "@"),
]
TOKEN = r"\[[A-Z]+_\p{Nd}+\]"
TOKEN_ARTIFACT = r"^\[?[A-Z]+_\p{Nd}+\]?$"
STRIPPED = " .,!?:;\"'()[]{}"
