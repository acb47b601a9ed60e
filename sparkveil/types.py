"""Schemas, identifier types and the fixed word lists of the generic filter."""

from __future__ import annotations

from pyspark.sql import types as T

PII_TYPES = ("person_name", "nickname", "family_member", "clinician_name", "school", "place", "organisation", "occupation", "address", "postcode", "date", "phone", "email", "url", "id_number", "social_media_handle", "other")

# Token prefix of each type; any other type has PII.
PREFIXES = {
    "person_name": "NAME", "nickname": "NAME", "family_member": "NAME", "clinician_name": "NAME", "school": "SCHOOL", "place": "PLACE", "organisation": "ORG", "occupation": "OCCUPATION", "address": "ADDRESS",
    "postcode": "POSTCODE", "date": "DATE", "phone": "PHONE", "email": "EMAIL", "url": "URL", "id_number": "ID", "social_media_handle": "HANDLE", "other": "PII",
}

# Words of the generic filter.
BARE_GENERIC = {
    "school": ("school", "college", "university", "uni", "class", "high school", "undergrad"),
    "family_member": ("husband", "wife", "mother", "father", "mum", "mom", "dad", "sister", "brother", "parents", "children", "kids"),
    "clinician_name": ("counselor", "counsellor", "doctor", "therapist", "clinician", "gp"),
    "organisation": ("work", "job", "office", "department", "company", "organisation", "organization"),
    "place": ("home", "house", "store", "shop", "factory"),
}
COMMON_WORDS = ("a", "age", "an", "another", "any", "back", "bottom", "case", "centre", "center", "class", "client", "college", "company", "counselor", "counsellor", "department", "doctor", "edge", "family", "front", "gp", "group", "home", "hospital", "house", "job", "middle", "office", "organisation", "organization", "part", "place", "practice", "program", "programme", "provider", "room", "school", "section", "service", "shop", "side", "store", "teacher", "therapist", "top", "uni", "university", "ward", "work", "workplace")
TITLES = ("sir", "madam", "ma'am", "mr", "mrs", "ms", "miss")
NON_NAME_WORDS = ("i", "me", "my", "mine", "myself", "you", "your", "yours", "yourself", "he", "him", "his", "she", "her", "hers", "we", "us", "our", "ours", "they", "them", "their", "theirs", "it", "its", "this", "that", "yes", "no", "yeah", "yep", "okay", "ok", "thanks", "thank", "sorry", "please", "hello", "hi", "goodbye", "bye", "absolutely", "right", "well")
PHRASE_WORDS = ("i", "me", "my", "mine", "myself", "you", "your", "yours", "yourself", "we", "us", "our", "ours", "ourselves", "they", "them", "their", "theirs", "themselves", "what", "where", "when", "why", "who", "whom", "whose", "which", "how")
ROLE_PREFIXES = ("my", "your", "our", "their", "his", "her", "the", "a", "an")
PLACE_PREFIXES = ("at", "in", "from", "to", "near", "around", "inside", "outside")

TURN = T.StructType([T.StructField("transcript_id", T.StringType()), T.StructField("turn_id", T.IntegerType()), T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType())])
MENTION = T.StructType([T.StructField("transcript_id", T.StringType()), T.StructField("turn_id", T.IntegerType()), T.StructField("ord", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("pii_type", T.StringType()), T.StructField("confidence", T.DoubleType())])
RESIDUAL = T.StructType([T.StructField("transcript_id", T.StringType()), T.StructField("turn_id", T.IntegerType()), T.StructField("ord", T.IntegerType()), T.StructField("text", T.StringType())])
ERROR = T.StructType([T.StructField("path", T.StringType()), T.StructField("message", T.StringType())])
