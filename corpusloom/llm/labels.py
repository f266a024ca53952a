"""Labels as the tables spell them: language codes and source names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGS = ("te", "te_latn", "en", "hi", "kn", "ta", "mr")
# Other spellings of the codes, in lower case with a hyphen for an underscore.
ALIASES = {
    "te": "te", "tel": "te", "te-in": "te", "telugu": "te", "te-latn": "te_latn", "tel-latn": "te_latn", "en": "en", "eng": "en", "en-in": "en",
    "hi": "hi", "hin": "hi", "hi-in": "hi", "kn": "kn", "kan": "kn", "ta": "ta", "tam": "ta", "mr": "mr", "mar": "mr",
}


def lang_code(label: Column) -> Column:
    """The code that a label names; null for a missing or unknown one."""
    plain = F.regexp_replace(F.lower(F.trim(label)), "_", "-")
    return F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[plain]


def source_key(source: Column) -> Column:
    """A source's name without differences of case, hyphens and outer spaces; null stays null, a blank one becomes null."""
    key = F.regexp_replace(F.lower(F.trim(source)), r"[-\s]+", "_")
    return F.when(key != "", key)
