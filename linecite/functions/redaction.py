"""Secret redaction as chained regex replacements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"

# The secret patterns, applied in this order, ignoring case.
SECRET_PATTERNS = (
    r"""(api[_-]?key["'\s]*[:=]["'\s]*[a-zA-Z0-9_-]{20,})""",
    r"""(sk-[a-zA-Z0-9_-]{20,})""",
    r"""(AIza[a-zA-Z0-9_-]{35})""",
    r"""(password["'\s]*[:=]["'\s]*[^\s]{8,})""",
    r"""(pwd["'\s]*[:=]["'\s]*[^\s]{6,})""",
    r"""(token["'\s]*[:=]["'\s]*[a-zA-Z0-9_-]{20,})""",
    r"""(bearer["'\s]+[a-zA-Z0-9_-]{20,})""",
    r"""(mongodb://[^\s]+)""",
    r"""(postgresql://[^\s]+)""",
    r"""(mysql://[^\s]+)""",
    r"""(AKIA[0-9A-Z]{16})""",
    r"""-----BEGIN [A-Z]+ KEY-----""",
    r"""-----BEGIN PRIVATE KEY-----""",
)

# Text that every match of the patterns above holds, lower-cased. Cheap to look for, so that the
# regex chain only runs on texts that may change.
_MARKERS = (
    "key", "sk-", "aiza", "password", "pwd", "token", "bearer",
    "mongodb://", "sql://", "akia",
)

# The four characters that fold to an ASCII letter without being one: long s, Kelvin sign,
# dotless i and dotted capital I.
_FOLDED, _ASCII = "\u017f\u212a\u0131\u0130", "skii"


def may_hold_secret(text: Column) -> Column:
    # Almost no text holds one of the four odd characters, and translate() is slow.
    odd = F.lit(False)
    for char in _FOLDED:
        odd = odd | F.contains(text, F.lit(char))
    plain = F.lower(F.when(odd, F.translate(text, _FOLDED, _ASCII)).otherwise(text))
    test = F.lit(False)
    for marker in _MARKERS:
        test = test | F.contains(plain, F.lit(marker))
    return test


def redact(text: Column) -> Column:
    """Every secret replaced by ``[REDACTED]``. Apply to joined snippets: secrets span lines."""
    out = text
    for pattern in SECRET_PATTERNS:
        out = F.regexp_replace(out, "(?iU)" + pattern, REDACTED)
    return F.when(may_hold_secret(text), out).otherwise(text)
