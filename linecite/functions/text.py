"""Small text helpers: decoding, trimming, key points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace as Python's ``str.strip`` sees it: Unicode white space plus U+001C..U+001F.
_SPACE = r"[\s\x1C-\x1F]"


def decode_utf8(content: Column) -> Column:
    """Bytes to text: ill-formed sequences become U+FFFD, CR LF and CR become LF."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(
        text
    )


def rstrip(text: Column) -> Column:
    # Possessive, and anchored behind a non-space, so that long inner runs cost linear time.
    return F.regexp_replace(text, rf"(?U)(?<!{_SPACE}){_SPACE}++\z", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(rstrip(text), rf"(?U)\A{_SPACE}++", "")


def key_point(snippet: Column) -> Column:
    """First line of a snippet, stripped."""
    return strip(F.substring_index(snippet, "\n", 1))
