"""Path expressions: extension, kind, glob selection, root allowlist, display form."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from linecite.settings import PLAIN_EXTENSIONS, SUPPORTED_EXTENSIONS


def extension(path: Column) -> Column:
    """Lower-cased last suffix with its dot, or the empty string."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def kind(ext: Column) -> Column:
    """``text``, ``docx``, ``pdf``, or null for a type that is not searched."""
    return (
        F.when(ext.isin(*PLAIN_EXTENSIONS), F.lit("text"))
        .when(ext == ".docx", F.lit("docx"))
        .when(ext == ".pdf", F.lit("pdf"))
    )


def is_supported(ext: Column) -> Column:
    return ext.isin(*SUPPORTED_EXTENSIONS)


def location(kind_: Column, line_number: Column) -> Column:
    """The cited location: a bare line number, or ``paragraph N`` / ``page N``."""
    number = line_number.cast("string")
    return (
        F.when(kind_ == "docx", F.concat(F.lit("paragraph "), number))
        .when(kind_ == "pdf", F.concat(F.lit("page "), number))
        .otherwise(number)
    )


def skip_reason(ext: Column, length: Column, max_file_bytes: int | None) -> Column:
    """``too_large`` (tested first), ``unsupported``, or null for a file to search."""
    reason = F.when(~is_supported(ext), F.lit("unsupported"))
    if max_file_bytes is None:
        return reason
    return F.when(length > max_file_bytes, F.lit("too_large")).otherwise(reason)


def skip_message(reason: Column, path: Column) -> Column:
    return F.when(reason == "too_large", F.concat(F.lit("File too large: "), path)).when(
        reason == "unsupported", F.concat(F.lit("Unsupported file type: "), path)
    )


def size_is_safe(length: Column, max_bytes: int) -> Column:
    return length <= max_bytes


def _segment_regex(segment: str) -> str:
    """One glob path segment as a regex that never crosses a slash."""
    if segment == "*":
        return "[^/]+"
    out, i = [], 0
    while i < len(segment):
        char = segment[i]
        # A bracket set needs at least one member, so a "]" right after the opening is a member.
        closing = segment.find("]", i + (3 if segment[i + 1 : i + 2] == "!" else 2))
        if char == "*":
            out.append("[^/]*")
        elif char == "?":
            out.append("[^/]")
        elif char == "[" and closing > 0:
            body = segment[i + 1 : closing]
            negate = body.startswith("!")
            members = re.sub(r"([\\\[\]^&~|])", r"\\\1", body[1:] if negate else body)
            out.append(f"(?!/)[{'^' if negate else ''}{members}]")
            i = closing
        else:
            out.append(re.escape(char))
        i += 1
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """Anchored regex over the path below the root; a pattern applies at any depth."""
    pattern = pattern.strip()
    if not pattern or pattern.startswith("/"):
        raise ValueError(f"Unacceptable glob pattern: {pattern!r}")
    segments = [s for s in pattern.split("/") if s != "."]
    out = "(?:[^/]+/)*"
    for index, segment in enumerate(segments):
        last = index == len(segments) - 1
        if segment == "**":
            out += "(?:[^/]+/)*[^/]+" if last else "(?:[^/]+/)*"
        else:
            out += _segment_regex(segment) + ("" if last else "/")
    return rf"(?s)\A{out}\z"


_SELECT_ALL = ("*", "**", "**/*", "**/**")


def split_globs(globs: str) -> list[str]:
    """A comma-separated list, each pattern stripped."""
    return [g.strip() for g in globs.split(",")]


def matching_globs(root: Column, path: Column, globs: Sequence[str]) -> Column:
    """``array<int>`` of the 0-based indexes of the patterns that select the path.

    The patterns are driver-side constants, so this is a handful of regex tests per path rather
    than a join with a table of patterns, and none for patterns that select everything. A path
    selected twice keeps both indexes.
    """
    below = F.substr(path, F.length(root) + 2)
    patterns = [glob_regex(g) for g in globs]
    if all(g.strip() in _SELECT_ALL for g in globs):
        return F.array(*[F.lit(index) for index in range(len(globs))])
    tests = [
        F.lit(index)
        if globs[index].strip() in _SELECT_ALL
        else F.when(below.rlike(pattern), F.lit(index))
        for index, pattern in enumerate(patterns)
    ]
    return F.array_compact(F.array(*tests))


def is_root_allowed(root: Column, allowed: Sequence[str]) -> Column:
    """No allowlist allows every root; otherwise the root must be, or lie below, an entry."""
    if not allowed:
        return F.lit(True)
    test = F.lit(False)
    for entry in allowed:
        base = entry.rstrip("/")
        test = test | (root == (base or "/")) | F.startswith(root, F.lit(base + "/"))
    return test


def is_below_any(path: Column, bases: Sequence[str]) -> Column:
    """True for paths that begin with one of the bases and a slash; a scan can prune by it."""
    test = F.lit(False)
    for base in bases:
        test = test | F.startswith(path, F.lit(base.rstrip("/") + "/"))
    return test


def display_path(path: Column, base: str) -> Column:
    """The path without a leading ``base`` and the slashes that follow it."""
    rest = F.regexp_replace(F.substr(path, F.lit(len(base) + 1)), r"\A[/\\]+", "")
    return F.when(F.startswith(path, F.lit(base)), rest).otherwise(path)


def estimated_memory(files: Column, average_bytes: int | Column = 1024 * 1024) -> Column:
    """Rough working-set estimate: every file plus 1 KiB of overhead."""
    average = average_bytes if isinstance(average_bytes, Column) else F.lit(average_bytes)
    return files * (average + 1024)
