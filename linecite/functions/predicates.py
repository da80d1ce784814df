"""Line predicates: literal or regular expression, with or without case."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from linecite.functions.lines import has_terminator

# The few spellings that differ between the two regex dialects, outside and inside a bracket set.
_TOKEN = re.compile(
    r"""\\0[0-7]{0,2}            # octal escape
      | \\U[0-9a-fA-F]{8}        # long code point escape
      | \\Z | \\v | \\.          # other escapes, one token each
      | \(\?P<\w+> | \(\?P=\w+\) # named group and its back reference
      | \(\?\#[^)]*\)            # comment
      | \{\d*,?\d*\} | \{        # quantifier, or a plain brace
      | \[\^?\]? | \] | && | .
    """,
    re.VERBOSE | re.DOTALL,
)


def _group_name(name: str) -> str:
    """Java group names hold letters and digits only."""
    return "g" + "".join(c if c.isascii() and c.isalnum() else f"x{ord(c):x}" for c in name)


def _token_outside(token: str) -> str:
    if token == r"\Z":
        return r"\z"
    if token.startswith("(?P<"):
        return f"(?<{_group_name(token[4:-1])}>"
    if token.startswith("(?P="):
        return rf"\k<{_group_name(token[4:-1])}>"
    if token.startswith("(?#"):
        return ""
    if token.startswith("{"):
        if re.fullmatch(r"\{\d+(,\d*)?\}", token):
            return token
        if re.fullmatch(r"\{,\d+\}", token):
            return "{0" + token[1:]
        if token == "{,}":
            return "{0,}"
        return "".join("\\" + c if c in "{}" else c for c in token)
    return token


def java_regex(pattern: str) -> str:
    """A Python regular expression spelled for Spark. Raises ``re.error`` on a bad pattern."""
    re.compile(pattern)
    out, in_set = [], False
    for token in _TOKEN.findall(pattern):
        if re.fullmatch(r"\\0[0-7]*", token):
            token = rf"\x{{{int(token[1:], 8):x}}}"
        elif re.fullmatch(r"\\U[0-9a-fA-F]{8}", token):
            token = rf"\x{{{token[2:]}}}"
        elif token == r"\v":
            token = r"\x0B"
        elif in_set:
            if token == "]":
                in_set = False
            elif token == "&&":
                token = r"\&\&"
            elif token.startswith("["):
                # "[" is an ordinary member; what else the token took in is looked at again.
                rest = token[1:]
                in_set = not rest.endswith("]")
                token = r"\[" + rest
            elif token.startswith("(?P") or token.startswith("(?#"):
                raise re.error(f"unsupported member of a bracket set: {token}", pattern)
        elif token.startswith("["):
            in_set = True
            # A "]" right after the opening is a member.
            token = token.replace("]", r"\]")
        else:
            token = _token_outside(token)
        out.append(token)
    return "".join(out)


# Patterns built from these pieces alone hold no assertion, and nothing in them but a literal can
# run across a line feed: plain characters, ".", alternatives, plain groups, sets of plain
# characters, and quantifiers that may backtrack.
_WITHIN_LINES = re.compile(
    r"""(?: [^\\^$()\[\]{}*+?|]
          | \\[dw] | \\[^\w\s]
          | \| | \((?:\?:|(?!\?)) | \)
          | \[(?!\^)(?:[^\\\[\]&]|\\[dw]|\\[^\w\s])+\]
          | (?:[*+?]|\{\d+(?:,\d*)?\})\??(?!\+)
        )+""",
    re.VERBOSE,
)


def stays_within_lines(pattern: str) -> bool:
    return _WITHIN_LINES.fullmatch(pattern) is not None


@dataclass(frozen=True)
class LineMatcher:
    """What to look for in each line."""

    query: str
    case_sensitive: bool = False
    regex: bool = False

    def pattern(self) -> str:
        """The Spark regex: Unicode classes always, Unicode case folding unless case matters."""
        return ("(?U)" if self.case_sensitive else "(?iU)") + java_regex(self.query)

    def line(self, line: Column) -> Column:
        if self.regex:
            return line.rlike(self.pattern())
        if self.case_sensitive:
            return F.contains(line, F.lit(self.query))
        return F.contains(F.lower(line), F.lower(F.lit(self.query)))

    def document(self, text: Column) -> Column:
        """A test on the whole text that every text with a matching line passes.

        It spares texts without a match the splitting. Anchors and look-around mean something else
        on a whole text, and negated sets could run over all of it from every position, so regexes
        with any of them are tested line by line only.
        """
        if self.regex:
            return self.line(text) if stays_within_lines(self.query) else F.lit(True)
        if has_terminator(self.query):
            return F.lit(False)
        return self.line(text)


def check_regex(spark, matcher: LineMatcher) -> None:
    """Fail on a bad pattern now rather than in a task. Constant-folded, so it runs no job."""
    if matcher.regex:
        pattern = matcher.pattern()
        spark.sql("SELECT '' RLIKE :pattern AS ok", args={"pattern": pattern}).collect()
