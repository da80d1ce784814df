"""Text to numbered lines, and context snippets around a line.

Everything works on one array column per document, so context never needs a window (and hence a
shuffle of every line), and documents are never copied once per line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The line terminators, "\r\n" counting as one.
LINE_FEED = "\n"
OTHER_TERMINATORS = ("\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")

#: Hits whose snippets are cut together.
BLOCK_HITS = 256

TERMINATOR_REGEX = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\x{2028}\x{2029}]"


def has_terminator(literal: str) -> bool:
    return any(t in literal for t in (LINE_FEED, *OTHER_TERMINATORS))


def _pieces(text: Column) -> Column:
    # Splitting on one plain character skips the regex engine and is several times faster, so the
    # full pattern only runs on texts that hold a rarer terminator.
    rare = F.contains(text, F.lit(OTHER_TERMINATORS[0]))
    for terminator in OTHER_TERMINATORS[1:]:
        rare = rare | F.contains(text, F.lit(terminator))
    return F.when(rare, F.split(text, TERMINATOR_REGEX, -1)).otherwise(
        F.split(text, LINE_FEED, -1)
    )


def with_lines(df: DataFrame, text: str = "text", lines: str = "lines") -> DataFrame:
    """Add ``lines array<string>``; a terminator at the very end opens no further line."""
    df = df.withColumn(lines, _pieces(F.col(text)))
    pieces = F.col(lines)
    return df.withColumn(
        lines,
        F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(
            pieces
        ),
    )


def snippet(lines: Column, line_number: Column, context_lines: int, first_line: Column | int = 1) -> Column:
    """Lines ``[n - c, n + c]``, clipped to the text, joined by line feeds.

    ``lines`` begin with line ``first_line``.
    """
    first_line = F.lit(first_line) if isinstance(first_line, int) else first_line
    first = F.greatest(first_line, line_number - context_lines)
    last = F.least(first_line + F.size(lines) - 1, line_number + context_lines)
    # A negative context selects nothing.
    count = F.greatest(F.lit(0), last - first + 1)
    return F.array_join(F.slice(lines, first - first_line + 1, count), LINE_FEED)


def hit_numbers(lines: Column, matches: Callable[[Column], Column]) -> Column:
    """``array<int>`` of the numbers of the matching lines."""

    def number(line: Column, index: Column) -> Column:
        return F.when(matches(line), (index + 1).cast("int"))

    return F.array_compact(F.transform(lines, number))


def explode_hits(
    df: DataFrame, matches: Callable[[Column], Column], context_lines: int, lines: str = "lines"
) -> DataFrame:
    """One row per matching line: the other columns, ``n_hits``, ``place`` (0-based), ``line_number``
    and ``snippet``.

    Hits leave their text in runs of ``BLOCK_HITS``, each with the lines that its snippets need and no
    others. All runs together hold the text about once, so exploding them does not copy the text per
    hit, and no row holds more than the snippets of one run.
    """
    return explode_runs(hit_runs(df, matches, context_lines, lines), context_lines)


def hit_runs(
    df: DataFrame,
    matches: Callable[[Column], Column],
    context_lines: int,
    lines: str = "lines",
    around: tuple[str, str] | None = None,
    outer: bool = False,
) -> DataFrame:
    """One row per run of hits: the other columns, ``n_hits`` and ``run``. With ``outer``, a row of a null
    run for texts without hits.

    ``around`` names arrays of lines before and after ``lines``, which snippets show and which are
    neither hits nor counted by ``line_number``.
    """
    keep = [c for c in df.columns if c not in (lines, *(around or ()))]
    reach = max(context_lines, 0)
    own, every, ahead = hit_numbers(F.col(lines), matches), F.col(lines), F.lit(0)
    if around is not None:
        ahead = F.size(around[0])
        own = F.transform(own, lambda n: n + ahead)
        every = F.concat(F.col(around[0]), F.col(lines), F.col(around[1]))
    numbered = df.select(*keep, every.alias("_lines"), own.alias("_hits"), ahead.alias("_ahead"))
    places = f"sequence(0, size(_hits) - 1, {BLOCK_HITS})"
    first = f"greatest(1, _hits[p] - {reach})"
    last = f"least(size(_lines), _hits[least(p + {BLOCK_HITS}, size(_hits)) - 1] + {reach})"
    run = f"""named_struct(
        'place', p, 'ahead', _ahead, 'hits', slice(_hits, p + 1, {BLOCK_HITS}),
        'first_line', {first}, 'lines', slice(_lines, {first}, {last} - {first} + 1))"""
    runs = F.expr(f"CASE WHEN size(_hits) > 0 THEN transform({places}, p -> {run}) END")
    return numbered.select(
        *keep, F.size("_hits").alias("n_hits"), (F.explode_outer if outer else F.explode)(runs).alias("run")
    )


def explode_runs(runs: DataFrame, context_lines: int) -> DataFrame:
    """The hits of ``hit_runs``, a row each: ``place``, ``line_number`` and ``snippet`` instead of ``run``."""
    keep = [c for c in runs.columns if c != "run"]
    hits = F.transform(
        "run.hits",
        lambda n: F.struct(
            (n - F.col("run.ahead")).alias("line_number"),
            snippet(F.col("run.lines"), n, context_lines, F.col("run.first_line")).alias("snippet"),
        ),
    )
    return runs.select(*keep, F.col("run.place").alias("_place"), F.posexplode(hits).alias("_pos", "_hit")).select(
        *keep, F.expr("_place + _pos").alias("place"), "_hit.line_number", "_hit.snippet"
    )


def hit_count(lines: Column, matches: Callable[[Column], Column]) -> Column:
    """How many lines match, without building snippets."""
    return F.size(F.filter(lines, matches)).cast("bigint")


def explode_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line: the other columns, ``line_number`` (1-based) and ``line``."""
    keep = [c for c in df.columns if c != text]
    # Outer, then filtered: for a plain explode the optimizer adds a test that the array is not
    # empty below it, which splits every text a second time.
    return (
        with_lines(df.select(*keep, text), text)
        .select(*keep, F.posexplode_outer("lines").alias("_pos", "line"))
        .where(F.col("_pos").isNotNull())
        .select(*keep, (F.col("_pos") + 1).cast("int").alias("line_number"), "line")
    )
