"""Reports as rows ``seq bigint, text string``: one block of lines per row, in ``seq`` order.

Rows rather than one string, so a report over large snippets never has to fit in one value. Match
blocks are numbered by ranges of the result order, so any number of matches can be reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecite.functions.text import rstrip
from linecite.operators.answer import answer_text
from linecite.operators.coverage import with_confidence
from linecite.operators.matching import result_order
from linecite.operators.topn import beside, numbered
from linecite.settings import REPORTED_SKIPS

_FENCE = "```"
#: ``seq`` of the coverage block; match blocks are numbered from 1 and never reach it.
COVERAGE_SEQ = 1_000_000_000_000_000


def _lines(*parts: Column | str) -> Column:
    """Join the parts with line feeds; null parts are left out."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _bullets(items: Column, before: str = "- ", after: str = "") -> Column:
    """One bullet per item, or null without items."""
    text = F.array_join(
        F.transform(items, lambda i: F.concat(F.lit(before), i, F.lit(after))), "\n"
    )
    return F.when(F.size(items) > 0, text)


def coverage_section(summary: DataFrame) -> Column:
    """The coverage report of a summary row."""
    limits = F.transform(
        F.map_entries("limits_applied"),
        lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")),
    )
    skipped, more = F.col("skipped_total"), F.col("skipped_total") - REPORTED_SKIPS
    errors, further = F.col("errors_total"), F.col("errors_total") - F.size("errors")

    def titled(title: str, total: Column) -> Column:
        return F.when(
            total > 0, F.concat(F.lit(f"**{title}:** ("), total.cast("string"), F.lit(" total)"))
        )

    return _lines(
        "### Coverage Report",
        "**Search Scope:**",
        _bullets(F.col("roots"), "- Root: `", "`"),
        _bullets(F.col("globs"), "- Pattern: `", "`"),
        "**Statistics:**",
        F.concat(F.lit("- Files scanned: "), F.format_number("scanned_files", 0)),
        F.concat(F.lit("- Files with matches: "), F.format_number("matched_files", 0)),
        F.when(F.size(limits) > 0, F.lit("**Limits Applied:**")),
        _bullets(limits),
        titled("Skipped Files", skipped),
        _bullets(F.slice("skipped_files", 1, REPORTED_SKIPS)),
        F.when(more > 0, F.concat(F.lit("- ... and "), more.cast("string"), F.lit(" more"))),
        titled("Errors", errors),
        _bullets(F.col("errors")),
        F.when(further > 0, F.concat(F.lit("- ... and "), further.cast("string"), F.lit(" more"))),
    )


def _match_blocks(matches: DataFrame) -> DataFrame:
    return numbered(matches, result_order(), "seq").select(
        "seq",
        _lines(
            F.concat(
                F.lit("**"),
                F.col("seq").cast("string"),
                F.lit(".** `"),
                "file_path",
                F.lit(":"),
                "location",
                F.lit("`"),
            ),
            _FENCE,
            rstrip(F.col("snippet")),
            _FENCE,
            "",
        ).alias("text"),
    )


def _frame(summary: DataFrame, header: Column) -> DataFrame:
    """Header, coverage and confidence: three blocks from the one row of the summary."""
    graded = with_confidence(summary)
    confidence = _lines(F.concat(F.lit("### Confidence: "), "confidence"), F.col("reason"))
    blocks = [(0, header), (COVERAGE_SEQ, coverage_section(graded)), (COVERAGE_SEQ + 1, confidence)]
    return graded.select(
        F.inline(F.array(*[F.struct(F.lit(n).cast("bigint").alias("seq"), t.alias("text")) for n, t in blocks]))
    )


def search_report(query: str, matches: DataFrame, summary: DataFrame) -> DataFrame:
    """Header, matches, coverage, confidence."""
    total = F.col("total_matches")
    header = _lines(
        "## Search Results",
        f"**Query:** {query}",
        F.concat(F.lit("**Found:** "), total.cast("string"), F.lit(" matches")),
        F.when(F.col("truncated"), F.lit("**Warning:** Results truncated due to limits")),
        "",
        F.when(total > 0, F.lit("### Matches")).otherwise(F.lit("### No matches found\n")),
    )
    return _frame(summary, header).unionByName(_match_blocks(matches))


def ask_report(question: str, points: DataFrame, matches: DataFrame, summary: DataFrame) -> DataFrame:
    """The answer first, then citations, coverage, confidence."""
    header = _lines(
        "## Answer",
        answer_text(question),
        "",
        F.when(F.col("total_matches") > 0, F.lit("### Citations")).otherwise(F.lit("### No sources found\n")),
    )
    return _frame(beside(summary, points), header).unionByName(_match_blocks(matches))


def sources_report(summary: DataFrame) -> DataFrame:
    """The coverage report of the last search; no row without one."""
    return summary.select(
        F.lit(0).cast("bigint").alias("seq"),
        _lines("## Last Search Coverage", "", coverage_section(summary)).alias("text"),
    )


def write_report(report: DataFrame, path: str) -> None:
    """Write the blocks as text, in order over the numbered part files."""
    report.orderBy("seq").select("text").write.mode("overwrite").text(path)
