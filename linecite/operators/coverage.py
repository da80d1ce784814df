"""Coverage: what was scanned, matched and skipped, and how far to trust it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecite.functions import paths
from linecite.functions.predicates import LineMatcher
from linecite.operators.listing import Listing
from linecite.operators.matching import Cut, with_hit_counts
from linecite.operators.topn import beside, first_rows, stored
from linecite.settings import REPORTED_SKIPS, Limits


def skip_order() -> list[Column]:
    """Listing skips by pattern, then skips met while scanning, which goes by path."""
    return [
        F.col("phase"),
        F.when(F.col("phase") < 2, F.col("pattern_idx")),
        F.col("path"),
        F.col("pattern_idx"),
    ]


def limits_applied(limits: Limits, context_lines: int | None = None) -> Column:
    """``map<string,int>`` in the order max_files, max_matches, context_lines."""
    values = {"max_files": limits.max_files}
    if context_lines is not None:
        values |= {"max_matches": limits.max_matches, "context_lines": context_lines}
    pairs = [F.lit(x) for item in values.items() if item[1] is not None for x in item]
    return F.create_map(*pairs).cast("map<string,int>")


def match_counts(matches: DataFrame, max_matches: int | None) -> DataFrame:
    """One row: total matches, truncation, matched occurrences and distinct files."""
    total = F.count(F.lit(1))
    first = F.col("opens_file")
    return matches.agg(
        total.alias("total_matches"),
        (F.lit(False) if max_matches is None else total >= max_matches).alias("truncated"),
        F.count_if(first).alias("matched_files"),
        # The scan order visits occurrence 1 of a file first, so it is there if any is.
        F.count_if(first & (F.col("occurrence") == 1)).alias("cited_files"),
    )


def _facts(corpus: DataFrame, matcher: LineMatcher, cut: Cut | None) -> DataFrame:
    """Counts and messages of each row of ``corpus``, in one pass over texts. Row-local."""
    names = ["path", "patterns", "reason", "refusal", "error"]
    text = ["n_hits"] if "n_hits" in corpus.columns else ["text"]
    counted = with_hit_counts(corpus.select(*names, *text), matcher)
    times = F.size("patterns").cast("bigint")
    searched = F.col("reason").isNull()
    matches = F.col("n_hits") * times
    occurrences, reached = times, F.lit(True)
    if cut is not None:
        at, reached = F.col("path") == F.lit(cut.path), F.col("path") < F.lit(cut.path)
        matches = F.when(reached, matches).when(at, F.lit(cut.rest))
        occurrences = F.when(reached, times).when(at, F.ceil(F.lit(cut.rest) / F.col("n_hits")))
    hit = F.col("n_hits") > 0
    unread = F.col("error").isNotNull() & searched & reached
    message = (
        F.when(F.col("refusal").isNotNull(), F.col("refusal"))
        .when(~searched & (times > 0), paths.skip_message(F.col("reason"), F.col("path")))
        .when(unread & (times > 0), F.col("error"))
    )

    def number(value: Column, when: Column) -> Column:
        return F.coalesce(F.when(when, value), F.lit(0)).cast("bigint")

    return counted.select(
        number(times, searched).alias("scanned_files"),
        number(times, ~searched | unread).alias("skipped_total"),
        F.col("refusal").isNotNull().cast("bigint").alias("errors_total"),
        number(matches, hit & searched).alias("total_matches"),
        number(occurrences, hit & searched).alias("matched_files"),
        number(F.lit(1), hit & searched & (occurrences > 0)).alias("cited_files"),
        F.when(message.isNotNull(), F.struct(
            F.col("refusal").isNotNull().alias("refused"), F.when(searched, F.lit(2)).otherwise(F.lit(0)).alias("phase"),
            "path", "patterns", message.alias("message"),
        )).alias("said"),
    )


_COUNTS = ["scanned_files", "skipped_total", "errors_total", "total_matches", "matched_files", "cited_files"]


def coverage_summary(
    corpus: DataFrame,
    listing: Listing,
    matcher: LineMatcher,
    cut: Cut | None,
    roots: Sequence[str],
    context_lines: int,
) -> DataFrame:
    """The one-row coverage report, from one pass over ``corpus``.

    The pass leaves a row for each message, and one for each task that counts all else together;
    these rows are stored, and the report is made of them. ``skipped_files`` and ``errors`` hold the
    first ten messages and ``*_total`` the full counts: messages can be as many as files.
    """
    told = stored(
        _facts(corpus, matcher, cut).groupBy("said").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    )
    none = F.lit(0).cast("bigint")
    totals = told.agg(*[F.coalesce(F.sum(c), none).alias(c) for c in _COUNTS])
    messages = told.where(F.col("said").isNotNull()).select("said.*").select(
        "refused", "phase", F.explode("patterns").alias("pattern_idx"), "path", "message"
    )
    refused = told.where("said.refused").select(
        F.lit(True).alias("refused"), F.lit(0).alias("phase"), F.lit(0).alias("pattern_idx"), "said.path", "said.message"
    )
    notice = listing.limit_notice()
    if notice is not None:
        messages = messages.unionByName(
            notice.select(F.lit(False).alias("refused"), "phase", "pattern_idx", "path", "message")
        )
    first = first_rows(messages.unionByName(refused), skip_order(), REPORTED_SKIPS, ["refused"])
    keys = [key.alias(f"k{i}") for i, key in enumerate(skip_order())]
    entries = F.struct(*keys, "message")

    def in_order(chosen: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(chosen, entries))), lambda e: e["message"])

    shown = first.agg(
        in_order(~F.col("refused")).alias("skipped_files"), in_order(F.col("refused")).alias("errors")
    )
    limits = listing.limits
    total, scanned = F.col("total_matches"), F.col("scanned_files")
    return beside(totals, shown).select(
        F.array(*[F.lit(r) for r in roots]).cast("array<string>").alias("roots"),
        F.array(*[F.lit(g) for g in listing.globs]).cast("array<string>").alias("globs"),
        "scanned_files",
        (F.lit(False) if limits.max_files is None else scanned >= limits.max_files).alias("files_truncated"),
        "matched_files",
        "cited_files",
        "total_matches",
        (F.lit(False) if limits.max_matches is None else total >= limits.max_matches).alias("truncated"),
        (F.col("skipped_total") + int(notice is not None)).alias("skipped_total"),
        "skipped_files",
        "errors_total",
        "errors",
        limits_applied(limits, context_lines).alias("limits_applied"),
    )


def density(matched: Column, scanned: Column) -> Column:
    return matched / F.greatest(scanned, F.lit(1))


# The least number of matches and the least density of each grade.
HIGH = (10, 0.1)
MEDIUM = (3, 0.05)


def confidence_level(total: Column, matched: Column, scanned: Column) -> Column:
    share = density(matched, scanned)
    return (
        F.when((total >= HIGH[0]) & (share >= HIGH[1]), F.lit("high"))
        .when((total >= MEDIUM[0]) & (share >= MEDIUM[1]), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def confidence_reason(total: Column, matched: Column, scanned: Column) -> Column:
    level = confidence_level(total, matched, scanned)
    return (
        F.when(total == 0, F.lit("No matches found for the query"))
        .when(
            level == "low",
            F.concat(F.lit("Only "), total, F.lit(" matches found, results may be limited")),
        )
        .otherwise(
            F.concat(F.lit("Found "), total, F.lit(" matches across "), matched, F.lit(" files"))
        )
    )


def with_confidence(summary: DataFrame) -> DataFrame:
    """Add ``confidence`` and ``reason`` to rows of match, matched-file and scanned counts."""
    counts = F.col("total_matches"), F.col("matched_files"), F.col("scanned_files")
    return summary.withColumn("confidence", confidence_level(*counts)).withColumn(
        "reason", confidence_reason(*counts)
    )


def confidence_by_root(files: DataFrame, matcher: LineMatcher) -> DataFrame:
    """Counts and grade per root, over whole texts.

    Hits are counted inside each row, so only one row per root and task is shuffled, however many
    files a root has.
    """
    counted = with_hit_counts(files.select("root", "patterns", "text"), matcher).select(
        "root", F.col("n_hits").alias("hits"), F.size("patterns").cast("bigint").alias("times")
    )
    return with_confidence(
        counted.groupBy("root").agg(
            F.sum(F.col("hits") * F.col("times")).alias("total_matches"),
            F.sum(F.when(F.col("hits") > 0, F.col("times")).otherwise(0)).alias("matched_files"),
            F.sum("times").alias("scanned_files"),
        )
    )
