"""Which files a search covers: glob selection, size and type checks, the file limit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecite.functions import paths
from linecite.operators.topn import cut_row
from linecite.settings import Limits


@dataclass(frozen=True)
class Listing:
    """The outcome of listing a corpus.

    ``every``: the rows of the corpus plus ``ext``, ``kind``, ``refusal`` (why a row is an error: its root
    is not allowed, or it is a folder that cannot be read), ``reason`` (null for a file to search) and ``patterns``, the 0-based indexes of the globs
    that selected it, empty for what was not; a file selected twice counts twice. ``last_path``: no file
    behind it was selected. ``limit_pattern``: the glob under which the file limit passed over further
    paths.
    """

    every: DataFrame
    globs: tuple[str, ...]
    limits: Limits
    last_path: str | None = None
    limit_pattern: int | None = None
    allowed_roots: tuple[str, ...] = ()

    @property
    def rows(self) -> DataFrame:
        """Selected files, those that are skipped included."""
        selected = self.pruned(self.every)
        return selected.where(F.col("refusal").isNull()).where(F.size("patterns") > 0).drop("refusal")

    def pruned(self, rows: DataFrame) -> DataFrame:
        """``rows`` without some that are not selected.

        Says no more than ``refusal`` and ``patterns`` do, in a form that reaches the scan: a table
        stored in path order is read below the allowed roots only, and up to the last path.
        """
        if self.last_path is not None:
            rows = rows.where(F.col("path") <= F.lit(self.last_path))
        if self.allowed_roots:
            rows = rows.where(paths.is_below_any(F.col("path"), self.allowed_roots))
        return rows

    @property
    def errors(self) -> DataFrame:
        """``path, message`` of rows under a root that is not allowed, and of unreadable folders."""
        return self.every.where(F.col("refusal").isNotNull()).select("path", F.col("refusal").alias("message"))

    @property
    def files(self) -> DataFrame:
        """The files to search."""
        return self.rows.where(F.col("reason").isNull()).drop("reason")

    @property
    def skips(self) -> DataFrame:
        """``phase, pattern_idx, path, reason, message`` of everything passed over."""
        skips = self.rows.where(F.col("reason").isNotNull()).select(
            F.lit(0).alias("phase"),
            F.explode("patterns").alias("pattern_idx"),
            "path",
            "reason",
            paths.skip_message(F.col("reason"), F.col("path")).alias("message"),
        )
        notice = self.limit_notice()
        return skips if notice is None else skips.unionByName(notice)

    def limit_notice(self) -> DataFrame | None:
        """The skip row that says that the file limit passed over further paths."""
        if self.limit_pattern is None:
            return None
        return self.every.sparkSession.range(1).select(
            F.lit(1).alias("phase"),
            F.lit(self.limit_pattern).alias("pattern_idx"),
            F.lit("").alias("path"),
            F.lit("max_files").alias("reason"),
            F.lit(f"Reached max_files limit ({self.limits.max_files})").alias("message"),
        )

    def occurrences(self) -> DataFrame:
        """One row per listed (pattern, path), duplicates kept."""
        return self.files.select(
            "root",
            "path",
            "ext",
            "length",
            F.posexplode("patterns").alias("_pos", "pattern_idx"),
        ).select(
            "root",
            "path",
            "ext",
            "length",
            "pattern_idx",
            (F.col("_pos") + 1).cast("bigint").alias("occurrence"),
        )

    def counts(self) -> DataFrame:
        """One row from one scan of names: ``scanned_files, files_truncated, files_skipped``."""
        times = F.size("patterns").cast("bigint")
        searched = F.col("reason").isNull()
        scanned = F.sum(F.when(searched, times).otherwise(0)).cast("bigint")
        scanned = F.coalesce(scanned, F.lit(0).cast("bigint"))
        skipped = F.coalesce(F.sum(F.when(~searched, times)), F.lit(0).cast("bigint"))
        limit = self.limits.max_files
        return self.rows.agg(
            scanned.alias("scanned_files"),
            (F.lit(False) if limit is None else scanned >= limit).alias("files_truncated"),
            (skipped + int(self.limit_pattern is not None)).alias("files_skipped"),
        )


def classify(candidates: DataFrame, globs: Sequence[str], limits: Limits) -> DataFrame:
    """Add ``ext``, ``kind``, ``reason`` (null: to be searched) and ``patterns``. Row-local."""
    named = candidates.withColumn("ext", paths.extension(F.col("path")))
    reason = paths.skip_reason(F.col("ext"), F.col("length"), limits.max_file_bytes)
    return named.withColumns(
        {
            "kind": paths.kind(F.col("ext")),
            "reason": reason,
            "patterns": paths.matching_globs(F.col("root"), F.col("path"), globs),
        }
    )


def list_corpus(
    corpus: DataFrame,
    globs: Sequence[str] | None = None,
    limits: Limits | None = None,
    allowed_roots: Sequence[str] = (),
) -> Listing:
    """List a corpus with columns ``root, path, length`` (more columns are kept).

    ``path`` is unique and lies below ``root``. A boolean column ``is_file``, if there is one,
    marks the rows that are not directories, and a column ``unlisted`` says why a folder could not be
    read.
    """
    globs = tuple(globs or ("*",))
    limits = limits or Limits()
    allowed = F.coalesce(paths.is_root_allowed(F.col("root"), allowed_roots), F.lit(False))
    message = F.concat(F.lit("Root directory not allowed: "), F.coalesce("root", F.lit("")))
    refusal = F.when(~allowed, message)
    if "unlisted" in corpus.columns:
        refusal = F.coalesce(refusal, F.col("unlisted"))
    chosen = classify(corpus, globs, limits).withColumn("refusal", refusal).drop("unlisted")
    is_file = F.col("is_file") if "is_file" in corpus.columns else F.lit(True)
    counted = F.when(is_file & F.col("refusal").isNull(), F.col("patterns"))
    every = chosen.withColumn("patterns", F.coalesce(counted, F.array().cast("array<int>")))
    listing = Listing(every, globs, limits, allowed_roots=tuple(allowed_roots))
    if limits.max_files is None:
        return listing
    return _limit_files(chosen.where(F.col("refusal").isNull()), listing, limits.max_files)


def _limit_files(chosen: DataFrame, listing: Listing, max_files: int) -> Listing:
    """Keep the first ``max_files`` occurrences in (pattern, path) order.

    Names only are looked at to find the last kept occurrence, a single row. Comparing with that
    constant then cuts files in place, so no text is shuffled, and a scan of a table stored in path
    order skips everything behind the cut.
    """
    keys = listing.files.select(F.explode("patterns").alias("pattern_idx"), "path", F.lit(1).alias("one"))
    cut = cut_row(keys, ["pattern_idx", "path"], "one", max_files)
    if cut is None:
        return listing
    cut_pattern, cut_path = cut[0]["pattern_idx"], cut[0]["path"]
    inside = F.col("path") <= F.lit(cut_path)

    def kept_under(pattern: Column) -> Column:
        return (pattern < cut_pattern) | ((pattern == cut_pattern) & inside)

    # One further path, of any type, under the pattern that was being listed draws a notice.
    further = chosen.where(F.array_contains("patterns", cut_pattern) & ~inside)
    return replace(
        listing,
        every=listing.every.withColumn("patterns", F.filter("patterns", kept_under)),
        last_path=cut_path if cut_pattern == 0 else None,
        limit_pattern=None if further.select("path").isEmpty() else cut_pattern,
    )


def skip_report(skips: DataFrame) -> DataFrame:
    """Skips per reason."""
    return skips.groupBy("reason").agg(F.count(F.lit(1)).alias("skipped"))
