"""Matching lines of a corpus as citations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linecite.functions.lines import explode_hits, explode_runs, hit_count, hit_runs, with_lines
from linecite.functions.paths import location
from linecite.functions.predicates import LineMatcher
from linecite.functions.redaction import redact
from linecite.operators.topn import cut_row

MATCH_COLUMNS = ["file_path", "location", "snippet", "line_number"]


@dataclass(frozen=True)
class Cut:
    """Where a match limit falls: all matches of files before ``path`` count, and ``rest`` of its own."""

    path: str
    rest: int


def with_hit_counts(texts: DataFrame, matcher: LineMatcher) -> DataFrame:
    """Add ``n_hits int``, the number of matching lines. Texts without one become null.

    Row-local; texts that cannot match are not split. Frames that have the column stay as they are.
    """
    if "n_hits" in texts.columns:
        return texts
    text = F.col("text")
    tested = with_lines(texts.withColumn("text", F.when(matcher.document(text), text)))
    hits = F.coalesce(hit_count(F.col("lines"), matcher.line), F.lit(0)).cast("int")
    counted = tested.withColumn("n_hits", hits).drop("lines")
    return counted.withColumn("text", F.when(F.col("n_hits") > 0, text))


def find_cut(texts: DataFrame, matcher: LineMatcher, max_matches: int | None) -> Cut | None:
    """Where the match limit falls in scan order; None if it is not reached.

    Looks at paths and counts alone; snippets are cut afterwards, for what the limit leaves.
    """
    if max_matches is None:
        return None
    times = F.col("n_hits").cast("bigint") * F.size("patterns")
    counted = with_hit_counts(texts.select("path", "patterns", *_text_columns(texts)), matcher)
    # A filter would be moved below the counting and count once more.
    some = F.filter(F.array(times), lambda n: n > 0)
    found = counted.select("path", F.explode(some).alias("matches"))
    cut = cut_row(found, ["path"], "matches", max_matches)
    return None if cut is None else Cut(cut[0]["path"], max_matches - cut[1])


def _text_columns(texts: DataFrame) -> list[str]:
    return ["n_hits"] if "n_hits" in texts.columns else ["text"]


def match_lines(
    texts: DataFrame, matcher: LineMatcher, context_lines: int, cut: Cut | None = None
) -> DataFrame:
    """One row per matching line and listed occurrence, up to the cut. No shuffle.

    ``texts`` has ``path, kind, text`` and ``patterns``. Adds to the match columns: ``is_doc``,
    ``occurrence`` (1-based among the globs that selected the file), ``order_number``, the line number
    that orders use even where the shown one is taken away, and ``opens_file``, true on the first match
    of each occurrence, which makes counting matched files a plain sum.
    """
    if cut is not None:
        # A comparison with a constant: it reaches the scan.
        texts = texts.where(F.col("path") <= F.lit(cut.path))
    matching = texts.where(F.col("text").isNotNull()).where(matcher.document(F.col("text")))
    found = explode_hits(
        with_lines(matching.select("path", "kind", "patterns", "text")).drop("text"), matcher.line, context_lines
    )
    return _citations(found, cut)


def _citations(found: DataFrame, cut: Cut | None) -> DataFrame:
    """Hits, numbered inside their file, as ``match_lines`` gives them."""
    occurrence = F.explode(F.sequence(F.lit(1), F.size("patterns"))).alias("occurrence")
    found = found.select("path", "kind", "n_hits", "place", "line_number", "snippet", occurrence)
    if cut is not None:
        before = (F.col("occurrence") - 1).cast("bigint") * F.col("n_hits") + F.col("place")
        found = found.where((F.col("path") < F.lit(cut.path)) | (before < cut.rest))
    number = F.col("line_number")
    return found.select(
        F.col("path").alias("file_path"),
        location(F.col("kind"), number).alias("location"),
        "snippet",
        "line_number",
        number.alias("order_number"),
        (F.col("kind") != "text").alias("is_doc"),
        "occurrence",
        (F.col("place") == 0).alias("opens_file"),
    )


def chunk_runs(chunks: DataFrame, matcher: LineMatcher, context_lines: int) -> DataFrame:
    """Chunks of files to runs of hits beside ``n_hits``; a row without a run for a chunk without hits.

    Row-local. No row holds a chunk's text: what leaves is what snippets need. Texts that cannot match are
    not split.
    """
    lined = chunks.withColumn("text", F.when(matcher.document(F.col("text")), F.col("text")))
    for text, lines in _CHUNK_LINES.items():
        lined = with_lines(lined, text, lines).drop(text)
    runs = hit_runs(
        lined, matcher.line, context_lines, around=("lines_ahead", "lines_behind"), outer=True
    )
    return runs.withColumn("n_hits", F.coalesce("n_hits", F.lit(0)).cast("bigint"))


_CHUNK_LINES = {"text": "lines", "before": "lines_ahead", "after": "lines_behind"}


def chunk_counts(runs: DataFrame) -> DataFrame:
    """A narrow row per chunk of ``chunk_runs``: the lines and hits of its file before it, the hits of the
    file, and ``failed``, what is wrong with the file.
    """
    of_file = Window.partitionBy("path")
    earlier = of_file.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    once = runs.where(F.col("run").isNull() | (F.col("run.place") == 0))
    return once.select(
        "path",
        "kind",
        "patterns",
        "chunk",
        F.coalesce(F.sum("n_lines").over(earlier), F.lit(0)).alias("lines_before"),
        F.coalesce(F.sum("n_hits").over(earlier), F.lit(0)).alias("hits_before"),
        F.sum("n_hits").over(of_file).alias("file_hits"),
        F.min("error").over(of_file).alias("failed"),
    )


def chunked_files(counts: DataFrame) -> DataFrame:
    """``path, kind, patterns, n_hits, error`` of the files that ``chunk_counts`` speaks of.

    A file with a chunk that cannot be read has an error and no hits.
    """
    hits = F.when(F.col("failed").isNull(), F.col("file_hits")).otherwise(F.lit(0)).cast("bigint")
    first = counts.where(F.col("chunk") == 0)
    return first.select("path", "kind", "patterns", hits.alias("n_hits"), F.col("failed").alias("error"))


def match_chunks(
    runs: DataFrame, counts: DataFrame, context_lines: int, cut: Cut | None = None
) -> DataFrame:
    """``match_lines`` for files in chunks, from ``chunk_runs`` and ``chunk_counts``.

    Numbers inside a file follow from counts, which runs meet by file and chunk, so that one long file is
    not one task. Stored counts have a known size: Spark sends them to the runs while they are small.
    """
    if cut is not None:
        runs = runs.where(F.col("path") <= F.lit(cut.path))
    read = counts.where(F.col("failed").isNull()).drop("failed", "kind", "patterns")
    matching = runs.where(F.col("run").isNotNull()).select("path", "kind", "patterns", "chunk", "run")
    placed = matching.join(read, ["path", "chunk"])
    inside = {
        "n_hits": F.col("file_hits"),
        "place": F.col("place") + F.col("hits_before"),
        "line_number": (F.col("line_number") + F.col("lines_before")).cast("int"),
    }
    return _citations(explode_runs(placed, context_lines).withColumns(inside), cut)


def result_order() -> list[Column]:
    """The order in which matches are shown. Document locations sort as text: 10 before 2."""
    return [
        F.col("file_path"),
        F.when(~F.col("is_doc"), F.col("order_number")),
        F.when(F.col("is_doc"), F.col("location")),
        F.col("occurrence"),
    ]


def redact_matches(matches: DataFrame) -> DataFrame:
    """Secrets removed from the joined snippets. The shown line number goes, the order stays."""
    return matches.withColumn("snippet", redact(F.col("snippet"))).withColumn(
        "line_number", F.lit(None).cast("int")
    )


def read_skips(texts: DataFrame, cut: Cut | None) -> DataFrame:
    """Skip rows of files that could not be read, as far as the search got.

    Once the match limit is reached, files behind the last returned match are not looked at.
    """
    failed = texts.where(F.col("error").isNotNull())
    if cut is not None:
        failed = failed.where(F.col("path") < F.lit(cut.path))
    return failed.select(
        F.lit(2).alias("phase"),
        F.explode("patterns").alias("pattern_idx"),
        "path",
        F.when(F.col("kind") == "text", F.lit("unreadable"))
        .otherwise(F.concat(F.lit("skipped_"), F.col("kind")))
        .alias("reason"),
        F.col("error").alias("message"),
    )
