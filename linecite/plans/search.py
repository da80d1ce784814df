"""Search a corpus and keep everything its reports need."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecite.functions.paths import matching_globs
from linecite.functions.predicates import LineMatcher, check_regex
from linecite.functions.redaction import redact
from linecite.operators import coverage
from linecite.operators.answer import KEY_POINTS, key_points
from linecite.operators.listing import Listing, list_corpus
from linecite.operators.matching import (
    MATCH_COLUMNS,
    Cut,
    chunk_counts,
    chunk_runs,
    chunked_files,
    find_cut,
    match_chunks,
    match_lines,
    read_skips,
    redact_matches,
    result_order,
    with_hit_counts,
)
from linecite.operators.topn import checkpointed, stored
from linecite.settings import DEFAULT_CONTEXT_LINES, Limits
from linecite.sources.chunks import CHUNK_BYTES, read_chunks
from linecite.sources.directory import (
    directory_names,
    reading_tasks,
    resolve_root,
    with_sizes,
)
from linecite.sources.documents import EXTRACTORS, Extractor, corpus_texts


@dataclass(frozen=True)
class SearchOutput:
    """A search. ``corpus`` has the rows of ``listing.every`` with ``text`` and ``error``.

    ``cut`` says where the match limit falls. ``redacted`` removes secrets from snippets; ``answers``
    also hides line numbers, as answers do. ``chunks`` holds the runs of hits of files too long for
    one row, and the counts of their chunks; rows of ``corpus`` have no text of them.
    """

    corpus: DataFrame
    listing: Listing
    roots: tuple[str, ...]
    matcher: LineMatcher
    context_lines: int
    cut: Cut | None = None
    redacted: bool = False
    answers: bool = False
    chunks: tuple[DataFrame, DataFrame] | None = None

    @property
    def texts(self) -> DataFrame:
        """The files that are searched."""
        searched = self.listing.pruned(self.corpus).where(F.col("reason").isNull())
        return searched.where(F.size("patterns") > 0)

    @property
    def found(self) -> DataFrame:
        """The match columns and the flags reports are built from."""
        return self._found(self.cut)

    def _found(self, cut: Cut | None) -> DataFrame:
        found = match_lines(self.texts, self.matcher, self.context_lines, cut)
        if self.chunks is not None:
            found = found.unionByName(match_chunks(*self.chunks, self.context_lines, cut))
        if self.answers:
            return redact_matches(found)
        return found.withColumn("snippet", redact(F.col("snippet"))) if self.redacted else found

    @property
    def matches(self) -> DataFrame:
        """``file_path, location, snippet, line_number``."""
        return self.found.select(*MATCH_COLUMNS)

    def ordered(self) -> DataFrame:
        """Matches in result order."""
        return self.found.orderBy(*result_order()).select(*MATCH_COLUMNS)

    def skips(self) -> DataFrame:
        """``phase, pattern_idx, path, reason, message`` of everything passed over."""
        return self.listing.skips.unionByName(read_skips(self.texts, self.cut))

    def errors(self) -> DataFrame:
        """``path, message`` of all rows under a root that is not allowed, and of unreadable folders."""
        return self.listing.errors

    def summary(self) -> DataFrame:
        """The one-row coverage report. Counts now, in one pass over the corpus."""
        return coverage.coverage_summary(
            self.corpus, self.listing, self.matcher, self.cut, self.roots, self.context_lines
        )

    def key_points(self) -> DataFrame:
        """One row, ``points``: the first lines of the first three matches. Looks at no further files."""
        few = find_cut(self.texts, self.matcher, KEY_POINTS)
        first = self.cut if few is None else few
        if first is not None:  # whole files, as the shown order differs from the scan's inside a file
            first = self.cut if self.cut and self.cut.path == first.path else Cut(first.path, _ALL)
        return key_points(self._found(first))

    def computed(self) -> "SearchOutput":
        """The same search, its corpus read once and stored: paths, kinds, errors, the number of hits,
        and the texts that have any. Matches, counts and reports are then made of that.
        """
        if "n_hits" in self.corpus.columns:
            return self
        return replace(self, corpus=stored(with_hit_counts(_without_unsearched(self.corpus), self.matcher)))


#: More matches than a file can have.
_ALL = 1 << 62
_CORPUS = ["path", "kind", "patterns", "reason", "refusal", "text", "error"]


def _without_unsearched(corpus: DataFrame) -> DataFrame:
    """Texts that are not searched are not looked at."""
    if "n_hits" in corpus.columns:
        return corpus
    searched = F.col("reason").isNull() & (F.size("patterns") > 0)
    return corpus.withColumn("text", F.when(searched, F.col("text")))


def search(
    corpus: DataFrame,
    query: str,
    *,
    globs: Sequence[str] | None = None,
    case_sensitive: bool = False,
    regex: bool = False,
    context_lines: int = DEFAULT_CONTEXT_LINES,
    max_matches: int | None = None,
    max_files: int | None = None,
    max_file_bytes: int | None = None,
    allowed_roots: Sequence[str] = (),
    roots: Sequence[str] = ("corpus",),
    redact_snippets: bool = False,
) -> SearchOutput:
    """Search a corpus table (see ``table_corpus``).

    Limits left out do not limit; ``**STANDARD_LIMITS`` gives the usual ones. ``roots`` names
    what was searched in the coverage report. Snippets are redacted on request only.
    """
    matcher = LineMatcher(query, case_sensitive, regex)
    check_regex(corpus.sparkSession, matcher)
    limits = Limits.of(max_files, max_matches, max_file_bytes)
    if "error" not in corpus.columns:
        corpus = corpus.withColumn("error", F.lit(None).cast("string"))
    listing = list_corpus(corpus, globs, limits, allowed_roots)
    output = SearchOutput(
        _without_unsearched(listing.every.select(*_CORPUS)), listing, tuple(roots), matcher, context_lines,
        redacted=redact_snippets,
    )
    return replace(output, cut=find_cut(output.texts, matcher, limits.max_matches))


def search_directory(
    spark: SparkSession,
    root: str,
    query: str,
    *,
    globs: Sequence[str] | None = None,
    case_sensitive: bool = False,
    regex: bool = False,
    context_lines: int = DEFAULT_CONTEXT_LINES,
    max_matches: int | None = None,
    max_files: int | None = None,
    max_file_bytes: int | None = None,
    allowed_roots: Sequence[str] = (),
    redact_snippets: bool = False,
    extractors: Mapping[str, Extractor] = EXTRACTORS,
    chunk_bytes: int = CHUNK_BYTES,
) -> SearchOutput:
    """Search a directory tree that every executor mounts.

    Files are read now, once: what matches, counts and reports need is stored. Plain-text files longer
    than ``chunk_bytes`` are read in chunks of that size, of any number; only a single line must fit in
    a value. To search one tree many times, write ``directory_texts(...)`` to a table and use ``search``.
    """
    matcher = LineMatcher(query, case_sensitive, regex)
    check_regex(spark, matcher)
    listing = list_directory(
        spark, root, globs, Limits.of(max_files, max_matches, max_file_bytes), allowed_roots
    )
    is_long = F.coalesce((F.col("kind") == "text") & (F.col("length") > chunk_bytes), F.lit(False))
    short, long = listing.files.where(~is_long), listing.files.where(is_long)
    searched = {"reason": F.lit(None).cast("string"), "refusal": F.lit(None).cast("string")}
    texts = corpus_texts(short, reading_tasks(short), extractors).withColumns(searched)
    skipped = F.col("reason").isNotNull() & (F.size("patterns") > 0)
    others = listing.every.where(skipped | F.col("refusal").isNotNull())
    others = others.withColumns({"text": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    output = SearchOutput(
        texts.select(*_CORPUS).unionByName(others.select(*_CORPUS)), listing, (resolve_root(root),), matcher,
        context_lines, redacted=redact_snippets,
    ).computed()
    if not long.isEmpty():
        columns = long.select("path", "kind", "patterns", "length")
        runs = stored(chunk_runs(read_chunks(columns, context_lines, chunk_bytes), matcher, context_lines))
        counts = stored(chunk_counts(runs))
        files = chunked_files(counts).withColumns({**searched, "text": F.lit(None).cast("string")})
        output = replace(output, corpus=output.corpus.unionByName(files), chunks=(runs, counts))
    return replace(output, cut=find_cut(output.texts, matcher, listing.limits.max_matches))


def list_directory(
    spark: SparkSession,
    root: str,
    globs: Sequence[str] | None = None,
    limits: Limits | None = None,
    allowed_roots: Sequence[str] = (),
) -> Listing:
    """List a directory tree; ``ValueError`` for a missing or a disallowed root.

    The tree is walked once, now: the names and sizes of what the globs select are checkpointed, so
    that matches, counts and skips all speak of the same files.
    """
    resolved = resolve_root(root)
    bases = [base.rstrip("/") + "/" for base in allowed_roots]
    if bases and not any((resolved.rstrip("/") + "/").startswith(base) for base in bases):
        raise ValueError(f"Root directory not allowed: {root}")
    globs = tuple(globs or ("*",))
    selected = matching_globs(F.col("root"), F.col("path"), globs)
    names = directory_names(spark, resolved).where((F.size(selected) > 0) | F.col("unlisted").isNotNull())
    return list_corpus(checkpointed(with_sizes(names)), globs, limits)


def directory_texts(
    listing: Listing, extractors: Mapping[str, Extractor] = EXTRACTORS
) -> DataFrame:
    """Texts of the listed files, each file read once however many globs selected it."""
    return corpus_texts(listing.files, reading_tasks(listing.files), extractors)
