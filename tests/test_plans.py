"""The shape of the plans: what is read, what is shuffled, what is cut before a shuffle."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from linecite import UNLIMITED, list_corpus, search, table_corpus
from linecite.operators.coverage import match_counts
from linecite.operators.topn import beside, checkpointed, cut_row, first_rows, numbered
from linecite.settings import Limits

WHOLE = {"max_files": UNLIMITED, "max_matches": UNLIMITED}


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A corpus table stored in path order, with byte lengths and columns nobody asks for."""
    path = str(tmp_path_factory.mktemp("plans") / "corpus")
    spark.range(2000).select(
        F.format_string("r/%05d.txt", "id").alias("path"),
        F.lit("r").alias("root"),
        F.concat(F.lit("head\nline the "), F.col("id")).alias("text"),
        F.lit(20).cast("bigint").alias("length"),
        F.lit("unused").alias("other"),
    ).repartitionByRange(4, "path").sortWithinPartitions("path").write.parquet(path)
    return table_corpus(spark.read.parquet(path), "path", "text", "root", "length")


def test_searching_everything_shuffles_nothing(stored):
    for options in ({}, {"regex": True}, {"case_sensitive": True}):
        shown = plan(search(stored, "the", **WHOLE, **options).matches)
        assert "Exchange" not in shown and "Python" not in shown and "Join" not in shown


def test_only_the_needed_columns_are_read(stored):
    shown = plan(search(stored, "the", **WHOLE).matches)
    assert "other" not in shown
    listing = list_corpus(stored, None, Limits.of(max_files=UNLIMITED))
    for df in (listing.counts(), listing.skips, listing.occurrences()):
        assert "text:string" not in plan(df)


def test_a_literal_is_tested_before_any_splitting(stored):
    shown = plan(search(stored, "License", **WHOLE).matches)
    assert shown.rindex("Contains(lower(text") > shown.rindex("split(text")
    assert shown.count("split(text") == 2  # the two ways to split, once each


def test_the_match_limit_shuffles_no_snippet(stored):
    output = search(stored, "the", max_matches=700)
    shown = plan(output.matches)
    assert "Exchange" not in shown and "LessThanOrEqual(path,r/00699.txt)" in shown
    assert output.matches.count() == 700


def test_no_generator_carries_the_lines(stored):
    shown = plan(search(stored, "the", **WHOLE).matches)
    # What each generator copies to its rows.
    copied = re.findall(r"\), \[([^\]]*)\], false, \[", shown)
    assert len(copied) == shown.count("Generate ") == 3
    for columns in copied:
        assert not re.search(r"\b(lines|text|_run|_hits|_extract_lines)#", columns), columns


def test_coverage_reads_the_corpus_once(stored):
    summary = search(stored, "the", **WHOLE).summary()
    shown = plan(summary)
    assert "Join" not in shown
    assert "text:string" not in shown, "the report is made of what one pass has left"
    assert summary.first()["total_matches"] == 2000


def test_a_file_limit_prunes_the_scan_by_path(stored):
    output = search(stored, "the", max_files=100)
    assert "LessThanOrEqual(path,r/00099.txt)" in plan(output.matches)
    assert output.matches.count() == 100


def test_an_allowlist_prunes_the_scan_by_path(spark, tmp_path):
    path = str(tmp_path / "corpus")
    spark.range(4000).select(
        F.format_string("r%d/sub/%05d.txt", F.col("id") % 40, "id").alias("path"),
        F.format_string("r%d/sub", F.col("id") % 40).alias("root"),
        F.lit("the text").alias("text"),
    ).repartitionByRange(8, "path").sortWithinPartitions("path").write.parquet(path)
    corpus = table_corpus(spark.read.parquet(path), "path", "text", "root")
    output = search(corpus, "the", allowed_roots=["r3", "r11/sub/", "r2/su"])
    found = output.matches
    assert "StringStartsWith(path,r3/)" in plan(found) and "StringStartsWith(path,r11/sub/)" in plan(found)
    assert {r["file_path"].split("/")[0] for r in found.collect()} == {"r3", "r11"}
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() < 2000
    summary = output.summary().first()
    assert (summary["scanned_files"], summary["errors_total"]) == (200, 3800)


def test_counting_needs_no_distinct(stored):
    shown = plan(match_counts(search(stored, "the", **WHOLE).found, None))
    assert "distinct" not in shown.lower()
    assert shown.count("Exchange") == 1 and "SinglePartition" in shown


def test_a_cut_is_where_the_sum_reaches_the_limit(spark):
    df = spark.range(0, 3000, numPartitions=7).select(
        (F.col("id") * 7919 % 3000).alias("v"), (F.col("id") % 4).alias("w")
    )
    rows = sorted(tuple(r) for r in df.collect())
    for n in (1, 2, 1500, 4499, 4500):
        total = 0
        for v, w in rows:
            if total + w >= n:
                break
            total += w
        row, before = cut_row(df, ["v"], "w", n)
        assert (row["v"], before) == (v, total)
    assert cut_row(df, ["v"], "w", 4501) is None and cut_row(df.limit(0), ["v"], "w", 1) is None


def test_first_rows_of_each(spark):
    df = spark.range(0, 5000, numPartitions=9).select((F.col("id") % 2 == 0).alias("even"), "id")
    first = first_rows(df, [F.col("id").desc()], 3, ["even"]).collect()
    assert sorted(r["id"] for r in first) == list(range(4994, 5000))


def test_rows_beside_each_other(spark):
    a, b = spark.range(1).select(F.lit(1).alias("a")), spark.range(1).select(F.array(F.lit("x")).alias("b"))
    assert "Join" not in plan(beside(a, b))
    assert [tuple(r) for r in beside(a, b).collect()] == [(1, ["x"])]


def test_rows_are_numbered_over_ranges(spark):
    df = spark.range(0, 30_000, numPartitions=7).select((F.col("id") * 7919 % 30_000).alias("v"))
    rows = numbered(df, [F.col("v")], "n").collect()
    assert sorted((r["v"], r["n"]) for r in rows) == [(v, v + 1) for v in range(30_000)]
    assert numbered(df.limit(0), [F.col("v")], "n").collect() == []


def test_first_rows_equals_a_plain_limit(spark):
    df = spark.range(0, 20_000, numPartitions=37).select(
        (F.hash("id") % 500).alias("k"), "id"
    )
    order = [F.col("k"), F.col("id").desc()]
    for n in (1, 10, 2500):
        expected = df.orderBy(*order).limit(n).collect()
        assert first_rows(df, order, n).collect() == expected


def test_first_rows_is_right_whatever_the_threshold(spark):
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(name)
    df = spark.range(0, 5000, numPartitions=9)
    try:
        frame = first_rows(df, [F.col("id")], 1500)
        spark.conf.set(name, "-1")
        assert [r["id"] for r in frame.collect()] == list(range(1500))
    finally:
        spark.conf.set(name, before)


def test_checkpoints_cut_the_plan(spark):
    assert "Range" not in plan(checkpointed(spark.range(10)))
