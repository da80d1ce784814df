from __future__ import annotations

import datetime as dt
import itertools
import os

import pytest
from pyspark.sql import functions as F

from linecite import STANDARD_LIMITS, UNLIMITED, ask, ask_report, search, search_report, sources_report, table_corpus
from linecite.operators import history as h
from linecite.operators.answer import answer
from linecite.operators.coverage import with_confidence
from linecite.operators.report import write_report


def corpus(spark, texts):
    rows = [("r", f"r/{name}", text) for name, text in texts.items()]
    return table_corpus(
        spark.createDataFrame(rows, "root string, path string, text string"), "path", "text", "root"
    )


def text(report):
    return "\n".join(r["text"] for r in report.orderBy("seq").collect())


def test_confidence_grades(spark):
    def by_rule(total, matched, scanned):
        share = matched / max(scanned, 1)
        if total == 0:
            return "low", "No matches found for the query"
        if total >= 10 and share >= 0.1:
            return "high", f"Found {total} matches across {matched} files"
        if total >= 3 and share >= 0.05:
            return "medium", f"Found {total} matches across {matched} files"
        return "low", f"Only {total} matches found, results may be limited"

    cases = list(itertools.product([0, 2, 3, 9, 10], [0, 4, 5, 9, 10], [0, 100]))
    df = spark.createDataFrame(
        cases, "total_matches bigint, matched_files bigint, scanned_files bigint"
    )
    for row in with_confidence(df).collect():
        assert (row["confidence"], row["reason"]) == by_rule(*list(row)[:3])


def test_search_report(spark):
    output = search(
        corpus(spark, {"a.txt": "one\nhit  \n\n", "b.bin": "x"}), "hit", roots=["r"], **STANDARD_LIMITS
    )
    assert text(search_report(output)) == "\n".join(
        [
            "## Search Results", "**Query:** hit", "**Found:** 1 matches", "", "### Matches",
            "**1.** `r/a.txt:2`", "```", "one\nhit", "```", "",
            "### Coverage Report", "**Search Scope:**", "- Root: `r`", "- Pattern: `*`",
            "**Statistics:**", "- Files scanned: 1", "- Files with matches: 1",
            "**Limits Applied:**", "- max_files: 5000", "- max_matches: 2000",
            "- context_lines: 2", "**Skipped Files:** (1 total)",
            "- Unsupported file type: r/b.bin",
            "### Confidence: low", "Only 1 matches found, results may be limited",
        ]
    )


def test_search_report_without_matches(spark):
    report = text(search_report(search(corpus(spark, {"a.txt": "one"}), "hit", roots=["r"])))
    assert report.startswith(
        "## Search Results\n**Query:** hit\n**Found:** 0 matches\n\n"
        "### No matches found\n\n### Coverage Report\n"
    )
    assert report.endswith("### Confidence: low\nNo matches found for the query")


def test_truncated_report_lists_ten_skips(spark):
    texts = {f"{i:02}.bin": "x" for i in range(12)} | {f"{i}.txt": "hit" for i in range(4)}
    report = text(search_report(search(corpus(spark, texts), "hit", max_matches=3)))
    assert "**Found:** 3 matches\n**Warning:** Results truncated due to limits\n\n" in report
    assert "**Skipped Files:** (12 total)\n- Unsupported file type: r/00.bin\n" in report
    assert "r/09.bin\n- ... and 2 more\n" in report and "10.bin" not in report


def test_large_counts_have_separators(spark):
    texts = {f"{i}.txt": "x" for i in range(1234)}
    assert "- Files scanned: 1,234\n" in text(search_report(search(corpus(spark, texts), "none")))


def test_ask_report(spark):
    secret = "0123456789abcdef0123456789"
    texts = {"a.txt": f"intro\ntoken = {secret}", "b.txt": "\n token again\nx\ny\ntoken"}
    report = text(ask_report(search(corpus(spark, texts), "token", context_lines=1)))
    assert report.startswith(
        "## Answer\nFound 3 relevant matches across 2 files. Key information includes:\n"
        "- intro\n- y\n\n### Citations\n**1.** `r/a.txt:2`\n```\nintro\n[REDACTED]\n```\n\n**2.** "
    )
    assert secret not in report
    empty = text(ask_report(search(corpus(spark, texts), "absent")))
    assert empty.startswith(
        "## Answer\nNo information found to answer: absent\n\n### No sources found\n\n### Cov"
    )


def test_answer_for_one_file(spark):
    found = search(corpus(spark, {"a.txt": "  hit one \nhit two"}), "hit", context_lines=0).found
    assert answer(found, "hit").first()["answer"] == (
        "Found 2 relevant matches across 1 file. Key information includes:\n- hit one\n- hit two"
    )


ORDERED = {"notes.txt": "z hit\nx\na hit\nm hit\nc hit\n\n\n\n\nq hit"}


def test_answers_keep_the_order_of_lines(spark):
    report = text(ask_report(search(corpus(spark, ORDERED), "hit", context_lines=0)))
    assert "includes:\n- z hit\n- a hit\n- m hit\n" in report


def test_redacted_citations_keep_their_order(spark):
    rows = corpus(spark, ORDERED).repartition(3)
    output = ask(search(rows, "hit", globs=["*.txt", "*"], context_lines=0))
    found = output.ordered().collect()
    assert [r["location"] for r in found] == [n for n in ("1", "3", "4", "5", "10") for _ in range(2)]
    assert all(r["line_number"] is None for r in found)


def test_reports_need_no_match_limit(spark):
    texts = {f"{i:04}.txt": "hit\n" * 9 for i in range(300)}
    report = search_report(search(corpus(spark, texts), "hit", max_matches=UNLIMITED))
    rows = report.orderBy("seq").collect()
    assert [r["seq"] for r in rows[:-2]] == list(range(2701))
    assert "0299.txt:9" in rows[2700]["text"] and "truncated" not in rows[0]["text"]


def test_written_reports_keep_their_order(spark, tmp_path):
    texts = {f"{i:03}.txt": "hit\n" for i in range(120)}
    report = search_report(search(corpus(spark, texts), "hit"))
    for _ in range(2):  # a report replaces the one before
        write_report(report, str(tmp_path / "report"))
    parts = sorted(p for p in os.listdir(tmp_path / "report") if p.startswith("part-"))
    written = "".join((tmp_path / "report" / p).read_text() for p in parts)
    assert written == text(report) + "\n"


# ---- history ------------------------------------------------------------------------------


def records(spark, roots):
    start = dt.datetime(2024, 1, 1)
    rows = [
        (i, start + dt.timedelta(hours=i), r, ["*"], i, 1, [], [], {"max_files": 5})
        for i, r in enumerate(roots)
    ]
    return spark.createDataFrame(rows, h.RECORD_SCHEMA)


def test_saved_coverage_round_trips(spark, tmp_path):
    table = str(tmp_path / "history")
    assert h.load_history(spark, table).count() == 0
    assert h.last_coverage(h.load_history(spark, table)).count() == 0
    assert sources_report(h.load_history(spark, table)).count() == 0
    texts = {f"{i:02}.bin": "x" for i in range(12)} | {"a.txt": "hit"}
    for query in ("none", "hit"):
        h.save_coverage(search(corpus(spark, texts), query, roots=["r"], **STANDARD_LIMITS).summary(), table)
    history = h.load_history(spark, table)
    assert history.count() == 2
    last = h.last_coverage(history).first()
    assert last["matched_files"] == 1 and last["limits_applied"]["max_matches"] == 2000
    # Only ten skips are stored, so the total shown again is smaller than the search's own.
    assert len(last["skipped_files"]) == last["skipped_total"] == 10
    report = text(sources_report(history))
    assert report.startswith("## Last Search Coverage\n\n### Coverage Report\n")
    assert "(10 total)" in report and "more" not in report
    h.compact_history(spark, table)
    assert h.load_history(spark, table).collect() == history.collect()
    h.clear_history(spark, table)
    assert h.load_history(spark, table).count() == 0


def summary_row(spark, i):
    kind = "scanned_files long, matched_files long, skipped_files array<string>, errors array<string>"
    df = spark.createDataFrame([(i, 1, [], [])], kind)
    some = [F.array(F.lit("r")).alias("roots"), F.array(F.lit("*")).alias("globs")]
    return df.select("*", *some, F.create_map(F.lit("max_files"), F.lit(5)).alias("limits_applied"))


def test_history_stays_small_and_readable(spark, tmp_path):
    table = tmp_path / "history"
    frames, most = [], 0
    for i in range(14):
        h.save_coverage(summary_row(spark, i), str(table), compact_at=3)
        frames.append(h.load_history(spark, str(table)))
        assert [r["scanned_files"] for r in frames[-1].collect()] == list(range(i, -1, -1))
        most = max(most, sum(p.suffix == ".parquet" for p in table.rglob("*")))
    assert most <= 11  # two rounds of four, two bases, one that is being written
    # Frames made before a compaction still read the same until the next but one.
    assert [r["scanned_files"] for r in frames[10].collect()] == list(range(10, -1, -1))


@pytest.mark.parametrize("lost", ["commit", "remove_before"])
def test_a_lost_compaction_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch, lost):
    table = f"file:{tmp_path}/history"
    records(spark, [[str(i)] for i in range(60)]).repartition(7).write.parquet(table)
    wanted = h.load_history(spark, table).collect()
    assert [r["seq"] for r in wanted] == list(range(59, 9, -1))

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(h.HistoryFiles, lost, fail)
        with pytest.raises(OSError):
            h.compact_history(spark, table)
    assert h.load_history(spark, table).collect() == wanted
    h.save_coverage(summary_row(spark, 7), table)
    h.compact_history(spark, table)
    h.compact_history(spark, table)
    assert [r["seq"] for r in h.load_history(spark, table).collect()][1:] == list(range(59, 10, -1))


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    tied = records(spark, [["a"], ["c"], ["b"]]).withColumns({"seq": F.lit(1).cast("long"), "timestamp": F.lit(None).cast("timestamp"), "scanned_files": F.lit(1).cast("long")})
    for df in (tied, tied.orderBy("roots"), tied.orderBy(F.col("roots").desc())):
        assert h.last_coverage(df).first()["roots"] == ["c"]


def test_retention_keeps_the_newest_fifty(spark):
    kept = h.retained(records(spark, [["r"]] * 53))
    assert sorted(r["seq"] for r in kept.collect()) == list(range(3, 53))


def test_history_summary_breaks_ties_by_first_use(spark):
    roots = [["e"], ["d", "c"], ["b"], ["a"], ["f"], ["a"], ["b"], ["c", "d"]]
    rows = h.history_summary(records(spark, roots)).orderBy("rank").collect()
    assert [(r["rank"], r["root"], r["searches"]) for r in rows] == [
        (1, "d", 2), (2, "c", 2), (3, "b", 2), (4, "a", 2), (5, "e", 1),
    ]
    assert {r["total_searches"] for r in rows} == {8}
    assert {r["latest_search"] for r in rows} == {dt.datetime(2024, 1, 1, 7)}
    empty = h.history_summary(records(spark, [])).first()
    assert (empty["total_searches"], empty["latest_search"], empty["root"]) == (0, None, None)


def test_missing_fields_are_defaulted(spark):
    blank = records(spark, [["r"]]).select(
        "seq", "timestamp", *[F.lit(None).cast(f.dataType).alias(f.name) for f in h.RECORD_SCHEMA[2:]]
    )
    row = h.last_coverage(blank).first()
    assert row["roots"] == [] and row["scanned_files"] == 0 and row["limits_applied"] == {}
