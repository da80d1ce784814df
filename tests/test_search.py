from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from linecite import (
    STANDARD_LIMITS,
    UNLIMITED,
    ask,
    directory_texts,
    list_directory,
    search,
    search_directory,
    table_corpus,
)
from linecite.settings import DEFAULT_GLOBS
from tests.files import STAFF, awkward, harbour, write
from workload.corpora import docx_bytes


def cited(output):
    return [(os.path.basename(r["file_path"]), r["location"]) for r in output.ordered().collect()]


def corpus(spark, texts):
    rows = [("r", f"r/{name}", text) for name, text in texts.items()]
    return table_corpus(
        spark.createDataFrame(rows, "root string, path string, text string"), "path", "text", "root"
    )


@pytest.mark.parametrize(
    "query, options, expected",
    [
        ("policy", {"globs": ["**/*.md"]}, [("handbook.md", "3")]),
        ("policy", {}, [("handbook.md", "3"), ("notes.txt", "7")]),
        ("security", {"context_lines": 3}, [("handbook.md", str(n)) for n in (5, 15, 17)]),
        ("Security", {"case_sensitive": True}, [("handbook.md", "15")]),
        (
            "security|encryption",
            {"regex": True},
            [("handbook.md", str(n)) for n in (5, 15, 17, 23)],
        ),
        (
            "Policy|Security",
            {"regex": True, "case_sensitive": True},
            [("handbook.md", "3"), ("handbook.md", "15")],
        ),
        (r"search\s+\w+", {"regex": True}, [("notes.txt", "3")]),
        ("SEARCH TERM", {"case_sensitive": True}, []),
        ("engineering", {"globs": ["**/*.csv"]}, [("staff.csv", "2")]),
        ("policy\nx", {}, []),
    ],
)
def test_end_to_end(spark, tmp_path, query, options, expected):
    harbour(tmp_path)
    write(tmp_path, "staff.csv", STAFF)
    options = {"globs": DEFAULT_GLOBS, **options}
    assert cited(search_directory(spark, str(tmp_path), query, **options)) == expected


def test_matches_carry_paths_lines_and_clipped_context(spark, tmp_path):
    write(tmp_path, "staff.csv", STAFF)
    row = search_directory(spark, str(tmp_path), "engineering").matches.first()
    assert row["file_path"] == os.path.realpath(tmp_path / "staff.csv")
    assert (row["location"], row["line_number"]) == ("2", 2)
    assert row["snippet"] == STAFF.rstrip("\n")
    alone = search_directory(spark, str(tmp_path), "engineering", context_lines=0).matches.first()
    assert alone["snippet"] == STAFF.splitlines()[1]


def test_awkward_tree(spark, tmp_path):
    awkward(tmp_path)
    output = search_directory(spark, str(tmp_path), "needle")
    paragraphs = sorted((f"paragraph {i}" for i in range(1, 13)))
    assert cited(output) == [
        ("y.md", "1"), (".x.txt", "1"), ("UPPER.TXT", "1"), ("_x.py", "1"),
        ("bad.txt", "1"), *[("good.docx", p) for p in paragraphs], ("sp ace%20.txt", "1"),
    ]
    summary = output.summary().first()
    assert (summary["scanned_files"], summary["matched_files"], summary["total_matches"]) == (10, 7, 18)
    base = os.path.realpath(tmp_path)
    assert summary["skipped_files"] == [
        f"Unsupported file type: {base}/data.xyz",
        f"Unsupported file type: {base}/noext",
        "Skipped PDF: PDF decoder not available",
        "Skipped DOCX: Failed to extract DOCX text: File is not a zip file",
    ]
    assert summary["roots"] == [base] and summary["globs"] == ["*"]


def test_a_full_search_reports_no_skips_behind_its_last_match(spark, tmp_path):
    awkward(tmp_path)
    output = search_directory(spark, str(tmp_path), "needle", max_matches=5)
    # any.pdf precedes the last returned match in bad.txt, broken.docx follows it.
    reasons = {r["reason"] for r in output.skips().collect()}
    assert "skipped_pdf" in reasons and "skipped_docx" not in reasons
    assert output.summary().first()["truncated"]


def test_saved_texts_search_like_the_tree(spark, tmp_path):
    awkward(tmp_path / "tree")
    listing = list_directory(spark, str(tmp_path / "tree"))
    directory_texts(listing).write.parquet(str(tmp_path / "texts"))
    saved = spark.read.parquet(str(tmp_path / "texts"))
    output = search(saved, "needle")
    assert cited(output) == cited(search_directory(spark, str(tmp_path / "tree"), "needle"))
    assert output.summary().first()["skipped_total"] == 2


def test_match_limit_follows_scan_order_with_duplicates(spark):
    texts = {"a.txt": "x1\nx2\nx3", "b.txt": "x4\nx5"}
    output = search(corpus(spark, texts), "x", globs=["*.txt", "a.*"], max_matches=4)
    # The first occurrence of a.txt is used up before the second starts.
    assert cited(output) == [("a.txt", "1"), ("a.txt", "1"), ("a.txt", "2"), ("a.txt", "3")]
    row = output.summary().first()
    assert (row["scanned_files"], row["matched_files"], row["cited_files"]) == (3, 2, 1)
    assert row["truncated"] and row["total_matches"] == 4
    exact = search(corpus(spark, texts), "x", max_matches=5).summary().first()
    assert exact["truncated"] and exact["total_matches"] == 5
    over = search(corpus(spark, texts), "x", max_matches=6).summary().first()
    assert not over["truncated"]


def test_zero_stands_for_the_standard_limit(spark):
    output = search(corpus(spark, {"a.txt": "x"}), "x", max_matches=0, max_files=0)
    assert output.summary().first()["limits_applied"] == {
        "max_files": 5000, "max_matches": 2000, "context_lines": 2,
    }
    whole = search(corpus(spark, {"a.txt": "x"}), "x", max_matches=UNLIMITED, max_files=UNLIMITED)
    assert whole.summary().first()["limits_applied"] == {"context_lines": 2}
    with pytest.raises(ValueError):
        search(corpus(spark, {"a.txt": "x"}), "x", max_matches=-5)


def test_the_standard_limit_cuts_at_2000_and_none_does_not(spark):
    texts = {f"{i:04}.txt": "\n".join(["hit"] * 7) for i in range(400)}
    output = search(corpus(spark, texts), "hit", **STANDARD_LIMITS)
    rows = cited(output)
    assert len(rows) == 2000
    assert rows[-1] == ("0285.txt", "5")
    assert search(corpus(spark, texts), "hit").matches.count() == 2800


def test_a_text_above_the_standard_size_is_searched_unless_limited(spark):
    df = spark.range(1).select(
        F.lit("r").alias("root"), F.lit("r/a.txt").alias("p"),
        F.concat(F.repeat(F.lit("some line\n"), (F.col("id") + 1_100_000).cast("int")), F.lit("a hit")).alias("t"),
    )
    rows = table_corpus(df, "p", "t", "root")
    assert [r["line_number"] for r in search(rows, "hit").matches.collect()] == [1_100_001]
    assert search(rows, "hit", **STANDARD_LIMITS).matches.count() == 0


def test_an_empty_query_matches_every_line(spark):
    assert len(cited(search(corpus(spark, {"a.txt": "x\n\ny", "e.txt": ""}), ""))) == 3


def test_empty_texts_are_scanned_but_not_skipped(spark):
    row = search(corpus(spark, {"a.txt": "x", "e.txt": ""}), "x").summary().first()
    assert (row["scanned_files"], row["matched_files"], row["skipped_total"]) == (2, 1, 0)


def test_document_locations_sort_as_text(spark):
    texts = {"d.docx": "\n".join(["hit"] * 11), "e.pdf": "hit", "f.txt": "\n".join(["hit"] * 11)}
    rows = cited(search(corpus(spark, texts), "hit"))
    assert [loc for name, loc in rows if name == "d.docx"][:4] == [
        "paragraph 1", "paragraph 10", "paragraph 11", "paragraph 2",
    ]
    assert [loc for name, loc in rows if name == "f.txt"] == [str(n) for n in range(1, 12)]
    assert ("e.pdf", "page 1") in rows


def test_case_folding_beyond_ascii(spark):
    texts = {"a.txt": "ÉTÉ\nΟΔΟΣ\nστράτα ΟΔΟΣ\nοδος"}
    assert len(cited(search(corpus(spark, texts), "été"))) == 1
    assert len(cited(search(corpus(spark, texts), "οδος"))) == 3


@pytest.mark.parametrize("context", [0, 3, 16, 17, 40, 10_000])
def test_every_context_width_gives_the_same_kind_of_snippet(spark, context):
    lines = [f"line {i} {'hit' if i % 3 == 0 else ''}" for i in range(1, 61)]
    rows = search(
        corpus(spark, {"a.txt": "\n".join(lines)}), "hit", context_lines=context
    ).ordered()
    assert [(r["line_number"], r["snippet"]) for r in rows.collect()] == [
        (n, "\n".join(lines[max(1, n - context) - 1 : n + context])) for n in range(3, 61, 3)
    ]


def test_wide_context_streams_out_of_a_large_file(spark):
    """Together the snippets have far more characters than one row may hold."""
    text = F.repeat(F.lit("some line of text\n"), (F.col("id") + 15_000).cast("int"))
    df = spark.range(1).select(F.lit("r").alias("root"), F.lit("r/a.txt").alias("p"), text.alias("t"))
    output = search(
        table_corpus(df, "p", "t", "root"), "line", context_lines=5_000, max_matches=UNLIMITED
    )
    total = output.matches.agg(F.count("*"), F.sum(F.length("snippet"))).first()
    assert total[0] == 15_000 and total[1] > 2**31


SECRET = "token = '0123456789abcdef0123456789'"


def test_search_shows_secrets_unless_asked_and_ask_never_does(spark):
    texts = {"a.txt": f"first\n{SECRET}\nlast", "b.txt": "token\n=\n0123456789abcdef0123456789"}
    plain = search(corpus(spark, texts), "token")
    assert SECRET in plain.ordered().first()["snippet"]
    redacted = search(corpus(spark, texts), "token", redact_snippets=True).ordered().collect()
    assert [r["snippet"] for r in redacted] == ["first\n[REDACTED]'\nlast", "[REDACTED]"]
    assert [r["line_number"] for r in redacted] == [2, 1]
    asked = ask(plain).ordered().collect()
    assert [r["snippet"] for r in asked] == [r["snippet"] for r in redacted]
    assert [(r["location"], r["line_number"]) for r in asked] == [("2", None), ("1", None)]


def test_disallowed_roots_become_error_rows(spark):
    rows = [("r", "r/a.txt", "x"), ("s", "s/b.txt", "x"), ("rs", "rs/c.txt", "x")]
    df = spark.createDataFrame(rows, "root string, path string, text string")
    output = search(table_corpus(df, "path", "text", "root"), "x", allowed_roots=["r"])
    assert cited(output) == [("a.txt", "1")]
    row = output.summary().first()
    assert row["errors"] == ["Root directory not allowed: rs", "Root directory not allowed: s"]


def test_file_limit_on_a_table(spark):
    texts = {f"{i}.txt": "x" for i in range(6)} | {"3.bin": "x"}
    output = search(corpus(spark, texts), "x", max_files=4)
    assert [name for name, _ in cited(output)] == ["0.txt", "1.txt", "2.txt", "3.txt"]
    assert output.summary().first()["skipped_files"] == [
        "Unsupported file type: r/3.bin", "Reached max_files limit (4)",
    ]


def test_one_hot_root_and_one_hot_file(spark):
    """A third of all rows under one root, a third of all lines in one file."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), "id")).alias("root"),
        F.when(F.col("id") == 0, F.repeat(F.lit("hit\n"), 3000)).otherwise("a\nhit").alias("text"),
        "id",
    )
    path = F.concat_ws("/", "root", F.concat(F.col("id").cast("string"), F.lit(".txt")))
    whole = search(
        table_corpus(df, path, "text", "root"), "hit", max_files=UNLIMITED, max_matches=UNLIMITED
    )
    assert whole.matches.count() == 3000 + 2999


def test_streams_search_with_the_same_row_operators(spark, tmp_path):
    from linecite.functions.lines import explode_hits, with_lines
    from linecite.functions.predicates import LineMatcher

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a\nneedle\nb",), ("none",)], "text string").write.parquet(source)
    stream = spark.readStream.schema("text string").parquet(source)
    lined = with_lines(stream).drop("text")
    hits = explode_hits(lined, LineMatcher("needle").line, 1).select("line_number", "snippet")
    query = (
        hits.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start(out)
    )
    assert query.awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(2, "a\nneedle\nb")]


def test_docx_in_a_tree(spark, tmp_path):
    write(tmp_path, "a.docx", docx_bytes(["one", "two hit", "three"]))
    row = search_directory(spark, str(tmp_path), "HIT").matches.first()
    assert (row["location"], row["snippet"]) == ("paragraph 2", "one\ntwo hit\nthree")
