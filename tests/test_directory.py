from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from linecite import UNLIMITED, Limits, directory_texts, list_directory, search_directory
from linecite.operators.listing import list_corpus
from linecite.plans import search as search_plan
from linecite.sources import directory
from linecite.sources.directory import (
    DirectoryReader,
    directory_names,
    read_bytes,
    reading_tasks,
    with_sizes,
)
from linecite.sources.documents import EXTRACTORS
from tests.files import NOTES, awkward, harbour, write

SUPPORTED = [
    ".hidden/deep/y.md", ".x.txt", "UPPER.TXT", "_x.py", "any.pdf", "bad.txt", "broken.docx",
    "empty.txt", "good.docx", "sp ace%20.txt",
]


def below(root, rows):
    return sorted(os.path.relpath(r["path"], os.path.realpath(root)) for r in rows)


@pytest.mark.parametrize("partitions", [1, 2, 3, 64])
def test_listing_reports_every_name_once(spark, tmp_path, partitions):
    awkward(tmp_path)
    write(tmp_path, "d1/d2/d3/z.txt", "z")
    os.symlink(tmp_path / "d1", tmp_path / "link")
    rows = with_sizes(directory_names(spark, str(tmp_path), partitions)).collect()
    expected = [str(p) for p in tmp_path.rglob("*")]
    assert sorted(r["path"] for r in rows) == sorted(expected)
    sizes = {r["path"]: (r["is_file"], r["length"]) for r in rows}
    assert sizes[str(tmp_path / "empty.txt")] == (True, 0)
    assert sizes[str(tmp_path / "d1" / "d2")] == (False, 0)
    assert sizes[str(tmp_path / "UPPER.TXT")] == (True, 6)


def test_a_large_top_folder_is_split(tmp_path):
    for i in range(5):
        for j in range(5):
            write(tmp_path, f"top/{i}/{j}/f.txt", "x")
    partitions = DirectoryReader(str(tmp_path), 12).partitions()
    assert len([p for p in partitions if p.recursive]) >= 5


def test_files_and_skips(spark, tmp_path):
    awkward(tmp_path)
    listing = list_directory(spark, str(tmp_path))
    assert below(tmp_path, listing.files.collect()) == SUPPORTED
    skips = {r["path"]: r["message"] for r in listing.skips.collect()}
    base = os.path.realpath(tmp_path)
    assert skips == {
        f"{base}/{n}": f"Unsupported file type: {base}/{n}" for n in ("noext", "data.xyz")
    }
    assert tuple(listing.counts().first()) == (10, False, 2)


def test_globs_and_duplicates(spark, tmp_path):
    awkward(tmp_path)
    listing = list_directory(spark, str(tmp_path), ["*.txt", "**/*", "deep/*.md"])
    rows = listing.occurrences().collect()
    twice = [r for r in rows if r["occurrence"] == 2]
    assert len(rows) == 4 + 10 + 1
    assert below(tmp_path, twice) == [
        ".hidden/deep/y.md", ".x.txt", "bad.txt", "empty.txt", "sp ace%20.txt",
    ]


def test_size_cap_is_strict_and_first(spark, tmp_path):
    write(tmp_path, "at.txt", "x" * 10)
    write(tmp_path, "over.txt", "x" * 11)
    write(tmp_path, "over.xyz", "x" * 11)
    listing = list_directory(spark, str(tmp_path), None, Limits.of(max_file_bytes=10))
    assert below(tmp_path, listing.files.collect()) == ["at.txt"]
    assert {r["reason"] for r in listing.skips.collect()} == {"too_large"}


def test_file_limit(spark, tmp_path):
    ports = ["brest", "cadiz", "dover", "emden", "genoa", "lagos", "malmo"]
    for port in reversed(ports):
        write(tmp_path, f"{port}.txt", f"Tides at {port.title()}\n")

    def listed(n, globs=None):
        listing = list_directory(spark, str(tmp_path), globs, Limits.of(max_files=n))
        messages = [r["message"] for r in listing.skips.collect()]
        return below(tmp_path, listing.occurrences().collect()), messages, listing.counts().first()

    files, messages, counts = listed(3)
    assert files == ["brest.txt", "cadiz.txt", "dover.txt"]
    assert messages == ["Reached max_files limit (3)"]
    assert tuple(counts) == (3, True, 1)
    # An exact fit is called truncated, but nothing was passed over.
    files, messages, counts = listed(7)
    assert len(files) == 7 and messages == [] and counts["files_truncated"]
    # So is one that ends with the first pattern, though a second one would follow.
    files, messages, counts = listed(7, ["*.txt", "*"])
    assert len(files) == 7 and messages == [] and counts["files_truncated"]
    # A folder behind the cut counts as a further path.
    write(tmp_path, "zzz/.keep", "")
    assert listed(7)[1] == ["Reached max_files limit (7)"]
    assert listed(8)[1] == ["Unsupported file type: " + os.path.realpath(tmp_path) + "/zzz/.keep"]
    assert len(listed(12, ["d*.txt", "*", "l*.txt"])[0]) == 9
    assert len(listed(UNLIMITED)[0]) == 7


def test_roots(spark, tmp_path):
    with pytest.raises(ValueError, match="Root directory does not exist"):
        list_directory(spark, str(tmp_path / "missing"))
    harbour(tmp_path / "a")
    with pytest.raises(ValueError, match="Root directory not allowed"):
        list_directory(spark, str(tmp_path / "a"), allowed_roots=[str(tmp_path / "aa")])
    allowed = list_directory(spark, str(tmp_path / "a"), allowed_roots=[str(tmp_path)])
    assert allowed.files.count() == 2


def test_texts(spark, tmp_path):
    awkward(tmp_path)
    harbour(tmp_path)
    texts = {
        os.path.relpath(r["path"], os.path.realpath(tmp_path)): (r["text"], r["error"])
        for r in directory_texts(list_directory(spark, str(tmp_path))).collect()
    }
    assert texts["notes.txt"] == (NOTES, None)
    assert texts["bad.txt"] == ("�needle\nsecond�", None)
    assert texts["empty.txt"] == ("", None)
    assert texts["good.docx"][0].split("\n")[11] == "needle 12"
    assert texts["broken.docx"] == (
        None, "Skipped DOCX: Failed to extract DOCX text: File is not a zip file",
    )
    assert texts["any.pdf"] == (None, "Skipped PDF: PDF decoder not available")


def test_registered_pdf_decoder(spark, tmp_path):
    write(tmp_path, "any.pdf", b"one|two")
    extractors = {**EXTRACTORS, "pdf": lambda content: content.decode().replace("|", "\n") + "\n"}
    output = search_directory(spark, str(tmp_path), "two", extractors=extractors)
    assert [r["location"] for r in output.matches.collect()] == ["page 2"]


def test_unreadable_file_is_an_error_row(spark, tmp_path):
    write(tmp_path, "a.txt", "x")
    write(tmp_path, "b.txt", "x")
    listing = list_directory(spark, str(tmp_path))
    gone = listing.files.withColumn("path", F.regexp_replace("path", "b.txt$", "gone.txt"))
    rows = {os.path.basename(r["path"]): r for r in read_bytes(gone).collect()}
    assert bytes(rows["a.txt"]["content"]) == b"x" and rows["a.txt"]["error"] is None
    assert rows["gone.txt"]["content"] is None and "No such file" in rows["gone.txt"]["error"]


def test_a_file_too_long_for_a_value_is_an_error_row(tmp_path):
    write(tmp_path, "a.docx", "")
    os.truncate(tmp_path / "a.docx", 3 << 30)  # takes no disk
    assert directory.read_file(str(tmp_path / "a.docx")) == (None, "3221225472 bytes do not fit in one value")


def test_files_that_vanish_before_their_size_is_known_are_skips(spark, tmp_path):
    write(tmp_path, "a.txt", "x")
    write(tmp_path, "b.txt", "x")
    names = directory_names(spark, str(tmp_path)).withColumn(
        "path", F.regexp_replace("path", "b.txt$", "gone.txt")
    )
    sized = with_sizes(names)
    lengths = {os.path.basename(r["path"]): r["length"] for r in sized.collect()}
    assert lengths == {"a.txt": 1, "gone.txt": None}
    # The size cap lets them pass; reading them gives the error.
    texts = directory_texts(list_corpus(sized, None, Limits.of(max_file_bytes=5))).collect()
    errors = {os.path.basename(r["path"]): r["error"] for r in texts}
    assert errors["a.txt"] is None and "No such file" in errors["gone.txt"]


def test_reading_tasks_follow_the_bytes(spark):
    files = spark.range(1000).select(F.lit(10 * 1024 * 1024).cast("bigint").alias("length"))
    assert reading_tasks(files) == 40
    assert reading_tasks(files.limit(0)) == 16


def test_each_file_is_read_once(spark, tmp_path):
    """Kinds are told apart before reading, not after."""
    harbour(tmp_path)
    texts = directory_texts(list_directory(spark, str(tmp_path)))
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    for read in plan.split("MapInArrow")[1:]:
        assert "Filter" in read.split("RepartitionByExpression")[1].split("MapInArrow")[0]


def test_listing_bytes_say_nothing_about_reading(spark, tmp_path):
    """Adaptive execution must not merge the read into one task because names are small."""
    for i in range(64):
        write(tmp_path, f"f{i}.txt", "x")
    files = read_bytes(list_directory(spark, str(tmp_path)).files, 16)
    assert files.select(F.spark_partition_id().alias("p")).distinct().count() > 8


def test_folders_that_cannot_be_read_are_error_rows(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hit")
    root = os.path.realpath(tmp_path)
    gone, reader = f"{root}/gone", directory.DirectoryReader(root, 64)
    # A folder that vanishes between its parent's listing and its own.
    batches = list(reader.read(directory.Subtree([gone, f"{root}/in"], True)))
    rows = [row for b in batches for row in b.to_pylist()]
    assert [(r["path"], r["unlisted"]) for r in rows] == [
        (f"{root}/in/a.txt", None), (gone, f"Error listing {gone}: No such file or directory"),
    ]
    names = spark.createDataFrame([tuple(r.values()) for r in rows], directory.NAME_SCHEMA)
    listing = list_corpus(names.withColumn("length", F.lit(3).cast("bigint")))
    assert [r["path"] for r in listing.files.collect()] == [f"{root}/in/a.txt"]
    assert [tuple(r) for r in listing.errors.collect()] == [(gone, rows[1]["unlisted"])]
    monkeypatch.setattr(search_plan, "list_directory", lambda *a, **b: listing)
    output = search_directory(spark, root, "hit")
    assert output.matches.count() == 1
    summary = output.summary().first()
    assert (summary["errors_total"], summary["errors"], summary["scanned_files"]) == (1, [rows[1]["unlisted"]], 1)
