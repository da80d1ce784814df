"""Files searched in chunks against the same files searched whole."""

from __future__ import annotations

import random

import pytest

from linecite import ask_report, search_directory, search_report
from linecite.functions.predicates import LineMatcher
from linecite.operators.matching import chunk_counts, chunk_runs, chunked_files, match_chunks
from linecite.sources.chunks import LONGEST_BYTES, line_starts, read_chunk, read_chunks
from tests.files import write

ENDS = ["\n", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def scraps(seed, n, ends=ENDS):
    """Lines with every terminator, empty ones, ill-formed bytes and cut-off terminators."""
    chance = random.Random(seed)
    words = ["needle", "", "é", "hay " * 5, "日本", "x", "Needle in hay"]
    odd = [b"", b"", b"", b"\xff", b"\xe2\x80", b"\xc2", b"\xf0\x9f"]
    out = b""
    for _ in range(n):
        out += chance.choice(words).encode() + chance.choice(odd) + chance.choice(ends).encode()
    return out + chance.choice([b"", b"needle", b"tail\r"])


def plain_lines(content):
    return content.decode("utf-8", "replace").splitlines(keepends=True)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 1000])
@pytest.mark.parametrize("context", [0, 1, 3])
def test_chunks_own_each_line_once_and_see_their_neighbours(tmp_path, chunk, context, monkeypatch):
    monkeypatch.setattr("linecite.sources.chunks._BLOCK", 5)
    content = scraps(chunk, 40)
    write(tmp_path, "f.txt", content)
    lines, path, size, seen = plain_lines(content), str(tmp_path / "f.txt"), len(content), 0
    for start in range(0, size, chunk):
        parts = read_chunk(path, start, min(start + chunk, size), size, context)
        before, own, after = (plain_lines(part) for part in parts[:3])
        assert parts[3] == len(own)
        assert own == lines[seen : seen + len(own)]
        if own:
            assert before == lines[max(0, seen - context) : seen]
            seen += len(own)
            assert after == lines[seen : seen + context]
    assert seen == len(lines)


def test_line_starts_of_odd_files(tmp_path):
    for content, starts in [(b"", []), (b"\n", [0]), (b"a\r\n", [0]), (b"\r\r\n\n", [0, 1, 3]), (b"a\nb", [0, 2])]:
        write(tmp_path, "f.txt", content)
        with open(tmp_path / "f.txt", "rb") as file:
            assert list(line_starts(file, 0, len(content))) == starts


def test_a_line_too_long_is_an_error(tmp_path, monkeypatch):
    monkeypatch.setattr("linecite.sources.chunks._BLOCK", 8)
    write(tmp_path, "f.txt", b"a\n" + b"x" * 1000)
    with pytest.raises(ValueError, match="longer than 100 bytes"):
        read_chunk(str(tmp_path / "f.txt"), 0, 50, 1002, 1, 100)
    assert read_chunk(str(tmp_path / "f.txt"), 50, 100, 1002, 1, 100) == (b"", b"", b"", 0)
    assert LONGEST_BYTES < 2**31


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "options",
    [{}, {"max_matches": 25}, {"globs": ["*.txt", "**/*"], "max_matches": 61}, {"regex": True}, {"context_lines": 9}],
)
def test_searches_in_chunks_equal_searches_of_whole_files(spark, tmp_path, options):
    for i in range(4):
        write(tmp_path, f"d{i}/long{i}.txt", scraps(i, 60))
    write(tmp_path, "a.txt", "needle")
    write(tmp_path, "blank.txt", "\n" * 500)
    write(tmp_path, "empty.txt", "")
    whole = search_directory(spark, str(tmp_path), "needle", **{"globs": ["**/*"], **options})
    cut = search_directory(spark, str(tmp_path), "needle", **{"globs": ["**/*"], **options}, chunk_bytes=70)
    assert whole.chunks is None and cut.chunks[0].select("path").distinct().count() == 5
    assert len(rows(whole.ordered())) > 20
    assert rows(cut.ordered()) == rows(whole.ordered())
    assert rows(cut.summary()) == rows(whole.summary())
    assert rows(cut.key_points()) == rows(whole.key_points())


def test_reports_over_chunks(spark, tmp_path):
    write(tmp_path, "long.txt", scraps(5, 80))
    whole = search_directory(spark, str(tmp_path), "needle")
    cut = search_directory(spark, str(tmp_path), "needle", chunk_bytes=100)
    for report in (search_report, ask_report):
        assert sorted(rows(report(cut))) == sorted(rows(report(whole)))


def test_a_file_with_an_unreadable_chunk_is_one_skip(spark, tmp_path):
    write(tmp_path, "a.txt", "needle\n" * 50)
    files = [(str(tmp_path / "a.txt"), "text", [0], 350), (str(tmp_path / "gone.txt"), "text", [0], 90)]
    listed = spark.createDataFrame(files, "path string, kind string, patterns array<int>, length bigint")
    matcher = LineMatcher("needle", False, False)
    runs = chunk_runs(read_chunks(listed, 1, 40), matcher, 1)
    counts = chunk_counts(runs)
    assert counts.count() == 12
    found = {r["path"]: (r["n_hits"], r["error"]) for r in chunked_files(counts).collect()}
    assert found[files[0][0]] == (50, None)
    assert found[files[1][0]][0] == 0 and "No such file" in found[files[1][0]][1]
    assert match_chunks(runs, counts, 1).count() == 50
