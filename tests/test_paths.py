from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linecite.functions import paths


def select(spark, values, column):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    return [r[0] for r in df.orderBy("id").select(column(F.col("v"))).collect()]


def test_extension_is_the_last_suffix_in_lower_case(spark):
    names = ["/r/a.TXT", "/r/a.tar.gz", "/r/.bashrc", "/r/noext", "/r/a.", "/r.d/x", "/r/.x.md"]
    assert select(spark, names, paths.extension) == [".txt", ".gz", "", "", "", "", ".md"]


def test_kinds(spark):
    extensions = [".txt", ".toml", ".csv", ".docx", ".pdf", ".xyz", ""]
    expected = ["text", "text", "text", "docx", "pdf", None, None]
    assert select(spark, extensions, paths.kind) == expected


FILES = [
    "/r/a.txt", "/r/d/b.txt", "/r/d/e/c.txt", "/r/.h/x.md", "/r/.x.md", "/r/_y.py", "/r/d/A.TXT",
    "/r/sp ace%20.txt", "/r/a[1].txt", "/r/a1.txt", "/r/d/e/new\nline.txt",
]


@pytest.mark.parametrize(
    "pattern, expected",
    [
        ("*.txt", [0, 1, 2, 7, 8, 9, 10]),
        ("**/*.txt", [0, 1, 2, 7, 8, 9, 10]),
        ("./*.txt", [0, 1, 2, 7, 8, 9, 10]),
        ("*", list(range(11))),
        ("**", list(range(11))),
        ("d/*.txt", [1]),
        ("d/**/*.txt", [1, 2, 10]),
        ("e/*", [2, 10]),
        ("?.txt", [0, 1, 2]),
        ("[ab].txt", [0, 1]),
        ("[!ab].txt", [2]),
        ("a[[]1].txt", [8]),
        ("a[1].txt", [9]),
        ("a[0-9].txt", [9]),
        (".*", [4]),
        ("_*", [5]),
        ("*.md", [3, 4]),
        ("*.TXT", [6]),
        ("[a.txt", []),
        (" *.py ", [5]),
    ],
)
def test_globs(spark, pattern, expected):
    chosen = select(
        spark, FILES, lambda p: F.size(paths.matching_globs(F.lit("/r"), p, [pattern, "x"]))
    )
    assert [i for i, n in enumerate(chosen) if n] == expected


def test_bad_globs_are_refused():
    for pattern in ("", "  ", "/abs/*.txt"):
        with pytest.raises(ValueError):
            paths.glob_regex(pattern)


def test_a_path_keeps_every_pattern_that_selects_it(spark):
    globs = ["*.txt", "d/*", "*"]
    chosen = select(
        spark, ["/r/d/b.txt", "/r/x.md"], lambda p: paths.matching_globs(F.lit("/r"), p, globs)
    )
    assert chosen == [[0, 1, 2], [2]]


def test_split_globs():
    assert paths.split_globs("**/*.txt, *.md ,") == ["**/*.txt", "*.md", ""]


def test_root_allowlist_compares_whole_segments(spark):
    roots = ["/data", "/data/x", "/database", "/other"]
    assert select(spark, roots, lambda r: paths.is_root_allowed(r, ["/data/"])) == [
        True, True, False, False,
    ]
    assert all(select(spark, roots, lambda r: paths.is_root_allowed(r, [])))
    assert all(select(spark, roots, lambda r: paths.is_root_allowed(r, ["/"])))


def test_display_path_strips_a_plain_prefix(spark):
    values = ["/home/me/a/b.txt", "/home/me", "/home/mex/c", "/elsewhere", "/home/me\\\\x"]
    assert select(spark, values, lambda p: paths.display_path(p, "/home/me")) == [
        "a/b.txt", "", "x/c", "/elsewhere", "x",
    ]


def test_sizes_and_estimates(spark):
    row = spark.range(1).select(
        paths.size_is_safe(F.lit(10), 10),
        paths.size_is_safe(F.lit(11), 10),
        paths.estimated_memory(F.lit(3)),
        paths.estimated_memory(F.lit(2), 76),
    )
    assert tuple(row.first()) == (True, False, 3 * (1048576 + 1024), 2200)


def test_the_size_is_tested_before_the_type(spark):
    df = spark.createDataFrame([(".xyz", 11), (".xyz", 10), (".txt", 11), (".txt", 10)], "e string, n int")
    rows = df.select(paths.skip_reason(F.col("e"), F.col("n"), 10)).collect()
    assert [r[0] for r in rows] == ["too_large", "unsupported", "too_large", None]
