from __future__ import annotations

import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linecite.functions.lines import explode_hits, explode_lines, with_lines
from linecite.functions.predicates import LineMatcher
from linecite.functions.text import decode_utf8, key_point, rstrip, strip

TERMINATORS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
TEXTS = [
    "", "\n", "a", "a\nb\n", "a\r\nb\rc", "\r\n\r\n", "x\x0by\x0cz", "p\x1cq\x1dr\x1es\x1ft",
    "m\x85n", "k\u2028l\u2029", "a\n\r", "a\r\n", "\n\n", "tail\x85", "a \n", "é\r\n\x0b",
]
alphabet = st.sampled_from(list("ab É" + TERMINATORS))


def split(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = with_lines(df).select("id", "lines").collect()
    return [r.lines for r in sorted(rows)]


def test_known_texts_split_like_splitlines(spark):
    assert split(spark, TEXTS) == [t.splitlines() for t in TEXTS]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet, max_size=12), min_size=40, max_size=80))
def test_random_texts_split_like_splitlines(spark, texts):
    assert split(spark, texts) == [t.splitlines() for t in texts]


def test_explode_numbers_lines_from_one_and_drops_empty_texts(spark):
    df = spark.createDataFrame([(1, "a\n\nb\n"), (2, ""), (3, None)], "id int, text string")
    rows = explode_lines(df).orderBy("id", "line_number").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "a"), (1, 2, ""), (1, 3, "b")]


def model(text, query, case_sensitive, context):
    lines = text.splitlines()
    fold = (lambda s: s) if case_sensitive else str.lower
    return [
        (n, "\n".join(lines[max(1, n - context) - 1 : min(len(lines), n + context)]))
        for n, line in enumerate(lines, 1)
        if fold(query) in fold(line)
    ]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.text(alphabet, max_size=30), min_size=20, max_size=40),
    st.sampled_from(["", "a", "É", "aB", "%", "a\n"]),
    st.booleans(),
    st.integers(0, 4),
)
def test_hits_equal_a_plain_model(spark, texts, query, case_sensitive, context):
    matcher = LineMatcher(query, case_sensitive)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    # The document test must not lose a matching line.
    lined = with_lines(df.where(matcher.document(F.col("text")))).drop("text")
    rows = (
        explode_hits(lined, matcher.line, context)
        .select("id", "line_number", "snippet")
        .orderBy("id", "line_number")
        .collect()
    )
    expected = [
        (i, *hit)
        for i, text in enumerate(texts)
        for hit in model(text, query, case_sensitive, context)
    ]
    assert [tuple(r) for r in rows] == expected


def test_decoding_replaces_bad_bytes_and_unifies_line_breaks(spark):
    samples = [
        b"plain", b"\xff", b"ab\xc3", b"\xe2\x82", b"\xe2\x82\xac", b"\xf0\x9f\x98", b"a\x80b",
        b"\xed\xa0\x80", b"\xc0\xaf", b"\xef\xbb\xbfbom", b"a\r\nb\rc\n", b"", b"\xf4\x90\x80\x80",
        b"\xe2\xe2\x82", b"x\xc3\r\ny",
    ]
    df = spark.createDataFrame(
        [(i, bytearray(b)) for i, b in enumerate(samples)], "id int, content binary"
    )
    rows = df.select("id", decode_utf8(F.col("content")).alias("t")).orderBy("id").collect()
    expected = [
        b.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") for b in samples
    ]
    assert [r.t for r in rows] == expected


def test_trims(spark):
    samples = ["", " a ", "a\n\n", "\t\x1fa b\xa0 ", "a　\n", "a   b", "\n\n", "x" * 50]
    df = spark.createDataFrame(list(enumerate(samples)), "id int, s string")
    c = F.col("s")
    rows = df.orderBy("id").select(rstrip(c), strip(c), key_point(c)).collect()
    assert [tuple(r) for r in rows] == [
        (s.rstrip(), s.strip(), s.split("\n")[0].strip()) for s in samples
    ]


def test_long_inner_space_trims_in_linear_time(spark):
    df = spark.range(1).select(F.concat(F.repeat(F.lit(" "), 200_000), F.lit("x")).alias("s"))
    assert df.select(F.length(rstrip(F.col("s")))).first()[0] == 200_001


def test_a_large_file_is_not_copied_per_line(spark):
    """50 MB with 100,000 hits: work that grows with hits times size would not finish."""
    # The number of repeats is a column, so that the text is not a constant of the plan.
    text = F.repeat(F.lit("word " * 98 + "a hit\n"), (F.col("id") + 100_000).cast("int"))
    df = spark.range(1).select(text.alias("text"))
    hits = explode_hits(with_lines(df).drop("text"), LineMatcher("hit").line, 2)
    start = time.perf_counter()
    row = hits.agg(F.count("*"), F.max("place"), F.sum(F.length("snippet")), F.max("line_number")).first()
    assert tuple(row) == (100_000, 99_999, 100_000 * (5 * 495 + 4) - 6 * 496, 100_000)
    assert time.perf_counter() - start < 60


@pytest.mark.parametrize("n_hits", [255, 256, 257, 512, 700])
def test_snippets_do_not_depend_on_runs_of_hits(spark, n_hits):
    lines = [f"{i} {'hit' if i % 3 == 0 else ''}" for i in range(3 * n_hits + 1)][1:]
    df = spark.createDataFrame([("\n".join(lines),)], "text string")
    for context in (0, 2, 7):
        found = explode_hits(with_lines(df).drop("text"), LineMatcher("hit").line, context).collect()
        assert [r["place"] for r in found] == list(range(n_hits))
        assert {r["n_hits"] for r in found} == {n_hits}
        for r in found:
            n = r["line_number"]
            assert r["snippet"] == "\n".join(lines[max(1, n - context) - 1 : n + context])
