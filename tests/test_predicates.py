from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from linecite.functions.predicates import (
    LineMatcher,
    check_regex,
    java_regex,
    stays_within_lines,
)

LINES = [
    "", "search term here", "Search  Terms", "É été", "price: 12 €", "a[b]c", "x{2}", "a&&b",
    "foo-bar foo-bar", "naïve café", "tab\there", "ends with dot.", "١٢٣", "straße", "x{a}", "aaa",
    "a^b", "back\\slash", "]", "nul\0byte", "A\x0bB"[:1],
]
PATTERNS = [
    r"search\s+\w+", r"^search", r"dot\.$", r"\bcaf", r"\d+", r"(?P<word_1>foo)-bar (?P=word_1)",
    r"here\Z", r"[[]b", r"[]]", r"[^]a]$", r"[a&&b]{3}", r"x{2}", r"x\{2}", r"x{a}", r"a{,3}$",
    r"a{2,}", r"(?#note)term", r"\Aa", r"(?<!x)a", r"é", r"[é-ë]t", r"\0", r"\U000000e9", r"a\^b",
    r"\\s", r"[\]]", r"(?:foo|bar)", r"(?i:SEARCH)", r"[[]", r"[a[]b", r"[^[]b", r"x{",
]


@pytest.mark.parametrize("case_sensitive", [True, False])
def test_regex_agrees_with_python(spark, case_sensitive):
    df = spark.createDataFrame(list(enumerate(LINES)), "id int, line string")
    flags = 0 if case_sensitive else re.IGNORECASE
    columns = [
        LineMatcher(p, case_sensitive, True).line(F.col("line")).alias(f"p{i}")
        for i, p in enumerate(PATTERNS)
    ]
    rows = df.select("id", *columns).orderBy("id").collect()
    for row in rows:
        expected = [bool(re.compile(p, flags).search(LINES[row.id])) for p in PATTERNS]
        assert list(row)[1:] == expected, LINES[row.id]


def test_literal_wildcards_are_ordinary(spark):
    df = spark.createDataFrame([("100%",), ("1000",), ("a_b",), ("aXb",)], "line string")
    matched = [
        [r.line for r in df.where(LineMatcher(q).line(F.col("line"))).collect()]
        for q in ("0%", "a_b", "A_B")
    ]
    assert matched == [["100%"], ["a_b"], ["a_b"]]


def test_bad_patterns_fail_when_the_search_is_built(spark):
    for pattern in ("(", "[a", "*a", r"\Q", "a**"):
        with pytest.raises(re.error):
            check_regex(spark, LineMatcher(pattern, regex=True))
    # Fine for one dialect only: still an eager error.
    with pytest.raises(Exception):
        check_regex(spark, LineMatcher(r"(a)?(?(1)b|c)", regex=True))


def test_group_names_become_legal():
    assert java_regex("(?P<a_b>x)") == "(?<gax5fb>x)"


def test_which_regexes_are_tested_on_whole_texts():
    yes = ["a|b", r"licen[sc]e|tok\.en", r"\d{3,}-\w+?", "(ab)+(?:c|d)*", "a.b", "[a-z]{2}", "x y"]
    no = [
        "^a", "a$", r"a\b", r"\Aa", "(?=a)", "(?<!a)b", "[^a]", r"a\s+b", r"\W", r"\D", "a++",
        "(?i:a)", "(?s).", "(?P<n>a)", r"(a)\1", r"[\s]", "a*+", "(?>a)", r"a\x0a", "",
    ]
    assert [p for p in yes if not stays_within_lines(p)] == []
    assert [p for p in no if stays_within_lines(p)] == []


@pytest.mark.parametrize("case_sensitive", [True, False])
def test_the_document_test_passes_every_text_with_a_matching_line(spark, case_sensitive):
    df = spark.createDataFrame([(line,) for line in LINES], "line string").withColumn(
        "text", F.concat(F.lit("before\n"), "line", F.lit("\nafter"))
    )
    for pattern in [*PATTERNS, "licen[sc]e|term", r"\w+-\w+ foo", "t.rm", "(?:te|sea)r"]:
        matcher = LineMatcher(pattern, case_sensitive, True)
        lost = df.where(matcher.line(F.col("line")) & ~matcher.document(F.col("text")))
        assert lost.count() == 0, pattern
