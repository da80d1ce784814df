from __future__ import annotations

import re

from pyspark.sql import functions as F

from linecite.functions.redaction import SECRET_PATTERNS, may_hold_secret, redact
from linecite.functions.validation import required_keys, validate_query

LONG = "abcDEF0123456789_-abcDEF"
TEXTS = [
    f"API_KEY = '{LONG}'", f"apikey:{LONG}", "sk-" + LONG, "AIza" + "x" * 35, "AIza" + "x" * 34,
    "password: hunter2hunter2", "Password=short", "pwd=secret", "pwd=tiny", f'token = "{LONG}"',
    f"Bearer {LONG}", "mongodb://u:p@h/db x", "see postgresql://h/db", "mysql://h", "AKIA" + "A1" * 8,
    "-----BEGIN PRIVATE KEY-----\nbody", "-----BEGIN EC KEY-----", "-----BEGIN RSA PRIVATE KEY-----",
    f"password=sk-{LONG}", f"token\n=\n{LONG}", f"toKen={LONG}", f"paſſword={LONG}",
    f"apıkey={LONG}", f"APİKEY={LONG}", "a monkey, no secret", "", "password:\xa0longenough",
    f"password='{LONG}' and token={LONG}", "PWD \"' : abcdef", "maſk-" + LONG,
]


def by_python(text):
    for pattern in SECRET_PATTERNS:
        text = re.sub(pattern, "[REDACTED]", text, flags=re.IGNORECASE)
    return text


def test_redaction_agrees_with_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    rows = df.select("id", redact(F.col("text")).alias("r")).orderBy("id").collect()
    assert [r.r for r in rows] == [by_python(t) for t in TEXTS]
    assert sum(a != b.r for a, b in zip(TEXTS, rows)) >= 20


def test_the_cheap_test_passes_every_text_that_changes(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if by_python(t) != t], "text string")
    assert df.where(~may_hold_secret(F.col("text"))).count() == 0


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert df.select(redact(F.col("text"))).first()[0] is None


def test_query_validation(spark):
    queries = [
        "plain", "**a**", "**", "a+++b", "a++b", "x*{1000,}", "x*{100,}", "(.*){50,}", "q" * 1000,
        "q" * 1001, "**" + "z" * 1001 + "**", "**a\n**", "é" * 1000,
    ]
    dangerous = [r"\*\*.*\*\*", r"\+\+\+", r"\*\{1000,\}", r"\(\.\*\)\{50,\}"]
    df = spark.createDataFrame(list(enumerate(queries)), "id int, q string")
    rows = df.select("id", validate_query(F.col("q")).alias("v")).orderBy("id").collect()
    for row, query in zip(rows, queries):
        bad = any(re.search(p, query) for p in dangerous)
        assert row.v.valid == (not bad), query
        assert len(row.v.errors) == bad
        assert len(row.v.warnings) == (len(query) > 1000)


def test_required_keys(spark):
    documents = [
        '{"identity": 1, "operating_rules": {}, "modes_personas": [], "memory_rules": null}',
        '{"identity": 1, "memory_rules": 2}', "[1]", "{bad", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(documents)), "id int, d string")
    rows = df.select("id", required_keys(F.col("d")).alias("v")).orderBy("id").collect()
    assert [r.v.valid for r in rows] == [True, False, False, False, False, False]
    assert rows[0].v.message is None
    assert rows[1].v.message == "Document invalid. Missing: operating_rules, modes_personas"
    assert rows[3].v.message == "Document invalid JSON"
