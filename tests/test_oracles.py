"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.oracle_check import compare, duck
from workload.oracle_queries import ORACLES
from workload.spark_queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    assert compare(spark, connection, SF_DIR, name) is None


def test_entry(spark):
    assert contract.entry(spark).columns == ["file_path", "location", "snippet", "line_number"]


def test_coverage_searches_every_text_and_reports_skips(spark, tmp_path):
    rows = [(i, "a license\nb", "en", "src0") for i in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["coverage"](spark, str(tmp_path)).first()
    # Texts and notes are under two globs each.
    assert (found["scanned_files"], found["total_matches"], found["cited_files"]) == (18, 18, 14)
    assert found["skipped_total"] == 2
    assert found["skipped_files"] == "|".join(f"Unsupported file type: src0/en/{i}.xyz" for i in (12, 5))
