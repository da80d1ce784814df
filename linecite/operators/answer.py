"""The templated answer over the matches of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecite.functions.text import key_point
from linecite.operators.coverage import match_counts
from linecite.operators.matching import result_order
from linecite.operators.topn import beside, first_rows

KEY_POINTS = 3


def answer(matches: DataFrame, question: str) -> DataFrame:
    """One row, ``answer string``: counts, then the key points of the first three matches."""
    return beside(match_counts(matches, None), key_points(matches)).select(
        answer_text(question).alias("answer")
    )


def key_points(matches: DataFrame) -> DataFrame:
    """One row, ``points array<string>``: the first lines of the first three matches."""
    leading = first_rows(matches, result_order(), KEY_POINTS)
    order = F.struct(
        "file_path",
        F.when(~F.col("is_doc"), F.col("order_number")).alias("n"),
        F.when(F.col("is_doc"), F.col("location")).alias("l"),
        "occurrence",
        key_point(F.col("snippet")).alias("point"),
    )
    return leading.agg(
        F.filter(
            F.transform(F.array_sort(F.collect_list(order)), lambda e: e["point"]),
            lambda p: p != "",
        ).alias("points")
    )


def answer_text(question: str) -> Column:
    """The answer from ``total_matches``, ``cited_files`` and ``points``."""
    return F.when(
        F.col("total_matches") == 0, F.lit(f"No information found to answer: {question}")
    ).otherwise(
        F.concat(
            F.lit("Found "),
            F.col("total_matches"),
            F.lit(" relevant matches across "),
            F.col("cited_files"),
            F.lit(" file"),
            F.when(F.col("cited_files") != 1, F.lit("s")).otherwise(F.lit("")),
            F.lit(". Key information includes:"),
            F.array_join(F.transform("points", lambda p: F.concat(F.lit("\n- "), p)), ""),
        )
    )
