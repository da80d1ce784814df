"""A table of texts as a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_corpus(
    df: DataFrame,
    path: str | Column,
    text: str | Column,
    root: str | Column,
    length: str | Column | None = None,
) -> DataFrame:
    """``root, path, length, text, error`` from a table with one row per document.

    ``path`` is the full, unique path, below ``root``. Give ``length`` (bytes) if the table stores
    it: listings and coverage then never read the text column.
    """

    def column(value) -> Column:
        return F.col(value) if isinstance(value, str) else value

    text = column(text)
    return df.select(
        column(root).alias("root"),
        column(path).alias("path"),
        (F.octet_length(text) if length is None else column(length))
        .cast("bigint")
        .alias("length"),
        text.alias("text"),
        F.lit(None).cast("string").alias("error"),
    )


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Spread the rows of a plain scan that has fewer partitions than there are cores.

    A small table often is one file with one row group, hence one task, while searching is bound by
    CPU. Any scan with a partition per core or more is returned as it is: large corpora are never
    shuffled. Meant for scans only, since asking for the partitions of a frame that shuffles would
    run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)
