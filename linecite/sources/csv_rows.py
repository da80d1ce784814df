"""CSV bytes as rows of string cells. No types are inferred and ragged rows are kept."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecite.settings import STANDARD_CSV_ROWS, resolve_limit
from linecite.sources.directory import default_tasks

_ROWS_PER_BATCH = 5_000
_CHARS_PER_BATCH = 32 * 1024 * 1024


def csv_rows(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """CSV files to ``path, row_index, cells, more_follow, error``.

    Give rows with ``path`` and ``content binary``, or with ``path`` only to read files that every
    executor mounts. The header is row 0. Quoted line breaks stay in their cell, blank lines are
    rows without cells. A file is read as a stream and its rows leave the worker in batches, so
    that its size does not matter. ``more_follow`` marks the last row kept of a file that has
    further ones. A file that is empty or cannot be read ends with an error row.
    """
    limit = resolve_limit(max_rows, STANDARD_CSV_ROWS)

    def rows(path: str, content: bytes | None) -> Iterator[tuple]:
        for index, cells, more, error in _parse(path, content, limit):
            yield path, index, cells, more, error

    return _per_file(
        df,
        rows,
        "path string, row_index bigint, cells array<string>, more_follow boolean, error string",
        pa.schema(
            [
                ("path", pa.string()),
                ("row_index", pa.int64()),
                ("cells", pa.list_(pa.string())),
                ("more_follow", pa.bool_()),
                ("error", pa.string()),
            ]
        ),
    )


def csv_summary(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Per file: ``columns`` (row 0), ``n_rows``, ``truncated`` (also on an exact fit),
    ``total_rows_found`` (one more than the limit when further rows exist) and ``error``.

    Takes the same input as ``csv_rows``. A file is counted where it is read: nothing is shuffled.
    """
    limit = resolve_limit(max_rows, STANDARD_CSV_ROWS)

    def summary(path: str, content: bytes | None) -> Iterator[tuple]:
        columns, count, further, failed = None, 0, False, None
        for index, cells, more, error in _parse(path, content, limit):
            if error is not None:
                failed = error
                break
            columns = cells if index == 0 else columns
            count, further = count + 1, more
        truncated = limit is not None and count >= limit
        yield path, columns, count, truncated, count + further, failed

    return _per_file(
        df,
        summary,
        "path string, columns array<string>, n_rows bigint, truncated boolean, "
        "total_rows_found bigint, error string",
        pa.schema(
            [
                ("path", pa.string()),
                ("columns", pa.list_(pa.string())),
                ("n_rows", pa.int64()),
                ("truncated", pa.bool_()),
                ("total_rows_found", pa.int64()),
                ("error", pa.string()),
            ]
        ),
    )


def _parse(path: str, content: bytes | None, limit: int | None) -> Iterator[tuple]:
    """``(row_index, cells, more_follow, error)`` of one file."""
    # Cells may be as long as the file.
    csv.field_size_limit(sys.maxsize)
    last = None
    try:
        raw = open(path, "rb") if content is None else io.BytesIO(content)
        with io.TextIOWrapper(raw, encoding="utf-8", errors="replace") as text:
            for index, cells in enumerate(csv.reader(text)):
                if last is not None:
                    yield *last, index == limit, None
                if index == limit:
                    return
                last = index, cells
        if last is None:
            raise ValueError("no rows")
        yield *last, False, None
    except (OSError, ValueError, csv.Error) as problem:
        yield None, None, None, f"Failed to read CSV {path}: {problem}"


def _per_file(
    df: DataFrame,
    rows: Callable[[str, bytes | None], Iterator[tuple]],
    columns: str,
    schema: pa.Schema,
) -> DataFrame:
    inline = "content" in df.columns

    def batch(found: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(values, field.type) for values, field in zip(zip(*found), schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        size = 0
        for part in batches:
            contents = part.column("content") if inline else [None] * part.num_rows
            for path, content in zip(part.column("path"), contents):
                data = (content.as_py() or b"") if inline else None
                for row in rows(path.as_py(), data):
                    found.append(row)
                    size += sum(map(len, row[2] or ())) if isinstance(row[2], list) else 0
                    if len(found) >= _ROWS_PER_BATCH or size >= _CHARS_PER_BATCH:
                        yield batch(found)
                        found, size = [], 0
        if found:
            yield batch(found)

    if inline:
        return df.select("path", "content").mapInArrow(read, columns)
    # A listing's partitions say nothing about how much there is to read.
    tasks = default_tasks(df.sparkSession)
    return df.select("path").repartition(tasks, F.col("path")).mapInArrow(read, columns)


def cell(cells: Column, index: int) -> Column:
    """Cell ``index`` (0-based), or null where a ragged row is too short."""
    return F.get(cells, index)
