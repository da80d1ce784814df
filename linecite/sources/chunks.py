"""Files too long for one value: read in chunks of whole lines, with the lines around them.

A chunk is a range of bytes and owns the lines that begin in it. Its task reads them to the end of the
last one, and looks back and ahead in the file for the lines that snippets show beside them, so chunks
need nothing of each other but how many lines come before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecite.functions.text import decode_utf8
from linecite.sources.directory import _columns, reading_tasks

#: Plain-text files longer than this are read in chunks of this size.
CHUNK_BYTES = 8 * 1024 * 1024
#: A line, or the lines beside a chunk, may be this long; a file beyond it is an error row.
LONGEST_BYTES = 1 << 30

# The line terminators as UTF-8. Their bytes mean the same in ill-formed text.
_TERMINATOR = re.compile(rb"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]|\xc2\x85|\xe2\x80[\xa8\xa9]")
_LONGEST_TERMINATOR = 3
_BLOCK = 256 * 1024
_READ = ["before", "text", "after", "n_lines", "error"]


def line_starts(file: BinaryIO, position: int, stop: int) -> Iterator[int]:
    """Where lines begin, in ``[position, stop)``. Reads on only as far as it is asked for."""
    if position == 0 < stop:
        yield 0
    last = max(position - 1, 0)
    at = max(position - _LONGEST_TERMINATOR, 0)
    file.seek(at)
    held = b""
    while True:
        more = file.read(_BLOCK)
        held += more
        for found in _TERMINATOR.finditer(held):
            # At the end of what is held, a carriage return may have its line feed still to come, and
            # at the end of the file no further line begins.
            if found.end() < len(held) and last < at + found.end() < stop:
                last = at + found.end()
                yield last
        if not more or at + len(held) > stop:
            return
        at += max(len(held) - _LONGEST_TERMINATOR, 0)
        held = held[-_LONGEST_TERMINATOR:]


def _end_of_lines(file: BinaryIO, position: int, count: int, size: int, longest: int) -> int:
    """Where the ``count``-th line start from ``position`` on is, or the end of the file."""
    reach = min(size, position + longest)
    starts = list(islice(line_starts(file, position, reach), count))
    if len(starts) == count:
        return starts[-1]
    if reach < size:
        raise ValueError(f"a line is longer than {longest} bytes")
    return size


def _start_of_lines(file: BinaryIO, position: int, count: int, longest: int) -> int:
    """Where the ``count``-th line before ``position``, a line start, begins, or 0."""
    width = _BLOCK
    while count > 0 and position > 0:
        low = max(0, position - width)
        starts = list(line_starts(file, low, position))
        if len(starts) >= count:
            return starts[-count]
        if low == 0:
            return 0
        if width > longest:
            raise ValueError(f"a line is longer than {longest} bytes")
        width *= 4
    return position


def read_chunk(
    path: str, start: int, stop: int, size: int, context_lines: int, longest: int = LONGEST_BYTES
) -> tuple[bytes, bytes, bytes, int]:
    """``context_lines`` lines, the lines that begin in ``[start, stop)``, ``context_lines`` further lines,
    and how many begin there."""
    with open(path, "rb") as file:
        first = next(line_starts(file, start, stop), None)
        if first is None:
            return b"", b"", b"", 0
        count = sum(1 for _ in line_starts(file, start, stop))
        end = _end_of_lines(file, stop, 1, size, longest) if stop < size else size
        before = _start_of_lines(file, first, context_lines, longest)
        after = end
        if context_lines > 0 and end < size:
            after = _end_of_lines(file, end + 1, context_lines, size, longest)
        file.seek(before)
        return file.read(first - before), file.read(end - first), file.read(after - end), count


def read_chunks(files: DataFrame, context_lines: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Listed files, none of them empty, to ``chunk, before, text, after, n_lines, error`` beside their columns.

    One row per chunk, numbered from 0. Chunks are spread over tasks whatever their file. A chunk that
    cannot be read has an error.
    """
    context_lines = max(context_lines, 0)
    pieces = files.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (length - 1) div {chunk_bytes})")))
    kept = pieces.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("path", "length", "chunk")))
            for i, (path, size, chunk) in enumerate(places):
                start = chunk * chunk_bytes
                parts, error = (None, None, None, 0), None
                try:
                    parts = read_chunk(path, start, min(start + chunk_bytes, size), size, context_lines)
                except (OSError, ValueError) as problem:
                    error = f"Error reading {path}: {problem}"
                types = [pa.binary()] * 3 + [pa.int64(), pa.string()]
                arrays = [pa.array([value], kind) for value, kind in zip((*parts, error), types)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, 1).columns, *arrays], names=[*kept, *_READ]
                )

    columns = "before binary, text binary, after binary, n_lines bigint, error string"
    spread = pieces.repartition(reading_tasks(files), "path", "chunk")
    read_pieces = spread.mapInArrow(read, f"{_columns(pieces, kept)}, {columns}")
    return read_pieces.withColumns({c: decode_utf8(F.col(c)) for c in ("before", "text", "after")})
