"""Directory trees on storage that every executor mounts.

Spark's own file sources leave out names that start with "_" or ".", hidden folders and empty
files, all of which a search must list, so listing is a Python data source. It reports names
only. Sizes are looked up by a later step, over evenly spread names, so that one folder with a
third of all files is no bottleneck; contents are read after files have been selected.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME_SCHEMA = "root string, path string, is_file boolean, unlisted string"
_NAMES = pa.schema(
    [("root", pa.string()), ("path", pa.string()), ("is_file", pa.bool_()), ("unlisted", pa.string())]
)
_ROWS_PER_BATCH = 10_000
#: One Arrow batch of contents closes at this size.
_BATCH_BYTES = 64 * 1024 * 1024
#: What a value can hold.
_VALUE_BYTES = (1 << 31) - 64
#: Bytes of file content per reading task.
_TASK_BYTES = 256 * 1024 * 1024


class Subtree(InputPartition):
    """Some folders; listed with everything below them, or without going down."""

    def __init__(self, folders: list[str], recursive: bool):
        self.folders = folders
        self.recursive = recursive


def _entries(folder: str, failed: list[tuple[str, str]] | None = None) -> Iterator[os.DirEntry]:
    """Entries one at a time, as a folder may hold very many. What cannot be read goes to ``failed``."""
    try:
        with os.scandir(folder) as entries:
            yield from entries
    except OSError as problem:
        if failed is not None:
            failed.append((folder, f"Error listing {folder}: {problem.strerror or problem}"))


def _is_folder(entry: os.DirEntry) -> bool:
    """A folder to go down into; links to folders are listed but not followed."""
    try:
        return entry.is_dir(follow_symlinks=False)
    except OSError:
        return False


class DirectoryReader(DataSourceReader):
    def __init__(self, root: str, partitions: int):
        self.root = root
        self.target = partitions

    def partitions(self) -> list[InputPartition]:
        """Open folders breadth-first until there are enough to share out.

        Folders opened here become non-recursive partitions, so that a large top folder is split
        into its children instead of ending up in one task.
        """
        opened, waiting = [], deque([self.root])
        while waiting and len(opened) + len(waiting) < self.target:
            folder = waiting.popleft()
            opened.append(folder)
            waiting.extend(e.path for e in _entries(folder) if _is_folder(e))
        shallow = [Subtree(opened[i::16], False) for i in range(min(16, len(opened)))]
        return shallow + [Subtree([folder], True) for folder in waiting]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        are_files: list[bool] = []
        waiting = list(partition.folders)
        failed: list[tuple[str, str]] = []
        while waiting:
            for entry in _entries(waiting.pop(), failed):
                if partition.recursive and _is_folder(entry):
                    waiting.append(entry.path)
                try:
                    is_file = entry.is_file()
                    if not is_file and not entry.is_dir():
                        continue
                except OSError:
                    continue
                paths.append(entry.path)
                are_files.append(is_file)
                if len(paths) >= _ROWS_PER_BATCH:
                    yield self._batch(paths, are_files)
                    paths, are_files = [], []
        if paths:
            yield self._batch(paths, are_files)
        if failed:
            yield self._batch([f for f, _ in failed], [False] * len(failed), [why for _, why in failed])

    def _batch(
        self, paths: list[str], are_files: list[bool], unlisted: list[str] | None = None
    ) -> pa.RecordBatch:
        columns = [
            pa.array([self.root] * len(paths), pa.string()),
            pa.array(paths, pa.string()),
            pa.array(are_files, pa.bool_()),
            pa.array(unlisted or [None] * len(paths), pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=_NAMES)


class DirectorySource(DataSource):
    """``spark.read.format("linecite_directory").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "linecite_directory"

    def schema(self) -> str:
        return NAME_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DirectoryReader(self.options["path"], int(self.options.get("partitions", "64")))


def resolve_root(root: str) -> str:
    resolved = os.path.realpath(root)
    if not os.path.exists(resolved):
        raise ValueError(f"Root directory does not exist: {root}")
    return resolved


def directory_names(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """Every file and folder below ``root``: ``root, path, is_file``."""
    partitions = partitions or 4 * spark.sparkContext.defaultParallelism
    spark.dataSource.register(DirectorySource)
    return (
        spark.read.format("linecite_directory")
        .option("partitions", str(partitions))
        .load(resolve_root(root))
    )


def with_sizes(names: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add ``length bigint``: 0 for folders, null where it cannot be had.

    Files without a length pass size caps; reading them tells what is wrong.
    """
    partitions = partitions or default_tasks(names.sparkSession)
    kept = names.columns

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths: list[int | None] = []
            for path, is_file in zip(
                batch.column("path").to_pylist(), batch.column("is_file").to_pylist()
            ):
                try:
                    lengths.append(os.stat(path).st_size if is_file else 0)
                except OSError:
                    lengths.append(None)
            column = pa.array(lengths, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, column], names=[*batch.schema.names, "length"]
            )

    return names.repartition(partitions, F.col("path")).mapInArrow(
        look_up, f"{_columns(names, kept)}, length bigint"
    )


def reading_tasks(files: DataFrame) -> int:
    """How many tasks reading the files takes, from the sum of their lengths."""
    total = files.agg(F.sum("length")).first()[0] or 0
    return max(default_tasks(files.sparkSession), -(-total // _TASK_BYTES))


def read_bytes(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add ``content binary`` and ``error string`` to rows with a ``path``.

    The rows are spread by path first: how a listing is partitioned says nothing about how much
    there is to read. The partition count is explicit, so that adaptive execution does not merge
    partitions that look tiny because they hold only names.
    """
    partitions = partitions or default_tasks(files.sparkSession)
    kept = [c for c in files.columns if c not in ("content", "error")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents: list[bytes | None] = []
            errors: list[str | None] = []
            start = size = 0
            for path in batch.column("path").to_pylist():
                content, error = read_file(path)
                contents.append(content)
                errors.append(error)
                size += len(content or b"")
                if size >= _BATCH_BYTES:
                    yield _with_contents(batch.slice(start, len(contents)), contents, errors)
                    start += len(contents)
                    contents, errors, size = [], [], 0
            if contents:
                yield _with_contents(batch.slice(start, len(contents)), contents, errors)

    return (
        files.select(*kept)
        .repartition(partitions, F.col("path"))
        .mapInArrow(read, f"{_columns(files, kept)}, content binary, error string")
    )


def read_file(path: str) -> tuple[bytes | None, str | None]:
    """The whole file, or what went wrong."""
    try:
        with open(path, "rb") as file:
            size = os.fstat(file.fileno()).st_size
            if size > _VALUE_BYTES:
                return None, f"{size} bytes do not fit in one value"
            return file.read(), None
    except OSError as problem:
        return None, str(problem)


def default_tasks(spark: SparkSession) -> int:
    """Tasks for work over names whose amount is not known."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        2 * spark.sparkContext.defaultParallelism,
    )


def _columns(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)


def _with_contents(batch: pa.RecordBatch, contents: list, errors: list) -> pa.RecordBatch:
    columns = [*batch.columns, pa.array(contents, pa.binary()), pa.array(errors, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "content", "error"])
