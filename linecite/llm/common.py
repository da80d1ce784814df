"""Helpers of the operators: tables, the shared folder, bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecite.session import ship_code

#: Rows that Python works on at a time, whatever the size of the Arrow batch they came in.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Make this package importable in Python workers."""
    ship_code(spark, "linecite")


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode without one, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        application = spark.conf.get("spark.app.id")
        if application not in _own_folders:
            _own_folders[application] = tempfile.mkdtemp(prefix="linecite-shared-")
        folder = _own_folders[application]
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/linecite-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_share(key: Column, share: float, seed: str) -> Column:
    """True for about ``share`` of the keys, always the same ones."""
    spread = F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1 << 30))
    return spread < F.lit(int(share * (1 << 30)) if share < 1 else 1 << 30)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of few rows, so that memory does not follow the batch size."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Rows kept away from training: crc32 of the key as text leaves this remainder.

    A null key is never held out.
    """
    return F.coalesce(
        F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False)
    )


def finite(vector: Column) -> Column:
    """True for arrays that hold something, and neither nulls nor numbers that are not finite."""
    inf = F.lit(float("inf"))
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce(good & (F.size(vector) > 0), F.lit(False))
