"""First-n rows, row numbers and checkpoints that hold up on very many partitions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

#: Middle-level groups: each merges (tasks / 1024) task results, the last step 1024 group results.
_GROUPS = 1024


def first_rows(df: DataFrame, order: Sequence[Column], n: int, by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in the given order, in that order; with ``by``, of each of its few values.

    ``orderBy().limit(n)`` alone sends n rows from every task to one task, which is far too much
    when there are 100,000 tasks. Here every task keeps its first n rows, groups of tasks merge
    theirs, and only the group results meet in one task. For small ``n``; see ``cut_row`` for others.
    """
    # ``session.configure`` lets the filter on row_number cut rows before the shuffle.
    group = Window.partitionBy(*by, "_group").orderBy(*order)
    merged = (
        df.withColumn("_group", F.spark_partition_id() % _GROUPS)
        .withColumn("_rank", F.row_number().over(group))
        .where(F.col("_rank") <= n)
        .drop("_group", "_rank")
    )
    if not by:
        return merged.orderBy(*order).limit(n)
    ranked = merged.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def beside(*frames: DataFrame) -> DataFrame:
    """One row with the columns of frames of at most one row each, without a join."""
    both = frames[0]
    for frame in frames[1:]:
        both = both.unionByName(frame, allowMissingColumns=True)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])


def cut_row(df: DataFrame, order: Sequence[str], weight: str, n: int) -> tuple[Row, int] | None:
    """The row at which the sum of ``weight`` in the given order reaches ``n``, and the sum before it.

    None if it never does. Only the columns named are shuffled, to ranges of the order; the sums of
    the ranges tell in which one the row is, and only that one is looked at. Computes ``df``.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in order]
    # Stored before they are dealt, as finding the ranges reads them once more.
    weighed = stored(df.select(*keys, F.col(weight).cast("bigint").alias("_weight")))
    dealt = stored(weighed.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    of_range = (
        dealt.groupBy("_range").agg(F.sum("_weight").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .where((F.col("_before") < n) & (F.col("_before") + F.col("_sum") >= n))
        .first()
    )
    if of_range is None:
        return None
    so_far = F.sum("_weight").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    row = (
        dealt.where(F.col("_range") == of_range["_range"])
        .withColumn("_sum", so_far + of_range["_before"])
        .where(F.col("_sum") >= n)
        .orderBy(*keys)
        .first()
    )
    return row, row["_sum"] - row["_weight"]


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name bigint``, each row's place in the given order, from 1 on. Computes ``df``.

    Rows are dealt out by ranges of the order and checkpointed with the number of their range. The
    counts of the ranges, one row each, tell how many rows come before a range, so no task ever
    holds more than one of them.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(
        df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    )
    earlier = Window.orderBy("_counted").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy(F.col("_range").alias("_counted"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_counted", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        dealt.withColumn("_inside", inside)
        .join(F.broadcast(before), F.col("_range") == F.col("_counted"))
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_range", "_counted", "_inside", "_before")
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names.

    In local mode without such a folder a temporary one is set; a cluster must name one.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None) or None
        if folder is None and context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="linecite-checkpoint-")
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into a table in the checkpoint folder, of which later reads take the
    columns they need. The table stays there until the folder is cleared.
    """
    path = f"{shared_folder(df.sparkSession)}/linecite-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
