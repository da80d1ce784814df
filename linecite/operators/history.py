"""Search history: a table of coverage records, added one by one and kept to the newest.

Records of the same microsecond are told apart by their other columns, so "the newest" never depends on
the order of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linecite.settings import HISTORY_ENTRIES, REPORTED_SKIPS
from linecite.sources.history_files import HistoryFiles, Manifest

_STRINGS = T.ArrayType(T.StringType())
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("roots", _STRINGS),
        T.StructField("globs", _STRINGS),
        T.StructField("scanned_files", T.LongType()),
        T.StructField("matched_files", T.LongType()),
        T.StructField("skipped_files", _STRINGS),
        T.StructField("errors", _STRINGS),
        T.StructField("limits_applied", T.MapType(T.StringType(), T.IntegerType())),
    ]
)
TOP_ROOTS = 5


def coverage_record(summary: DataFrame) -> DataFrame:
    """A summary row as a history record, stamped now and ordered by the stamp."""
    now = F.current_timestamp()
    stamped = (
        summary.withColumn("timestamp", now)
        .withColumn("seq", F.unix_micros(now))
        .withColumn("skipped_files", F.slice("skipped_files", 1, REPORTED_SKIPS))
    )
    return stamped.select(*[F.col(f.name).cast(f.dataType) for f in RECORD_SCHEMA])


def save_coverage(summary: DataFrame, table_path: str, compact_at: int = HISTORY_ENTRIES) -> None:
    """Append the record, and compact once more than ``compact_at`` records lie beside the base.

    Appends do not read, so concurrent searches lose nothing.
    """
    coverage_record(summary).coalesce(1).write.mode("append").parquet(table_path)
    files = HistoryFiles(table_path)
    if len(set(files.records()).difference(files.manifest().covered)) > compact_at:
        compact_history(summary.sparkSession, table_path)


def load_history(spark: SparkSession, table_path: str) -> DataFrame:
    """The retained records; none if nothing was saved.

    The frame can be read until the compaction after the next one removes its files.
    """
    files = HistoryFiles(table_path)
    return retained(_read(spark, files.live(files.manifest(), files.records())))


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], RECORD_SCHEMA)
    return spark.read.schema(RECORD_SCHEMA).parquet(*paths)


def clear_history(spark: SparkSession, table_path: str) -> None:
    spark.createDataFrame([], RECORD_SCHEMA).write.mode("overwrite").parquet(table_path)


def _newest_first() -> list:
    ties = ["timestamp", "scanned_files", "matched_files", "roots", "globs", "skipped_files", "errors"]
    return [F.col(c).desc() for c in ["seq", *ties]] + [F.array_sort(F.map_entries("limits_applied")).desc()]


def retained(history: DataFrame, entries: int = HISTORY_ENTRIES) -> DataFrame:
    """The newest entries. Small top-k by ``seq``, not a ranking of the whole table."""
    return history.orderBy(*_newest_first()).limit(entries)


def compact_history(spark: SparkSession, table_path: str) -> None:
    """Put the retained entries into one base file, in place.

    The base is written first and counts once the manifest that names it is there; a run that is lost
    on its way leaves the table as it was. Records saved meanwhile stay beside the base. Of several
    compactions at once one counts, and the others' records stay live.
    """
    files = HistoryFiles(table_path)
    # The manifest first: records that it covers may be gone when they are listed, others never are.
    before = files.manifest()
    records = files.records()
    name, path = files.new_base(before.number + 1)
    retained(_read(spark, files.live(before, records))).coalesce(1).write.parquet(path)
    files.commit(Manifest(before.number + 1, name, tuple(records)))
    files.remove_before(before)


def last_coverage(history: DataFrame) -> DataFrame:
    """The newest record with missing fields defaulted; no row without history."""
    none = F.array().cast("array<string>")
    defaults = {
        "roots": none,
        "globs": none,
        "scanned_files": F.lit(0).cast("bigint"),
        "matched_files": F.lit(0).cast("bigint"),
        "skipped_files": none,
        "errors": none,
        "limits_applied": F.create_map().cast("map<string,int>"),
    }
    return (
        retained(history, 1)
        .select(*[F.coalesce(F.col(c), d).alias(c) for c, d in defaults.items()])
        # The stored record keeps the first skips only, so this total may be below the search's.
        .withColumn("skipped_total", F.size("skipped_files").cast("bigint"))
        .withColumn("errors_total", F.size("errors").cast("bigint"))
    )


def history_totals(history: DataFrame) -> DataFrame:
    """One row: number of searches and the newest one's timestamp."""
    return history.agg(
        F.count(F.lit(1)).alias("total_searches"),
        F.max_by("timestamp", "seq").alias("latest_search"),
    )


def top_roots(history: DataFrame, n: int = TOP_ROOTS) -> DataFrame:
    """The most searched roots: ``rank, root, searches``; ties in order of first use.

    Counting combines before the shuffle, so a root that dominates costs nothing extra.
    """
    counted = (
        history.select("seq", F.posexplode("roots").alias("_pos", "root"))
        .groupBy("root")
        .agg(F.count(F.lit(1)).alias("searches"), F.min(F.struct("seq", "_pos")).alias("_first"))
        .orderBy(F.col("searches").desc(), "_first")
        .limit(n)
    )
    entries = counted.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("searches")).alias("k"), "_first", "root")))
        .alias("_entries")
    )
    return entries.select(F.posexplode("_entries").alias("_pos", "_entry")).select(
        (F.col("_pos") + 1).cast("int").alias("rank"),
        F.col("_entry.root").alias("root"),
        (-F.col("_entry.k")).alias("searches"),
    )


def history_summary(history: DataFrame) -> DataFrame:
    """Totals of the retained entries beside each of their top roots; null root without any."""
    history = retained(history)
    return history_totals(history).join(F.broadcast(top_roots(history)), how="left", on=F.lit(True))
