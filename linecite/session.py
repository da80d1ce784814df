"""Session settings for searching large corpora."""

from __future__ import annotations

import importlib
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Searching is CPU-bound per byte, so tasks of moderate size even out texts of uneven length.
    "spark.sql.files.maxPartitionBytes": "128m",
    # Keeps the per-task cut of match limits ahead of the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


_shipped: set[tuple[str, str]] = set()


def ship_code(spark: SparkSession, *packages: str) -> None:
    """Make packages importable in Python workers, for sessions started without --py-files."""
    context = spark.sparkContext
    for name in packages:
        if (context.applicationId, name) in _shipped:
            continue
        folder = os.path.dirname(os.path.abspath(importlib.import_module(name).__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="linecite-code-"), f"{name}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for parent, _, files in os.walk(folder):
                for file in files:
                    if file.endswith(".py"):
                        path = os.path.join(parent, file)
                        out.write(path, os.path.relpath(path, os.path.dirname(folder)))
        context.addPyFile(archive)
        _shipped.add((context.applicationId, name))
