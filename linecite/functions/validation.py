"""Checks on queries and on JSON documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes a query invalid, or draws a warning.
DANGEROUS_PATTERNS = (
    r"\*\*.*\*\*",
    r"\+\+\+",
    r"\*\{1000,\}",
    r"\(\.\*\)\{50,\}",
)
LONG_QUERY = 1000
DANGEROUS_MESSAGE = "Query contains potentially dangerous regex pattern"
LONG_MESSAGE = "Query is very long, may impact performance"
REQUIRED_KEYS = ("identity", "operating_rules", "modes_personas", "memory_rules")


def validate_query(query: Column) -> Column:
    """``struct<valid boolean, warnings array<string>, errors array<string>>``."""
    dangerous = F.lit(False)
    for pattern in DANGEROUS_PATTERNS:
        # (?d): only a line feed ends what "." spans.
        dangerous = dangerous | query.rlike("(?d)" + pattern)
    long = F.length(query) > LONG_QUERY
    none = F.array().cast("array<string>")
    return F.struct(
        (~dangerous).alias("valid"),
        F.when(long, F.array(F.lit(LONG_MESSAGE))).otherwise(none).alias("warnings"),
        F.when(dangerous, F.array(F.lit(DANGEROUS_MESSAGE))).otherwise(none).alias("errors"),
    )


def required_keys(document: Column, keys: Sequence[str] = REQUIRED_KEYS) -> Column:
    """``struct<valid boolean, message string>``: which top-level keys a JSON document lacks."""
    missing = F.array_except(F.array(*[F.lit(k) for k in keys]), F.json_object_keys(document))
    return F.struct(
        F.coalesce(F.size(missing) == 0, F.lit(False)).alias("valid"),
        F.when(missing.isNull(), F.lit("Document invalid JSON"))
        .when(
            F.size(missing) > 0,
            F.concat(F.lit("Document invalid. Missing: "), F.array_join(missing, ", ")),
        )
        .alias("message"),
    )
