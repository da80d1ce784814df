"""Search, ask and sources as reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from linecite.operators import report
from linecite.operators.history import last_coverage
from linecite.plans.search import SearchOutput


def search_report(output: SearchOutput) -> DataFrame:
    """The search report. The corpus is read once; snippets stay as they are."""
    output = output.computed()
    return report.search_report(output.matcher.query, output.found, output.summary())


def ask(output: SearchOutput) -> SearchOutput:
    """The same search with secrets removed from its snippets, as every answer shows them."""
    return replace(output, redacted=True, answers=True)


def ask_report(output: SearchOutput) -> DataFrame:
    """Answer, redacted citations, coverage and confidence. The query is the question."""
    output = ask(output).computed()
    return report.ask_report(output.matcher.query, output.key_points(), output.found, output.summary())


def sources_report(history: DataFrame) -> DataFrame:
    """Coverage of the last recorded search; no row without history."""
    return report.sources_report(last_coverage(history))
