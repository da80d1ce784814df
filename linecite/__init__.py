"""Cited text search over large corpora, as Spark DataFrame operators."""

from linecite.functions.predicates import LineMatcher
from linecite.operators.listing import Listing, list_corpus
from linecite.plans.reports import ask, ask_report, search_report, sources_report
from linecite.plans.search import (
    SearchOutput,
    directory_texts,
    list_directory,
    search,
    search_directory,
)
from linecite.settings import STANDARD_LIMITS, UNLIMITED, Limits
from linecite.sources.tables import table_corpus

__all__ = [
    "STANDARD_LIMITS",
    "UNLIMITED",
    "LineMatcher",
    "Limits",
    "Listing",
    "SearchOutput",
    "ask",
    "ask_report",
    "directory_texts",
    "list_corpus",
    "list_directory",
    "search",
    "search_directory",
    "search_report",
    "sources_report",
    "table_corpus",
]
