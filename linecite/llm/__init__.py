"""Operators for preparing training data: filters, deduplication, redaction, tokens, archives.

Nothing else in the library imports this package.
"""
