"""Limits and file-type tables shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

# Search results depend on them.
STANDARD_LIMITS = {"max_files": 5000, "max_matches": 2000, "max_file_bytes": 10485760}
DEFAULT_CONTEXT_LINES = 2
STANDARD_CSV_ROWS = 1000
DEFAULT_GLOBS = ("**/*.txt", "**/*.md", "**/*.py")
HISTORY_ENTRIES = 50
REPORTED_SKIPS = 10
TEXT_EXTENSIONS = (".txt", ".md", ".log")
CODE_EXTENSIONS = (".py", ".js", ".ts", ".json", ".yaml", ".yml", ".toml", ".ini")
DATA_EXTENSIONS = (".csv",)
DOCUMENT_EXTENSIONS = (".docx", ".pdf")

PLAIN_EXTENSIONS = TEXT_EXTENSIONS + CODE_EXTENSIONS + DATA_EXTENSIONS
SUPPORTED_EXTENSIONS = PLAIN_EXTENSIONS + DOCUMENT_EXTENSIONS

#: As a limit, the same as none.
UNLIMITED = -1


def resolve_limit(value: int | None, standard: int) -> int | None:
    """The limit in force, or ``None`` when there is none. 0 stands for the standard one."""
    if value is None or value == UNLIMITED:
        return None
    if value < 0:
        raise ValueError(f"limit must be positive, 0 (standard) or UNLIMITED: {value}")
    return value or standard


@dataclass(frozen=True)
class Limits:
    """Limits of one search. ``None`` fields are not limited."""

    max_files: int | None = None
    max_matches: int | None = None
    max_file_bytes: int | None = None

    @classmethod
    def of(cls, max_files=None, max_matches=None, max_file_bytes=None) -> "Limits":
        return cls(
            resolve_limit(max_files, STANDARD_LIMITS["max_files"]),
            resolve_limit(max_matches, STANDARD_LIMITS["max_matches"]),
            resolve_limit(max_file_bytes, STANDARD_LIMITS["max_file_bytes"]),
        )
