"""Fixture trees, written fresh for every test."""

from __future__ import annotations

from pathlib import Path

from workload.corpora import docx_bytes

HANDBOOK = """# Harbour Handbook

## Berth Policy

Boats are moored in order of arrival, and security rounds start at dusk.

### Fees

Fees are due on the first day of the month.

### Visitors

Visitors sign the log book at the gate.

## Security Rounds

Two wardens check the security lights twice a night.

### Keys

Keys to the store are kept by the warden only.

### Encryption

All radio logs are encrypted before they are archived.

## Closing

The handbook is reviewed each spring.
"""

NOTES = """Notes on the harbour, kept for new wardens.

They hold a few search terms used in drills.

Subjects:
- tide tables
- policy of the store
- ferry times

Read these notes once a season.
"""

STAFF = """name,team,policy,task
Ada,Engineering,Two keys,Check the engine
Bo,Gate,Sign in,Keep the log
Cy,Security,Rounds,Walk the pier
"""


def write(root: Path, name: str, content: str | bytes) -> None:
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content.encode() if isinstance(content, str) else content)


def harbour(root: Path) -> Path:
    write(root, "handbook.md", HANDBOOK)
    write(root, "notes.txt", NOTES)
    return root


def awkward(root: Path) -> Path:
    """Names, sizes and bytes that file sources tend to get wrong."""
    write(root, "_x.py", "needle\n")
    write(root, ".x.txt", "a needle")
    write(root, ".hidden/deep/y.md", "needle")
    write(root, "empty.txt", "")
    write(root, "sp ace%20.txt", "needle here")
    write(root, "UPPER.TXT", "NEEDLE")
    write(root, "noext", "needle")
    write(root, "data.xyz", "needle")
    write(root, "bad.txt", b"\xffneedle\r\nsecond\xc3")
    write(root, "good.docx", docx_bytes([f"needle {i}" for i in range(1, 13)]))
    write(root, "broken.docx", b"not a package")
    write(root, "any.pdf", b"%PDF-1.4 needle")
    return root
