"""The files of a search history: records added one by one, and a base that stands for old ones.

A manifest names the base and the records it covers. Manifests are written whole under a new name, and
the one with the highest number counts, so readers see a compaction entirely or not at all. What a
manifest made needless is removed at the compaction after the next one, so that frames made before
can still be read until then.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass

from pyarrow import fs

#: Spark does not list folders whose name begins with an underscore as part of a table.
_FOLDER = "_history"


@dataclass(frozen=True)
class Manifest:
    """``covered``: names of record files whose retained rows are in the folder ``base``."""

    number: int = 0
    base: str | None = None
    covered: tuple[str, ...] = ()


class HistoryFiles:
    """The files below ``table_path``, a local path or a URI that Arrow's file systems know."""

    def __init__(self, table_path: str) -> None:
        self.path = table_path.rstrip("/")
        is_uri = "://" in table_path or table_path.startswith("file:")
        self._system, self._root = fs.FileSystem.from_uri(self.path if is_uri else os.path.abspath(self.path))

    def _names(self, folder: str) -> list[str]:
        found = self._system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(info.base_name for info in found)

    def _inner(self, name: str = "") -> str:
        return f"{self._root}/{_FOLDER}/{name}".rstrip("/")

    def records(self) -> list[str]:
        """Names of all record files."""
        return [n for n in self._names(self._root) if n.endswith(".parquet") and n[0] not in "._"]

    def manifest(self) -> Manifest:
        """The newest manifest; an empty one before the first compaction."""
        names = [n for n in self._names(self._inner()) if n.startswith("manifest-")]
        if not names:
            return Manifest()
        with self._system.open_input_stream(self._inner(names[-1])) as stream:
            value = json.loads(stream.read())
        return Manifest(value["number"], value["base"], tuple(value["covered"]))

    def live(self, manifest: Manifest, records: list[str]) -> list[str]:
        """Paths of the base and of the records beside it."""
        covered = set(manifest.covered)
        base = [] if manifest.base is None else [f"{self.path}/{_FOLDER}/{manifest.base}"]
        return base + [f"{self.path}/{name}" for name in records if name not in covered]

    def new_base(self, number: int) -> tuple[str, str]:
        """Name and path of a base to be written."""
        name = f"base-{number:012}-{uuid.uuid4().hex}"
        return name, f"{self.path}/{_FOLDER}/{name}"

    def commit(self, manifest: Manifest) -> None:
        name = f"manifest-{manifest.number:012}-{uuid.uuid4().hex}.json"
        with self._system.open_output_stream(self._inner("." + name)) as stream:
            stream.write(json.dumps(asdict(manifest)).encode())
        self._system.move(self._inner("." + name), self._inner(name))

    def remove_before(self, manifest: Manifest) -> None:
        """Remove the records that ``manifest`` covers, and bases and manifests with lower numbers."""
        present = set(self.records())
        for name in present.intersection(manifest.covered):
            self._system.delete_file(f"{self._root}/{name}")
        for name in self._names(self._inner()):
            kind, _, rest = name.partition("-")
            if kind in ("base", "manifest") and int(rest[:12]) < manifest.number:
                (self._system.delete_dir if kind == "base" else self._system.delete_file)(self._inner(name))
