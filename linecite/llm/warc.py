"""WARC archives with a two-level capture index.

``write_archives`` gives each page a gzip member in an archive file: a response with the payload, or a
revisit where a page with a smaller id has the same payload of at least ``LEAST_PAYLOAD`` bytes. Files
are written by tasks through Arrow's file systems into a shared folder; a repeated task writes files of
other names, and only those whose rows Spark keeps are known to the index.

``write_index`` sorts captures by a key of the reversed host, the rest of the address and the page, and
cuts them into compressed blocks; each index file ends with its sparse directory, the first key and
place of every block. What the driver holds is one row per index file. A lookup finds the file and the
block by binary search, reads that block's range, finds the capture in it by binary search, and reads
the record's range from its archive.

A null address counts as empty, a null html as an empty payload. Pages without an id are written and
read back; among equal payloads they are responses only if no page has an id. Rows that repeat the
response's id and payload are responses too. An empty table gives no archive. Further columns are
ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecite.llm.common import prepare, scratch_path, slices, stored

LEAST_PAYLOAD = 100
ARCHIVE_BYTES = 256 << 20
BLOCK_LINES = 1000
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def capture_key(url: str | None, page_id: int | None) -> str:
    """The sort key: host labels from the last on, the rest of the address, the page."""
    text = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    try:
        parts = urlsplit(text)
        host, rest = parts.hostname or "", text[text.find(parts.netloc) + len(parts.netloc) :]
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        host, rest, port = "", text, ""
    page = "-" if page_id is None else f"{page_id + (1 << 63):020d}"
    return f"{','.join(reversed(host.split('.')))}{port}){rest} {page}"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.rstrip(">").rpartition(":")[2]
    return None if number == "none" else int(number)


def record(page_id, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One WARC record. A revisit has the head of the response, which tells the payload's size."""
    revisit = refers_to is not None
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    block = head.encode() + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target or 'urn:unknown'}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a record; a response's digest is taken from its payload again."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("payload does not match its digest")
    refers_to = fields.get("WARC-Refers-To")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": None if refers_to is None else _page(refers_to),
        "payload": payload,
    }


def with_roles(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, size, digest, refers_to`` of ``pages(page_id, url, html)``."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns(
        {"size": F.length("payload").cast("long"), "digest": F.sha2("payload", 256)}
    )
    shared = (
        rows.where(F.col("size") >= LEAST_PAYLOAD)
        .groupBy(F.col("digest").alias("shared_digest"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    joined = rows.join(shared, F.col("digest") == F.col("shared_digest"), "left")
    first = F.col("first_id")
    refers_to = F.when(first.isNotNull() & ~first.eqNullSafe(F.col("page_id")), first)
    return joined.select("page_id", "url", "payload", "size", "digest", refers_to.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages below ``folder``; ``page_id, key, archive, offset, length`` per record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in slices(batches, 64):
            rows = []
            columns = ("page_id", "url", "payload", "size", "digest", "refers_to")
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip.compress(record(*row), compresslevel=6, mtime=0)
                out.write(member)
                rows.append((row[0], capture_key(row[1], row[0]), name, at, len(member)))
                at += len(member)
            c = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), k) for v, k in zip(c, kinds)], ["page_id", "key", "archive", "offset", "length"]
            )
        if out is not None:
            out.close()

    return with_roles(pages).mapInArrow(
        write, "page_id long, key string, archive string, offset long, length long"
    )


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write index files; ``file, first_key, directory_at, directory_length`` of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        out, at, lines, directory, first = None, 0, [], [], None
        name = f"{uuid.uuid4().hex}.index"

        def flush() -> None:
            nonlocal at
            block = zlib.compress("\n".join(lines).encode(), 6)
            directory.append([lines[0].split("\t", 1)[0], at, len(block)])
            out.write(block)
            at += len(block)
            lines.clear()

        for batch in slices(batches):
            columns = ("key", "archive", "offset", "length")
            for key, *place in zip(*(batch.column(c).to_pylist() for c in columns)):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out, first = system.open_output_stream(f"{root}/{name}", compression=None), key
                lines.append("\t".join(map(str, (key, *place))))
                if len(lines) == block_lines:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        tail = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(tail)
        out.close()
        yield pa.RecordBatch.from_pydict(
            {"file": [name], "first_key": [first], "directory_at": [at], "directory_length": [len(tail)]}
        )

    tasks = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(tasks, "key").sortWithinPartitions("key", "archive", "offset")
    return ordered.mapInArrow(
        write, "file string, first_key string, directory_at long, directory_length long"
    )


class CaptureIndex:
    """Lookups by key. ``files``: rows of :func:`write_index`, ordered by first key."""

    def __init__(self, folder: str, files: list[tuple[str, str, int, int]]):
        self.folder, self.files = folder, files
        self.firsts = [f[1].encode() for f in files]
        self._directories: dict[int, tuple[list[bytes], list]] = {}
        self._blocks: OrderedDict[tuple[int, int], tuple[list[bytes], list[str]]] = OrderedDict()
        self._system = None

    def _range(self, name: str, at: int, length: int) -> bytes:
        if self._system is None:
            self._system, self._root = fs.FileSystem.from_uri(self.folder)
        with self._system.open_input_file(f"{self._root}/{name}") as file:
            return file.read_at(length, at)

    def _directory(self, i: int):
        if i not in self._directories:
            name, _, at, length = self.files[i]
            rows = json.loads(zlib.decompress(self._range(name, at, length)))
            if len(self._directories) > 8:
                self._directories.clear()
            self._directories[i] = ([r[0].encode() for r in rows], rows)
        return self._directories[i]

    def _block(self, i: int, b: int):
        if (i, b) not in self._blocks:
            _, at, length = self._directory(i)[1][b]
            lines = zlib.decompress(self._range(self.files[i][0], at, length)).decode().split("\n")
            self._blocks[i, b] = ([x.split("\t", 1)[0].encode() for x in lines], lines)
            if len(self._blocks) > 8:
                self._blocks.popitem(last=False)
        return self._blocks[i, b]

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """The places ``archive, offset, length`` of all captures under a key."""
        wanted, found = key.encode(), []
        # Captures of one key may go on into following blocks, and begin in the one before.
        i = max(0, bisect.bisect_left(self.firsts, wanted) - 1)
        while i < len(self.files) and self.firsts[i] <= wanted:
            firsts, _ = self._directory(i)
            b = max(0, bisect.bisect_left(firsts, wanted) - 1)
            while b < len(firsts) and firsts[b] <= wanted:
                keys, lines = self._block(i, b)
                for n in range(bisect.bisect_left(keys, wanted), bisect.bisect_right(keys, wanted)):
                    _, archive, offset, length = lines[n].split("\t")
                    found.append((archive, int(offset), int(length)))
                b += 1
            i += 1
        return found


def read_captures(keys: DataFrame, archives: str, index_folder: str, index: DataFrame) -> DataFrame:
    """The records of distinct ``key`` values, one row per capture.

    The index rows that come to the driver are one per index file.
    """
    files = sorted((tuple(r) for r in index.collect()), key=lambda r: r[1].encode())
    lookup = CaptureIndex(index_folder, files)
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(archives)
        open_files: OrderedDict[str, pa.NativeFile] = OrderedDict()
        for batch in slices(batches):
            rows = []
            for key in batch.column("key").to_pylist():
                for archive, offset, length in lookup.find(key):
                    if archive not in open_files:
                        open_files[archive] = system.open_input_file(f"{root}/{archive}")
                        if len(open_files) > 64:
                            open_files.popitem(last=False)[1].close()
                    data = gzip.decompress(open_files[archive].read_at(length, offset))
                    found = parse_record(data)
                    rows.append(tuple(found[n] for n in names))
            c = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(c, kinds)], list(names))

    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(tasks, "key").sortWithinPartitions("key")
    return ordered.mapInArrow(
        read,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` and their index to the shared folder, then read every capture back."""
    spark = pages.sparkSession
    prepare(spark)
    folder = scratch_path(spark, "warc")
    archives, index_folder = f"{folder}/archives", f"{folder}/index"
    captures = stored(write_archives(pages, archives), "captures")
    index = stored(write_index(captures, index_folder), "index")
    return read_captures(captures.select("key").distinct(), archives, index_folder, index)
