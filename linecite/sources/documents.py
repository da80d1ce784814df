"""Text of documents held as bytes: plain text in the JVM, DOCX and PDF in Python workers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Mapping
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecite.functions.text import decode_utf8
from linecite.sources.directory import read_bytes, read_file

#: Bytes of a document to its text.
Extractor = Callable[[bytes], str]
#: Rows, and characters of text, that leave a worker at a time, about.
SLICE_ROWS = 256
SLICE_CHARACTERS = 1 << 20

# Names in the WordprocessingML format.
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MARKUP_TEXT = {"tab": "\t", "ptab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}


def docx_text(content: bytes) -> str:
    """Body paragraphs joined by line feeds. Tables, headers and footers are not read."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(_WORD + "body")
    if body is None:
        raise ValueError("no document body")
    return "\n".join(_paragraph_text(p) for p in body.findall(_WORD + "p"))


def _paragraph_text(paragraph: ElementTree.Element) -> str:
    out = []
    for child in paragraph:
        if child.tag == _WORD + "r":
            runs = [child]
        elif child.tag == _WORD + "hyperlink":
            runs = child.findall(_WORD + "r")
        else:
            continue
        for part in (part for run in runs for part in run):
            name = part.tag.removeprefix(_WORD)
            if name == "t":
                out.append(part.text or "")
            elif name == "br" and part.get(_WORD + "type", "textWrapping") != "textWrapping":
                # Page and column breaks carry no text.
                continue
            else:
                out.append(_MARKUP_TEXT.get(name, ""))
    return "".join(out)


def join_pages(pages: Iterator[Callable[[], str]]) -> str:
    """Pages each followed by a line feed; a page that cannot be read is left out.

    For PDF extractors: ``lambda content: join_pages(page.text for page in decode(content))``.
    """
    text = []
    for page in pages:
        try:
            text.append(page() + "\n")
        except Exception:
            continue
    return "".join(text)


#: There is no PDF decoder here: register one as ``{**EXTRACTORS, "pdf": my_decoder}``.
EXTRACTORS: Mapping[str, Extractor] = {"docx": docx_text}


def _extract(
    extractors: Mapping[str, Extractor], kind: str, content: bytes | None, error: str | None
) -> tuple[str | None, str | None]:
    """Text or error of one document; never an exception."""
    label = kind.upper()
    if kind not in extractors:
        return None, f"Skipped {label}: {label} decoder not available"
    if error is None and content is not None:
        try:
            return extractors[kind](content), None
        except Exception as problem:
            error = str(problem)
    return None, f"Skipped {label}: Failed to extract {label} text: {error}"


def _schema(df: DataFrame, kept: list[str]) -> str:
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept]
    return ", ".join([*columns, "text string", "error string"])


def extract_documents(df: DataFrame, extractors: Mapping[str, Extractor] = EXTRACTORS) -> DataFrame:
    """``content binary`` of ``kind`` docx or pdf to ``text`` and ``error``; one row in, one out.

    A missing decoder or a bad file gives an error, never an exception. Documents are taken from an
    Arrow batch one by one and their texts leave in short runs, so that memory beside the batch is
    that of one document and a run, however many rows a batch has.
    """
    kept = [c for c in df.columns if c not in ("content", "text", "error")]
    extractors = dict(extractors)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(kept)
            given = [batch.column(c) for c in ("kind", "content", "error")]
            start, results, size = 0, [], 0
            for i in range(batch.num_rows):
                results.append(_extract(extractors, *(column[i].as_py() for column in given)))
                size += len(results[-1][0] or "")
                if size >= SLICE_CHARACTERS or len(results) == SLICE_ROWS or i + 1 == batch.num_rows:
                    texts, errors = (pa.array(list(c), pa.string()) for c in zip(*results))
                    columns = rows.slice(start, len(results)).columns
                    start, results, size = i + 1, [], 0
                    yield pa.RecordBatch.from_arrays([*columns, texts, errors], names=[*kept, "text", "error"])

    source = df if "error" in df.columns else df.withColumn("error", F.lit(None).cast("string"))
    return source.select(*kept, "content", "error").mapInArrow(extract, _schema(df, kept))


def read_documents(
    files: DataFrame, partitions: int, extractors: Mapping[str, Extractor] = EXTRACTORS
) -> DataFrame:
    """Read and extract in one worker step, so that only text travels to the JVM.

    Rows leave one by one: a package can unpack to far more text than it has bytes.
    """
    kept = [c for c in files.columns if c not in ("content", "text", "error")]
    extractors = dict(extractors)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, names = batch.column("kind").to_pylist(), batch.column("path").to_pylist()
            for i, (kind, path) in enumerate(zip(kinds, names)):
                text, error = _extract(extractors, kind, *read_file(path))
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns, pa.array([text], pa.string()), pa.array([error], pa.string())],
                    names=[*row.schema.names, "text", "error"],
                )

    return (
        files.select(*kept)
        .repartition(partitions, F.col("path"))
        .mapInArrow(read, _schema(files, kept))
    )


def read_text(df: DataFrame) -> DataFrame:
    """``content binary`` of plain-text files to ``text`` and ``error``. Stays in the JVM."""
    failed = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    kept = [c for c in df.columns if c not in ("content", "text", "error")]
    return df.select(
        *kept,
        decode_utf8(F.col("content")).alias("text"),
        F.when(
            failed.isNotNull(), F.concat(F.lit("Error reading "), "path", F.lit(": "), failed)
        ).alias("error"),
    )


def read_text_file(files: DataFrame, max_bytes: int, partitions: int | None = None) -> DataFrame:
    """Files (``path, length``) to ``path, text, truncated, size, reason``.

    Files above ``max_bytes`` are not opened: null text and a reason. A file that cannot be read
    has a reason too.
    """
    fits = F.coalesce(F.col("length") <= max_bytes, F.lit(True))
    read = read_bytes(files.where(fits).select("path", "length"), partitions)
    failed = F.concat(F.lit("Failed to read file "), "path", F.lit(": "), "error")
    texts = read.select(
        "path",
        decode_utf8(F.col("content")).alias("text"),
        F.lit(False).alias("truncated"),
        F.when(F.col("error").isNull(), F.col("length")).alias("size"),
        failed.alias("reason"),
    )
    large = files.where(~fits).select(
        "path",
        F.lit(None).cast("string").alias("text"),
        F.lit(True).alias("truncated"),
        F.lit(None).cast("bigint").alias("size"),
        F.concat(
            F.lit("File too large ("), "length", F.lit(f" > {max_bytes} bytes)")
        ).alias("reason"),
    )
    return texts.unionByName(large)


def corpus_texts(
    files: DataFrame, partitions: int, extractors: Mapping[str, Extractor] = EXTRACTORS
) -> DataFrame:
    """``text`` and ``error`` of listed files: one branch per kind, each file read once."""
    documents = F.col("kind").isin("docx", "pdf")
    plain = read_text(read_bytes(files.where(~documents), partitions))
    extracted = read_documents(files.where(documents), partitions, extractors)
    return plain.unionByName(extracted)
