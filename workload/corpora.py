"""The driver's tables as corpora, and document bytes that Spark derives from them."""

from __future__ import annotations

import io
import zipfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecite import table_corpus
from linecite.functions.paths import extension, kind
from linecite.operators.topn import shared_folder
from linecite.sources.documents import SLICE_ROWS
from linecite.sources.tables import spread

# By doc_id % 7: every branch of the type checks gets files, in both spellings of case.
EXTENSIONS = (".txt", ".md", ".PY", ".csv", ".log", ".xyz", ".docx")
#: The same, but all of them searchable.
SUPPORTED = tuple(".json" if e == ".xyz" else e for e in EXTENSIONS)


# Tables of texts, with the columns that identify a text.
_KEYS = {
    "documents": ["doc_id"],
    "conversations": ["conv_id", "turn"],
    "pages": ["page_id"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan, *_KEYS[name]) if name in _KEYS else scan


def _suffix(extensions) -> Column:
    return F.element_at(
        F.array(*[F.lit(e) for e in extensions]), (F.col("doc_id") % 7 + 1).cast("int")
    )


def _named(docs: DataFrame, suffix: Column) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), suffix))
    return table_corpus(docs, path, "text", "source")


def documents(spark: SparkSession, sf_dir: str, extensions=EXTENSIONS) -> DataFrame:
    """``documents``: root = source, path = source/lang/doc_id + extension."""
    return _named(table(spark, sf_dir, "documents"), _suffix(extensions))


def documents_and_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under names that are searched, and beside them those that ``documents`` gives a
    type that is not: no text is passed over, and there are skips to report."""
    both = F.array_distinct(F.array(_suffix(SUPPORTED), _suffix(EXTENSIONS)))
    docs = table(spark, sf_dir, "documents").withColumn("suffix", F.explode(both))
    return _named(docs, F.col("suffix"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations``: one file per turn."""
    path = F.concat(F.col("role"), F.lit("/"), "conv_id", F.lit("-"), "turn", F.lit(".md"))
    return table_corpus(table(spark, sf_dir, "conversations"), path, "text", "role")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages``: one file per page."""
    path = F.concat(F.lit("web/"), "page_id", F.lit(".txt"))
    return table_corpus(table(spark, sf_dir, "pages"), path, "html", F.lit("web"))


def tree(spark: SparkSession, sf_dir: str) -> str:
    """``documents`` as long text files in the shared folder, a file per task, each text ended by a line feed."""
    folder = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").select("text").write.text(folder)
    place = urlparse(folder)
    if place.scheme not in ("", "file"):
        raise ValueError("a tree needs a shared folder that every executor mounts")
    return place.path


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as UTF-8 bytes: ``path, ext, kind, content``."""
    corpus = documents(spark, sf_dir).withColumn("ext", extension(F.col("path")))
    return corpus.select(
        "path", "ext", kind(F.col("ext")).alias("kind"), F.encode("text", "UTF-8").alias("content")
    )


_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx_bytes(paragraphs: list[str]) -> bytes:
    """A minimal word-processing package with the given body paragraphs."""
    body = "".join(
        f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs
    )
    return docx_package(body)


def docx_package(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr(
            "word/document.xml",
            f'<?xml version="1.0" encoding="UTF-8"?>'
            f'<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>',
        )
    return out.getvalue()


def as_docx(df: DataFrame) -> DataFrame:
    """Turn ``content`` (UTF-8 text) into word-processing bytes, a paragraph per line."""

    at = df.columns.index("content")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(start, SLICE_ROWS)
                packed = [docx_bytes(bytes(c.as_py()).decode("utf-8").split("\n")) for c in rows.column(at)]
                columns = [*rows.columns[:at], pa.array(packed, pa.binary()), *rows.columns[at + 1 :]]
                yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names)

    return df.mapInArrow(pack, df.schema)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a search history: the event type is the root, its user the scanned count."""
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.array("event_type").alias("roots"),
        F.array(F.lit("*")).alias("globs"),
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("scanned_files"),
        F.lit(1).cast("bigint").alias("matched_files"),
        F.array(F.concat(F.lit("Unsupported file type: "), "event_type")).alias("skipped_files"),
        none.alias("errors"),
        F.create_map(F.lit("max_files"), F.lit(5000)).alias("limits_applied"),
    )
