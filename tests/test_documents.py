from __future__ import annotations

import csv
import io

import pytest

from linecite import UNLIMITED
from linecite.sources.csv_rows import cell, csv_rows, csv_summary
from linecite.sources.documents import docx_text, extract_documents, join_pages, read_text_file
from workload.corpora import docx_bytes, docx_package


def run(text: str) -> str:
    return f"<w:r>{text}</w:r>"


def test_docx_paragraphs():
    body = (
        "<w:p>" + run("<w:t>one</w:t><w:tab/><w:t>two</w:t><w:br/><w:t>three</w:t>") + "</w:p>"
        "<w:tbl><w:tr><w:tc><w:p>" + run("<w:t>cell</w:t>") + "</w:p></w:tc></w:tr></w:tbl>"
        "<w:p/>"
        "<w:p><w:hyperlink>" + run("<w:t>link</w:t>") + "</w:hyperlink>"
        + run('<w:br w:type="page"/><w:t>x</w:t><w:noBreakHyphen/><w:t>y</w:t><w:cr/>') + "</w:p>"
        "<w:p><w:ins>" + run("<w:t>inserted</w:t>") + "</w:ins>"
        "<w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p>"
    )
    assert docx_text(docx_package(body)) == "one\ttwo\nthree\n\nlinkx-y\n\n"


def test_docx_escapes_and_failures():
    assert docx_text(docx_bytes(["a < b & c", ""])) == "a < b & c\n"
    with pytest.raises(Exception):
        docx_text(b"PK nonsense")


def test_a_bad_page_is_left_out():
    def broken():
        raise RuntimeError

    assert join_pages(iter([lambda: "a", broken, lambda: "b"])) == "a\nb\n"


def test_extracted_texts_leave_in_short_runs(spark):
    """A worker must not hold all texts of an Arrow batch: here 300 of a million characters."""

    def long_text(content):
        import resource

        return f"{resource.getrusage(resource.RUSAGE_SELF).ru_maxrss} ".ljust(1_000_000, "x")

    files = spark.range(300).coalesce(1).selectExpr("id", "'pdf' AS kind", "CAST('%' AS BINARY) AS content")
    found = extract_documents(files, {"pdf": long_text}).selectExpr(
        "id", "length(text) AS size", "CAST(substring_index(text, ' ', 1) AS LONG) AS kib", "error"
    )
    rows = found.orderBy("id").collect()
    assert [(r["id"], r["size"], r["error"]) for r in rows] == [(i, 1_000_000, None) for i in range(300)]
    assert max(r["kib"] for r in rows) - min(r["kib"] for r in rows) < 100_000


def test_read_text_file(spark, tmp_path):
    names = []
    for name, content in {"a.txt": b"abc\r\n", "b.txt": b"abcdef"}.items():
        (tmp_path / name).write_bytes(content)
        names.append((str(tmp_path / name), len(content)))
    names.append((str(tmp_path / "gone.txt"), 1))
    files = spark.createDataFrame(names, "path string, length bigint")
    rows = [tuple(r)[1:] for r in read_text_file(files, 5).orderBy("path").collect()]
    assert rows[:2] == [
        ("abc\n", False, 5, None),
        (None, True, None, "File too large (6 > 5 bytes)"),
    ]
    assert rows[2][:3] == (None, False, None)
    assert rows[2][3].startswith("Failed to read file ") and "No such file" in rows[2][3]


FILES = {
    "plain.csv": b"port,depth\nLagos,7.5\nMalmo,9",
    "quoted.csv": b'a,"b\nc","d""e"\r\n"x, y",,\n',
    "ragged.csv": b"a,b\n\n1\n1,2,3\n",
    "bytes.csv": b"a\xff,b\n",
    "empty.csv": b"",
    "ten.csv": b"\n".join(b"%d" % i for i in range(10)),
    "long.csv": b"x," + b"y" * 200_000 + b"\n",
}


def contents(spark):
    rows = [(name, bytearray(content)) for name, content in FILES.items()]
    return spark.createDataFrame(rows, "path string, content binary")


def test_csv_rows_are_those_of_the_csv_module(spark):
    rows = csv_rows(contents(spark)).collect()
    csv.field_size_limit(1_000_000)
    for name, content in FILES.items():
        mine = sorted((r["row_index"], r["cells"]) for r in rows if r["path"] == name and r["cells"] is not None)
        text = io.StringIO(content.decode("utf-8", "replace").replace("\r\n", "\n"))
        assert [cells for _, cells in mine] == list(csv.reader(text))
    error = next(r["error"] for r in rows if r["path"] == "empty.csv")
    assert error.startswith("Failed to read CSV empty.csv")


@pytest.mark.parametrize(
    "limit, rows, truncated, found",
    [(None, 10, False, 10), (0, 10, False, 10), (9, 9, True, 10), (10, 10, True, 10),
     (11, 10, False, 10), (1, 1, True, 2), (UNLIMITED, 10, False, 10)],
)
def test_csv_limits(spark, limit, rows, truncated, found):
    summary = csv_summary(contents(spark), limit)
    row = summary.where("path = 'ten.csv'").first()
    assert (row["n_rows"], row["truncated"], row["total_rows_found"]) == (rows, truncated, found)
    assert row["columns"] == ["0"]


def test_csv_files_are_read_by_path(spark, tmp_path):
    paths = []
    for name, content in FILES.items():
        (tmp_path / name).write_bytes(content)
        paths.append((str(tmp_path / name),))
    paths.append((str(tmp_path / "gone.csv"),))
    by_path = csv_rows(spark.createDataFrame(paths, "path string")).collect()
    inline = csv_rows(contents(spark)).collect()

    def found(rows):
        return sorted(
            (r["path"].rsplit("/")[-1], r["row_index"], r["cells"], r["more_follow"])
            for r in rows
            if r["error"] is None
        )

    assert found(by_path) == found(inline)
    errors = {r["path"].rsplit("/")[-1] for r in by_path if r["error"]}
    assert errors == {"empty.csv", "gone.csv"}
    summary = csv_summary(spark.createDataFrame(paths, "path string"), 2).where("error is null")
    assert summary.count() == len(FILES) - 1


def test_csv_cells_and_header(spark):
    rows = csv_rows(contents(spark).where("path = 'plain.csv'"))
    found = rows.orderBy("row_index").select("cells", cell(rows["cells"], 5)).collect()
    assert [tuple(r) for r in found] == [
        (["port", "depth"], None), (["Lagos", "7.5"], None), (["Malmo", "9"], None),
    ]
