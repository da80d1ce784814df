"""Whole searches against a plain model, over random corpora, globs and limits."""

from __future__ import annotations

import fnmatch
import os
import random

import pytest

from linecite import ask, search, table_corpus

EXTENSIONS = [".txt", ".md", ".PY", ".docx", ".pdf", ".xyz", ""]
GLOBS = ["*", "*.txt", "*.md", "a/*", "**/*.docx", "[0-4]*"]
SUPPORTED = {".txt", ".md", ".py", ".docx", ".pdf"}


def selected(path, pattern):
    below = path.removeprefix("r/")
    folder, name = os.path.split(below)
    if pattern == "a/*":
        return folder == "a"
    return fnmatch.fnmatchcase(name, pattern.removeprefix("**/"))


def model(files, errors, query, globs, max_files, max_matches, max_bytes, context):
    """Listed files, matches, matched visits and skip messages: select, rank, cut, group."""

    def refusal(path):
        if len(files[path].encode()) > max_bytes:
            return f"File too large: {path}"
        ext = os.path.splitext(path)[1].lower()
        return None if ext in SUPPORTED else f"Unsupported file type: {path}"

    def label(path, n):
        unit = {".docx": "paragraph {}", ".pdf": "page {}"}.get(os.path.splitext(path)[1])
        return unit.format(n) if unit else n

    # Select: all pairs of glob and path, in order, up to the last file under the limit.
    pairs = [(g, p) for g, glob in enumerate(globs) for p in sorted(files) if selected(p, glob)]
    good = [i for i, (_, p) in enumerate(pairs) if refusal(p) is None]
    cut = good[max_files - 1] + 1 if len(good) >= max_files else len(pairs)
    skips = [refusal(p) for _, p in pairs[:cut] if refusal(p)]
    if cut < len(pairs) and pairs[cut][0] == pairs[cut - 1][0]:
        skips.append(f"Reached max_files limit ({max_files})")
    # Rank and cut: each listed pair is a visit; visits go by path.
    visits = list(enumerate(sorted(pairs[i][1] for i in good if i < cut)))
    hits = [
        (visit, path, n)
        for visit, path in visits
        if path not in errors
        for n, line in enumerate(files[path].splitlines(), 1)
        if query.lower() in line.lower()
    ][:max_matches]
    end = hits[-1][0] if len(hits) == max_matches else len(visits)
    skips += [errors[path] for visit, path in visits[:end] if path in errors]
    found = []
    for _, path, n in hits:
        snippet = "\n".join(files[path].splitlines()[max(0, n - 1 - context) : n + context])
        found.append((path, label(path, n), snippet, n))
    found.sort(key=lambda m: m[:2])
    return len(visits), found, len({visit for visit, _, _ in hits}), skips


@pytest.mark.parametrize("seed", range(6))
def test_searches_agree_with_the_model(spark, seed):
    pick = random.Random(seed)
    files, errors = {}, {}
    for i in range(40):
        path = f"r/{pick.choice(['', 'a/', 'b/c/'])}{i}{pick.choice(EXTENSIONS)}"
        lines = [pick.choice(["hit", "a HIT here", "none", ""]) for _ in range(pick.randint(0, 14))]
        files[path] = pick.choice(["\n", "\r\n", "\x0b"]).join(lines)
        if pick.random() < 0.5 and path.endswith((".docx", ".pdf")):
            errors[path] = f"Skipped: {path}"
    rows = [
        ("r", path, None if path in errors else text, len(text.encode()), errors.get(path))
        for path, text in files.items()
    ]
    schema = "root string, path string, text string, length bigint, error string"
    corpus = spark.createDataFrame(rows, schema).repartition(5)
    for _ in range(3):
        globs = pick.sample(GLOBS, pick.randint(1, 3))
        limits = {
            "max_files": pick.choice([5, 12, 25, 1000]),
            "max_matches": pick.choice([3, 20, 60, 1000]),
            "max_file_bytes": pick.choice([40, 1000]),
        }
        context = pick.choice([0, 1, 2, 20])
        output = search(corpus, "hit", globs=globs, context_lines=context, **limits)
        scanned, found, matched, skips = model(
            files, errors, "hit", globs, *limits.values(), context
        )
        mine = [
            (r["file_path"], r["location"], r["snippet"], r["line_number"])
            for r in output.ordered().collect()
        ]
        assert mine == [(p, str(location), s, n) for p, location, s, n in found]
        mine = [tuple(r) for r in ask(output).ordered().collect()]
        assert mine == [(p, str(location), s, None) for p, location, s, _ in found]
        row = output.summary().first()
        assert row["scanned_files"] == scanned
        assert row["matched_files"] == matched
        assert row["cited_files"] == len({m[0] for m in found})
        assert row["truncated"] == (len(found) >= limits["max_matches"])
        assert row["files_truncated"] == (scanned >= limits["max_files"])
        assert row["skipped_total"] == len(skips)
        assert row["skipped_files"] == skips[:10]


def test_a_plain_table_needs_no_error_column(spark):
    df = spark.createDataFrame([("r", "r/a.txt", "hit")], "root string, path string, text string")
    corpus = table_corpus(df, "path", "text", "root").drop("error")
    assert search(corpus, "hit").summary().first()["total_matches"] == 1
