"""Personal data: exact base kinds, and boosted trees over further candidates. All native.

Base kinds (email, ip, card, phone) are patterns with a check. They never cross a line and are found
leftmost and without overlap, per kind. Their patterns are written so that each start fails at once
inside a run that has failed already, and so that the JVM neither backtracks nor recurses in long runs.

Beyond them, generators of high recall propose spans that may overlap: long runs of letters and
digits (``secret``), groups of digits (``number``) and disguised addresses (``handle``). Format and
context make the features of a candidate: lengths, character classes, groups, the words before it.
Gradient boosted trees, fitted to a seeded sample of ``TRAINING_ROWS`` made-up lines, score it. Per
kind, the threshold is the lowest margin whose precision on held-out lines is at least ``PRECISION``.
Candidates above it that touch no base span are added; where added ones overlap, the first kind stays.

Null and empty texts have no spans. Rows are handled one by one, so repeated rows, null ids, empty
tables and further columns need no care. The work on a text grows with its length and its spans:
arrays are made in blocks, overlaps are found in one walk in order, and texts are cut from chunks.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecite.llm.boosting import Trees, fit_trees

TRAINING_ROWS = 3000
PRECISION = 0.99
SEED = 17

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("handle", "secret", "number")

_LOCAL = r"[A-Za-z0-9._%+-]"
_LABEL = r"[A-Za-z0-9-]"
#: ``\G`` is where the last match ended: a new one may begin there though it is inside a run.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "handle": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+ ?(?:\(at\)|\[at\]|\(AT\)|\[AT\]) ?{_LABEL}++"
    rf"(?: ?(?:\(dot\)|\[dot\]|\(DOT\)|\[DOT\]|\.) ?{_LABEL}++)++",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+",
    "number": r"(?<![A-Za-z0-9+.])\(?[0-9][0-9 ()./-]{5,}[0-9]",
}
#: Cheap tests that every text with a match of the kind passes.
_HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "handle": lambda t: t.rlike(r"[(\[](?:at|AT)[)\]]"),
    "secret": lambda t: t.rlike(r"[A-Za-z0-9_+/=-]{16}"),
    "number": lambda t: t.rlike(r"[0-9][0-9 ()./-]{5}"),
}
_CONTEXT = 28
_SPAN = "struct<start:int,end:int,value:string,before:string>"
#: Items of a block of a walk.
_BLOCK = 64
#: Characters of a chunk that texts are cut from.
_CHUNK = 512


def _once(value: Column, body: Callable) -> Column:
    """``body`` of a value that is made once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _walked(items: Column, item_type: str, start: Column, step: Callable) -> Column:
    """An array made in one walk over ``items``.

    ``step(state, item)`` gives the next state and the item to add, null for none. An aggregate copies
    its state at every step, so an array must not grow in it with all items: one walk finds the states
    in which blocks begin, and then each block grows its own array.
    """

    def ahead(state: Column, item: Column) -> Column:
        return step(state, item)[0]

    def begin(known: Column, block: Column) -> Column:
        state = known["state"]
        return F.struct(
            F.aggregate(block, state, ahead).alias("state"), F.concat(known["begins"], F.array(state)).alias("begins")
        )

    def grow(block: Column, state: Column) -> Column:
        def add(known: Column, item: Column) -> Column:
            after, new = step(known["state"], item)
            found = F.array_compact(F.array(new.cast(item_type)))
            return F.struct(after.alias("state"), F.concat(known["out"], found).alias("out"))

        none = F.array().cast(f"array<{item_type}>")
        return F.aggregate(block, F.struct(state.alias("state"), none.alias("out")), add, lambda known: known["out"])

    def all_blocks(blocks: Column) -> Column:
        no_states = F.filter(F.array(start), lambda _: F.lit(False))
        zero = F.struct(start.alias("state"), no_states.alias("begins"))
        begins = F.aggregate(blocks, zero, begin, lambda known: known["begins"])
        return F.flatten(F.zip_with(blocks, begins, grow))

    def cut(items: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(_BLOCK)), lambda _: F.size(items) > 0)
        return _once(F.transform(starts, lambda at: F.slice(items, at, _BLOCK)), all_blocks)

    return _once(items, cut)


def located(text: Column, kind: str) -> Column:
    """The matches of a kind with their places in code points and the characters before them.

    ``array<struct<start,end,value,before>>``.
    """
    pattern = F.lit(PATTERNS[kind])
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("between"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
    )

    def step(state: Column, part: Column) -> tuple[Column, Column]:
        start = state["at"] + F.length(part["between"])
        before = F.right(F.concat(state["before"], part["between"]), F.lit(_CONTEXT))
        match = F.coalesce(part["match"], F.lit(""))
        end = start + F.length(match)
        span = F.struct(start.alias("start"), end.alias("end"), part["match"].alias("value"), before.alias("before"))
        after = F.right(F.concat(before, match), F.lit(_CONTEXT))
        return (
            F.struct(end.alias("at"), after.alias("before")),
            F.when(part["match"].isNotNull(), span),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("before"))
    spans = _walked(parts, _SPAN, begin, step)
    return F.when(_HINTS[kind](text), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a text of digits passes the check sum."""
    back = F.split(F.reverse(digits), "")
    doubled = F.transform(
        back,
        lambda d, i: F.when(
            i % 2 == 1, F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)
        ).otherwise(d.cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        return F.forall(F.split(value, r"\."), lambda p: small(p) & (p.cast("double") <= 255))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(_digits(value))).otherwise(False)
    return (n >= 10) & (n <= 15)


def base_spans(text: Column, kind: str) -> Column:
    """The matches of a base kind that pass its check."""
    spans = located(text, kind)
    return spans if kind == "email" else F.filter(spans, lambda s: _valid(kind, s["value"]))


# ---- candidates -----------------------------------------------------------------------------

_SECRET_WORDS = r"(?i)(?:token|secret|passw|api|key|auth|bearer|credential)"
_CALL_WORDS = r"(?i)(?:tel|phone|call|fax|mobile|cell|contact|ssn|social)"


def features(span: Column, kind: str) -> Column:
    """``array<double>``: format and context of a candidate."""
    value, before = span["value"], span["before"]
    size = F.length(value)
    digits = F.length(_digits(value))
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    flags = [
        before.rlike(_SECRET_WORDS),
        before.rlike(_CALL_WORDS),
        before.rlike(r"[=:]\s*[\"']?$"),
        value.rlike("^[0-9a-fA-F]+$"),
        value.rlike("[a-z]") & value.rlike("[A-Z]"),
        F.contains(value, F.lit("(")),
        F.contains(value, F.lit("/")),
        value.rlike(r"^(?:19|20)[0-9][0-9][^0-9]") | value.rlike(r"[^0-9](?:19|20)[0-9][0-9]$"),
        value.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"),
        value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
    ]
    numbers = [
        size,
        digits,
        letters,
        size - digits - letters,
        F.size(F.split(value, "[^0-9]+")),
        F.size(F.array_distinct(F.split(value, ""))),
        F.lit(ADDED_KINDS.index(kind)),
        *[F.coalesce(f, F.lit(False)).cast("int") for f in flags],
    ]
    return F.array(*[n.cast("double") for n in numbers])


def with_candidates(text: Column, kind: str) -> Column:
    """The spans of a generator with their features."""
    return F.transform(
        located(text, kind),
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), features(s, kind).alias("f")
        ),
    )


# ---- training -------------------------------------------------------------------------------

_FILLER = (
    "the of and with from this that here thing order page item note line part case time year under "
    "over after before report value total about which there other these those"
).split()


def training_lines(rows: int = TRAINING_ROWS, seed: int = SEED) -> list[tuple[str, str, int]]:
    """``kind, line, label``: made-up lines with one candidate each, personal data or a look-alike."""
    pick = random.Random(seed)

    def chars(alphabet: str, least: int, most: int) -> str:
        return "".join(pick.choice(alphabet) for _ in range(pick.randint(least, most)))

    def digits(n: int) -> str:
        return chars("0123456789", n, n)

    hexes, both = "0123456789abcdef", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"
    lower = "abcdefghijklmnopqrstuvwxyz"

    def secret() -> tuple[str, int]:
        name = pick.choice(["token", "api_key", "secret", "password", "auth key", "bearer"])
        mark = pick.choice([" = \"", "=", ": ", ": \"", " = '"])
        value = pick.choice([chars(hexes, 24, 64), chars(both, 20, 48), "sk_" + chars(both, 20, 30)])
        end = mark[-1] if mark[-1] in "\"'" else ""
        return f"{name}{mark}{value}{end}", 1

    def no_secret() -> tuple[str, int]:
        return pick.choice([
            chars(lower, 16, 30),
            "-".join(chars(lower, 3, 8) for _ in range(4)) + "-" + digits(4),
            pick.choice("=-_+") * pick.randint(16, 60),
            "/".join(chars(lower, 4, 9) for _ in range(4)),
            chars(lower, 4, 8) + "_" + chars(lower, 4, 8) + "_" + digits(4) + "_" + chars(lower, 4, 8),
            "key " + chars(lower, 17, 28),
            "value = " + "_".join(chars(lower, 4, 8) for _ in range(4)),
            digits(pick.randint(16, 24)),
            chars(hexes, 20, 40),
        ]), 0

    def number() -> tuple[str, int]:
        word = pick.choice(["tel", "phone", "call", "fax", "mobile", "contact"]) + pick.choice([" ", ": "])
        return pick.choice([
            word + f"({digits(3)}) {digits(3)}-{digits(4)}",
            word + f"{digits(3)}-{digits(3)}-{digits(4)}",
            word + f"{digits(3)}.{digits(3)}.{digits(4)}",
            word + f"0{digits(3)} {digits(7)}",
            f"({digits(3)}) {digits(3)}-{digits(4)}",
            "ssn " + f"{digits(3)}-{digits(2)}-{digits(4)}",
            "social security " + f"{digits(3)}-{digits(2)}-{digits(4)}",
        ]), 1

    def no_number() -> tuple[str, int]:
        year = pick.randint(1900, 2030)
        return pick.choice([
            f"{year}-{pick.randint(10, 12)}-{pick.randint(10, 28)}",
            f"{pick.randint(10, 28)}/{pick.randint(10, 12)}/{year}",
            f"{year}-{year + 9}",
            f"{pick.randint(1, 9)}.{digits(3)}.{digits(3)}",
            f"{pick.randint(1, 9)} {digits(3)} {digits(3)}",
            digits(pick.randint(7, 20)),
            f"{digits(2)} {digits(3)} {digits(2)} {digits(3)}",
            f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}",
            f"{pick.randint(1, 9)}.{digits(1)}.{digits(1)}.{digits(1)}.{digits(2)}",
            f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}",
            f"call {year}/{year + 1}",
        ]), 0

    def handle() -> tuple[str, int]:
        at = pick.choice([" (at) ", "[at]", " [at] ", "(at)"])
        dot = pick.choice([" (dot) ", "[dot]", "."])
        return chars(lower, 3, 9) + at + chars(lower, 4, 9) + dot + pick.choice(["com", "org", "net"]), 1

    def no_handle() -> tuple[str, int]:
        return f"{chars(lower, 3, 9)} (at) {pick.choice(['noon', 'home', 'last'])}. {chars('ABC', 1, 1)}{chars(lower, 9, 20)}", 0

    makers = {"secret": (secret, no_secret), "number": (number, no_number), "handle": (handle, no_handle)}
    lines = []
    for i in range(rows):
        kind = ADDED_KINDS[i % 3]
        value, label = makers[kind][pick.random() < 0.6]()
        words = [pick.choice(_FILLER) for _ in range(8)]
        lines.append((kind, f"{' '.join(words[:4])} {value} {' '.join(words[4:])}", label))
    return lines


@dataclass(frozen=True)
class PiiModel:
    trees: Trees
    #: Least margin per added kind.
    thresholds: dict[str, float]


def train(spark: SparkSession, rows: int = TRAINING_ROWS, seed: int = SEED) -> PiiModel:
    """Fit the trees to made-up lines; the features come from the expressions used in scoring."""
    lines = training_lines(rows, seed)
    table = spark.createDataFrame(
        [(i, *line) for i, line in enumerate(lines)], "i int, kind string, text string, label int"
    )
    text = F.col("text")
    by_kind = [F.when(F.col("kind") == k, with_candidates(text, k)) for k in ADDED_KINDS]
    found = table.select("i", "kind", "label", F.explode(F.coalesce(*by_kind)).alias("c"))
    got = sorted(found.select("i", "kind", "label", "c.start", "c.f").collect())
    x = np.array([r["f"] for r in got], float)
    y = np.array([r["label"] for r in got], float)
    fitting = np.array([r["i"] % 4 != 3 for r in got])
    trees = fit_trees(x[fitting], y[fitting])
    margins, thresholds = trees.margins(x), {}
    for kind in ADDED_KINDS:
        own = ~fitting & np.array([r["kind"] == kind for r in got])
        thresholds[kind] = calibrated(margins[own], y[own])
    return PiiModel(trees, thresholds)


def calibrated(margins: np.ndarray, labels: np.ndarray, precision: float = PRECISION) -> float:
    """The lowest margin at and above which the precision is reached; not below zero."""
    order = np.argsort(-margins, kind="stable")
    right = np.cumsum(labels[order]) / np.arange(1, len(order) + 1)
    ends = np.append(margins[order][1:] != margins[order][:-1], True)
    good = np.flatnonzero((right >= precision) & ends)
    return max(0.0, float(margins[order][good[-1]])) if len(good) else float("inf")


# ---- spans ----------------------------------------------------------------------------------


_PLACED = "struct<start:int,rank:int,end:int,kind:string>"


def _last(rank: int) -> Column:
    """A span behind all others, before which a walk gives what it still holds."""
    end = F.lit((1 << 31) - 1)
    return F.struct(end.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit("").alias("kind"))


def _beside(taken: Column, fresh: Column, rank: int) -> Column:
    """``taken`` in order, and those spans of ``fresh`` that touch none of it.

    ``fresh`` has the given rank, higher than all of ``taken``, and its spans do not overlap each other.
    So one walk in order is enough: a fresh span waits until the next one comes, and goes if it starts
    inside what was taken before it or if something taken starts inside it.
    """

    def step(state: Column, span: Column) -> tuple[Column, Column]:
        waiting, reach = state["waiting"], state["reach"]
        is_fresh = span["rank"] == rank
        hit = span["start"] < waiting["end"]
        free = F.when(span["start"] >= reach, span)
        next_state = F.struct(
            F.when(is_fresh, free).otherwise(F.when(~F.coalesce(hit, F.lit(False)), waiting)).alias("waiting"),
            F.when(is_fresh, reach).otherwise(F.greatest(reach, span["end"])).alias("reach"),
        )
        return next_state, F.when(is_fresh, waiting).otherwise(span)

    begin = F.struct(F.lit(None).cast(_PLACED).alias("waiting"), F.lit(0).alias("reach"))
    union = F.array_sort(F.concat(taken, fresh, F.array(_last(rank))))
    merged = F.array_sort(_walked(union, _PLACED, begin, step))
    return F.when(F.size(fresh) > 0, merged).otherwise(taken)


def _placed(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


def with_spans(docs: DataFrame, model: PiiModel, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs``, ``_text`` (null: empty), base spans per kind, ``_base``, ``_all``.

    ``_base`` and ``_all`` are arrays of ``start, rank, end, kind`` in order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("_text"))
    rows = rows.select(
        *keep, "_text", *[base_spans(F.col("_text"), k).alias(f"_{k}") for k in BASE_KINDS]
    )
    base = F.array_sort(
        F.concat(*[_placed(F.col(f"_{k}"), k, i) for i, k in enumerate(BASE_KINDS)])
    )
    rows = rows.withColumn("_base", base)
    for i, kind in enumerate(ADDED_KINDS):
        scored = F.filter(
            with_candidates(F.col("_text"), kind),
            lambda c: model.trees.score(lambda f: F.element_at(c["f"], f + 1))
            >= F.lit(model.thresholds[kind]),
        )
        rows = rows.withColumn(f"_{kind}", _placed(scored, kind, len(BASE_KINDS) + i))
    rows = rows.withColumn("_all", F.col("_base"))
    for i, kind in enumerate(ADDED_KINDS):
        rows = rows.withColumn("_all", _beside(F.col("_all"), F.col(f"_{kind}"), len(BASE_KINDS) + i))
    return rows


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def find_pii(docs: DataFrame, model: PiiModel) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: counts of base spans, their hash, and all spans as text."""
    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])
    return rows.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"),
        _listed(F.col("_all")).alias("spans"),
    )


def _merged(spans: Column) -> Column:
    """Overlapping spans as one, of the first one's kind; ``spans`` are in order."""

    def step(state: Column, span: Column) -> tuple[Column, Column]:
        run = state["run"]
        inside = F.coalesce(span["start"] < run["end"], F.lit(False))
        longer = F.struct(
            run["start"].alias("start"), run["rank"].alias("rank"),
            F.greatest(run["end"], span["end"]).alias("end"), run["kind"].alias("kind"),
        )
        return F.struct(F.when(inside, longer).otherwise(span).alias("run")), F.when(~inside, run)

    begin = F.struct(F.lit(None).cast(_PLACED).alias("run"))
    return _walked(F.concat(spans, F.array(_last(0))), _PLACED, begin, step)


def _replaced(text: Column, spans: Column) -> Column:
    """The text with its spans replaced by their kinds in brackets."""

    def cut(chunks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / _CHUNK).cast("int")
        count = F.floor((end - 1) / _CHUNK).cast("int") - first + 1
        near = F.array_join(F.slice(chunks, first + 1, count), "")
        return F.when(end > start, F.substring(near, start % _CHUNK + 1, end - start)).otherwise("")

    def pieces(runs: Column, chunks: Column) -> Column:
        shown = F.transform(
            runs,
            lambda run, i: F.concat(
                cut(chunks, F.when(i > 0, F.get(runs, i - 1)["end"]).otherwise(0), run["start"]),
                F.lit("["), F.upper(run["kind"]), F.lit("]"),
            ),
        )
        return F.concat(F.array_join(shown, ""), cut(chunks, F.get(runs, F.size(runs) - 1)["end"], F.length(text)))

    whole = F.struct(
        _merged(spans).alias("runs"),
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0)).alias("chunks"),
    )
    return _once(whole, lambda once: pieces(once["runs"], once["chunks"]))


def redact_pii(docs: DataFrame, model: PiiModel) -> DataFrame:
    """``docs`` with each span of its ``text`` replaced by its kind in brackets.

    Overlapping spans are replaced together, under the first one's kind. ``n_chars``, if there is such
    a column, follows the text. Texts without spans are unchanged.
    """
    own = "_pii_row"
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(own), "text")
    rows = with_spans(packed, model, [own])
    redacted = _replaced(F.col("_text"), F.col("_all"))
    rows = rows.select(
        own, F.when(F.size("_all") > 0, redacted).otherwise(F.col(own)["text"]).alias("_new"), F.size("_all").alias("_n")
    )
    columns = []
    for name, kind in docs.dtypes:
        value = F.col(own)[name]
        if name == "text":
            value = F.col("_new")
        elif name == "n_chars":
            value = F.when(F.col("_n") > 0, F.length("_new").cast(kind)).otherwise(value)
        columns.append(value.alias(name))
    return rows.select(*columns)
