"""How the sources of a language differ in their terms, by hash-consed segment trees.

A term is a run of letters A to Z, lower-cased, and of characters beyond ASCII. A language keeps the
terms of at least ``LEAST_DOCUMENTS`` of its documents. A group (language and source) gives a kept term
the share ``p = 1 + floor(10^9 (count + 1) / (N + V))``, N its occurrences of kept terms and V their
number. The divergence of a group from another, or from its language, sums or lists
``floor((p - q)^2 / q)``. All numbers are integers.

Kept terms of a language are dealt by hash to blocks of a bounded number of groups times terms, and in a
block they are numbered from the rarest on. Over these ids every group has a segment tree of counts.
Trees are built from the leaves up, those of all groups together, and a subtree is known by the numbers
of its halves, so groups with the same counts share a node: rare terms are absent from most groups.
Two trees are then walked at the same time from their roots down. A pair of nodes that several places
of two groups lead to is followed once, with the number of its places, so each pair of counts is priced
once for each pair of groups. Blocks return one sum for each pair of groups and the best terms of each
group; the sums add up.

Null texts, languages and sources are empty strings. Repeated rows are documents like others. A group
without terms, or a language without kept ones, has pairs of value 0 if nothing differs. An empty table
gives an empty result; further columns are ignored. Tasks that count hold ``COMBINED`` terms, or those
of the longest text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linecite.llm.common import prepare, slices, stored

LEAST_DOCUMENTS = 3
TOP_TERMS = 200
SHARE = 1_000_000_000
#: Groups times terms of a block.
BLOCK_SIZE = 250_000
#: Terms that a counting task holds before it passes them on.
COMBINED = 200_000
#: Node pairs that are followed side by side, about.
FRONTIER = 2_000_000

#: Bytes to lower-case letters, bytes of characters beyond ASCII, or a space.
_TERM_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TERM_BYTES).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term in each group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in slices(batches):
            langs, sources = (batch.column(c).to_pylist() for c in ("lang", "source"))
            for lang, source, text in zip(langs, sources, batch.column("text").cast(pa.binary())):
                found = terms(text.as_py())
                n, in_docs = counts.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                n.update(found)
                in_docs.update(set(found))
                held += len(n)
                if held > COMBINED:
                    yield from _counted(counts)
                    counts, held = {}, 0
        yield from _counted(counts)

    rows = docs.select(
        *[F.make_valid_utf8(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("lang", "source", "text")]
    )
    counted = rows.mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return (
        counted.groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumn("term", F.col("term").cast("string"))
    )


def _counted(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, in_docs) in counts.items():
        found = list(n)
        columns = [
            pa.array([lang] * len(found), pa.string()),
            pa.array([source] * len(found), pa.string()),
            pa.array(found, pa.binary()),
            pa.array([n[t] for t in found], pa.int64()),
            pa.array([in_docs[t] for t in found], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


class SharedTrees:
    """Segment trees over the rows of a matrix of counts, equal subtrees being one node.

    ``counts`` has a row per group and a column per term id. ``values`` are the different counts; a
    leaf is known by the place of its count there, and ``len(values)`` is a leaf beyond the last term.
    """

    def __init__(self, counts: np.ndarray):
        self.values, leaves = np.unique(counts, return_inverse=True)
        leaves = leaves.reshape(counts.shape)
        width = 1 << max(0, counts.shape[1] - 1).bit_length()
        nodes = np.full((counts.shape[0], width), len(self.values), np.int64)
        nodes[:, : counts.shape[1]] = leaves
        #: Left and right half of each node, a level at a time from the leaves up.
        self.halves: list[tuple[np.ndarray, np.ndarray]] = []
        n_nodes = len(self.values) + 1
        while nodes.shape[1] > 1:
            both = nodes[:, ::2] * n_nodes + nodes[:, 1::2]
            pairs, nodes_ = np.unique(both, return_inverse=True)
            self.halves.append((pairs // n_nodes, pairs % n_nodes))
            nodes, n_nodes = nodes_.reshape(both.shape), len(pairs)
        #: The node of each group's whole tree.
        self.roots = nodes[:, 0]

    def leaf_pairs(self, first: np.ndarray, second: np.ndarray):
        """``pair, a, b, times``: the leaves met at the same places of the trees ``first[i]``, ``second[i]``.

        Each combination of leaves is returned once for each pair of trees, with its number of places.
        """
        pair = np.arange(len(first))
        a, b, times = self.roots[first], self.roots[second], np.ones(len(first), np.int64)
        for left, right in reversed(self.halves):
            pair, times = np.concatenate([pair, pair]), np.concatenate([times, times])
            a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
            size = int(max(a.max(), b.max())) + 1
            key = (pair * size + a) * size + b
            order = np.argsort(key)
            key = key[order]
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            times = np.add.reduceat(times[order], heads)
            one = order[heads]
            pair, a, b = pair[one], a[one], b[one]
        real = a < len(self.values)
        return pair[real], a[real], b[real], times[real]


def shares(counts: np.ndarray, total, kept: int) -> np.ndarray:
    """``1 + floor(10^9 (count + 1) / (total + kept))``, exactly."""
    if int(counts.max(initial=0)) < (1 << 62) // SHARE:
        return 1 + (SHARE * (counts + 1)) // (total + kept)
    large = SHARE * (counts.astype(object) + 1) // (np.asarray(total, object) + kept)
    return (1 + large).astype(np.int64)


def group_divergences(counts: np.ndarray, totals: np.ndarray, kept: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``a, b, value, value back`` of all pairs of rows of ``counts``, in bounded runs of pairs."""
    trees = SharedTrees(counts)
    p = shares(trees.values[None, :], totals[:, None], kept)
    n = len(counts)
    run = max(1, FRONTIER // max(1, counts.shape[1]))
    rows_left = np.arange(n - 1, -1, -1)
    ends = np.cumsum(rows_left)
    for start in range(0, n * (n - 1) // 2, run):
        number = np.arange(start, min(start + run, n * (n - 1) // 2))
        first = np.searchsorted(ends, number, side="right")
        second = n - (ends[first] - number)
        pair, a, b, times = trees.leaf_pairs(first, second)
        pa_, pb = p[first[pair], a], p[second[pair], b]
        squared = (pa_ - pb) ** 2
        there, back = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        np.add.at(there, pair, squared // pb * times)
        np.add.at(back, pair, squared // pa_ * times)
        yield first, second, there, back


def top_terms(names: np.ndarray, counts: np.ndarray, p: np.ndarray, q: np.ndarray):
    """``place, value`` of a group's terms with ``p > q`` that it has, the most divergent ones."""
    own = np.flatnonzero((counts > 0) & (p > q))
    value = (p[own] - q[own]) ** 2 // q[own]
    order = np.lexsort((names[own], -value))[:TOP_TERMS]
    return own[order], value[order]


_PRICED = "lang string, source string, part string, item string, value long"


def price_block(lang: str, cells: pa.Table, groups: pa.Table) -> pa.Table:
    """The pairs' sums and the groups' best terms of one block of a language's terms."""
    sources = np.array(groups.column("group_source").to_pylist(), object)
    order = np.argsort(sources)
    sources = sources[order]
    totals = groups.column("total").to_numpy()[order]
    kept = int(groups.column("kept")[0].as_py()) if len(sources) else 0
    names, column = np.unique(np.array(cells.column("term").to_pylist(), object), return_inverse=True)
    row = np.searchsorted(sources, np.array(cells.column("source").to_pylist(), object))
    counts = np.zeros((len(sources), len(names)), np.int64)
    counts[row, column] = cells.column("n").to_numpy()
    in_lang = counts.sum(axis=0)
    rarest = np.lexsort((names, in_lang))
    names, counts, in_lang = names[rarest], counts[:, rarest], in_lang[rarest]
    place = np.empty(len(names), np.int64)
    place[np.argsort(np.array([t.encode("utf-8", "surrogatepass") for t in names], object))] = np.arange(len(names))

    out: list[list] = [[], [], [], []]
    for first, second, there, back in group_divergences(counts, totals, kept):
        for a, b, value in ((first, second, there), (second, first, back)):
            for column_, values in zip(out, (sources[a], ["pair"] * len(a), sources[b], value)):
                column_.extend(values)
    q = shares(in_lang, int(totals.sum()), kept)
    for i, source in enumerate(sources):
        at, value = top_terms(place, counts[i], shares(counts[i], int(totals[i]), kept), q)
        for column_, values in zip(out, ([source] * len(at), ["term"] * len(at), names[at], value)):
            column_.extend(values)
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.table(
        [pa.array([lang] * len(out[0]), pa.string()), *(pa.array(c, k) for c, k in zip(out, kinds))],
        ["lang", "source", "part", "item", "value"],
    )


def source_divergence(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs(text, lang, source)``.

    Part ``pair``: how far the group is from each other source of its language. Part ``term``: the
    terms that it has more of than its language, at most ``TOP_TERMS``. Ranked by value, then item.
    """
    prepare(docs.sparkSession)
    cells = stored(count_terms(docs), "term-counts")
    kept = cells.groupBy("lang", "term").agg(F.sum("docs").alias("in_docs")).where(F.col("in_docs") >= LEAST_DOCUMENTS)
    kept_cells = stored(
        cells.drop("docs").join(kept.select("lang", "term"), ["lang", "term"]), "kept-term-counts"
    )
    every = docs.select(
        *[F.make_valid_utf8(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("lang", "source")]
    )
    totals = kept_cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (
        every.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"))
        .join(totals, ["lang", "source"], "left")
        .select("lang", F.col("source").alias("group_source"), F.coalesce("total", F.lit(0).cast("long")).alias("total"))
    )
    per_lang = (
        groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups"))
        .join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang")
        .withColumn("blocks", F.ceil(F.col("kept") * F.col("n_groups") / BLOCK_SIZE).cast("long"))
        .select("lang", "kept", "blocks")
    )
    groups, per_lang = stored(groups, "groups"), stored(per_lang, "languages")

    dealt = kept_cells.join(per_lang, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "n"
    )
    of_blocks = groups.join(per_lang, "lang").select(
        F.col("lang").alias("group_lang"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("group_block"),
        "group_source", "total", "kept",
    )

    def price(key: tuple[pa.Scalar, ...], cells: pa.Table, groups: pa.Table) -> pa.Table:
        return price_block(key[0].as_py(), cells, groups)

    priced = (
        dealt.groupBy("lang", "block")
        .cogroup(of_blocks.groupBy("group_lang", "group_block"))
        .applyInArrow(price, _PRICED)
    )
    priced = stored(priced, "divergences")

    others = groups.select("lang", F.col("group_source").alias("item"))
    sums = priced.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = (
        groups.select("lang", F.col("group_source").alias("source"))
        .join(others, "lang")
        .where(F.col("source") != F.col("item"))
        .join(sums, ["lang", "source", "item"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    )
    best = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked_pairs = pairs.withColumn("rank", F.row_number().over(best))
    ranked_terms = (
        priced.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP_TERMS)
    )
    return ranked_pairs.unionByName(ranked_terms)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t
    FROM documents),
  w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  c AS (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
  k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCUMENTS}),
  l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
  g AS (SELECT DISTINCT lang, source FROM d),
  own AS (SELECT lang, source, sum(c.n)::HUGEINT AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
  p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
           1 + ({SHARE} * (coalesce(c.n, 0) + 1)) // (coalesce(own.n, 0) + l.v) AS p,
           1 + ({SHARE} * (k.n + 1)) // (l.n + l.v) AS q
    FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN own USING (lang, source)
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  s AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
  best AS (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value
    FROM p WHERE n > 0 AND p > q),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM best))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
