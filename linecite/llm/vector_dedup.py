"""Embedding near-duplicates by an inverted multi-index.

Vectors are halved, and each half has its own codebook, fitted by k-means to a bounded sample. The pairs
of codewords form a grid; every vector is indexed in the cell of its two nearest codewords. A vector
visits cells from the nearest on by the multi-sequence walk: a cell costs the squared distance that the
vector's halves would have to move to get there, which is how far they are from the planes between
codewords. The walk ends at a cost that a partner at exactly the least cosine exceeds with a chance
of ``1 - TARGET_RECALL``, measured on sampled vectors moved to that cosine in random directions.
Candidates in visited cells are verified in double precision. A pair counts if either end visits the
other's cell, so pairs are missed much less often than that chance says.

Equal vectors of a label are folded first and counted by their number. Members and visitors of a cell
are split into blocks of ``BLOCK``, so no task holds a crowded cell, and a pair of blocks returns counts
and one edge per vector, never pairs.

Vectors link only under equal labels that are not null, and equal lengths. Vectors that are null,
empty, zero or hold a null or non-finite number link with nothing, nor do those without an id. Rows that
repeat an id are vectors like others and count as links of each other. An empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecite.llm.common import hash_share, prepare, slices, stored
from linecite.llm.components import connected_components

LEAST_COSINE = 0.93
TARGET_RECALL = 0.98
#: Vectors that codebooks are fitted to, at most about.
SAMPLE_ROWS = 4096
BLOCK = 2048
#: Vectors of the largest label per grid cell that the number of codewords aims at, and the most codewords of a half.
PER_CELL = 64
MOST_CODEWORDS = 256


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Codewords of rows ``x``, begun at rows spread over the sample."""
    centers = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        nearest = squared_distances(x, centers).argmin(axis=1)
        for i in range(len(centers)):
            own = x[nearest == i]
            if len(own):
                centers[i] = own.mean(axis=0)
    return centers


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers**2).sum(axis=1)
    return np.maximum(d, 0)


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Cells ``cost, i, j`` in the order of ``first[i] + second[j]``, each once."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, reached = [(float(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}
    while heap:
        cost, i, j = heapq.heappop(heap)
        yield cost, int(a[i]), int(b[j])
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(a) and n[1] < len(b) and n not in reached:
                reached.add(n)
                heapq.heappush(heap, (float(first[a[n[0]]] + second[b[n[1]]]), *n))


class Grid:
    """The codebooks of vectors of one length, and the cost at which a walk ends."""

    def __init__(self, sample: np.ndarray, codewords: int, least: float, recall: float):
        self.half = sample.shape[1] // 2
        self.books = [k_means(sample[:, : self.half], codewords), k_means(sample[:, self.half :], codewords)]
        self.gaps = [np.sqrt(squared_distances(b, b)) for b in self.books]
        self.width = len(self.books[1])
        noise = np.random.default_rng(5).standard_normal(sample.shape)
        noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
        size = np.linalg.norm(noise, axis=1, keepdims=True)
        noise /= np.where(size == 0, 1, size)
        moved = least * sample + np.sqrt(1 - least**2) * noise
        costs, home = self.costs(sample), self.cells(moved)
        reached = costs[0][np.arange(len(sample)), home // self.width] + costs[1][
            np.arange(len(sample)), home % self.width
        ]
        self.limit = float(np.quantile(reached, recall)) + 1e-9

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each unit vector."""
        i, j = (squared_distances(h, b).argmin(axis=1) for h, b in zip(self._halves(x), self.books))
        return i * self.width + j

    def costs(self, x: np.ndarray) -> list[np.ndarray]:
        """Per half, the squared distance to the region of each codeword."""
        result = []
        for h, book, gap in zip(self._halves(x), self.books, self.gaps):
            d = squared_distances(h, book)
            near = d.argmin(axis=1)
            apart = np.maximum(gap[near], 1e-12)
            plane = (d - d[np.arange(len(d)), near][:, None]) / (2 * apart)
            plane[np.arange(len(d)), near] = 0
            result.append(plane**2)
        return result

    def visited(self, x: np.ndarray) -> list[list[int]]:
        """The cells that each unit vector visits, its own first."""
        first, second = self.costs(x)
        out = []
        for a, b in zip(first, second):
            cells = []
            for cost, i, j in multi_sequence(a, b):
                if cost > self.limit:
                    break
                cells.append(i * self.width + j)
            out.append(cells)
        return out


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_grids(folded: DataFrame, least: float, recall: float, rows: int) -> dict[int, Grid]:
    """A :class:`Grid` per vector length, from a bounded sample."""
    grids = {}
    # A label is searched by itself, so the grid is made for the largest one.
    sizes = folded.groupBy("dims", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("dims").agg(F.sum("n").alias("n"), F.max("n").alias("largest"))
    for size in sizes.collect():
        own = folded.where(F.col("dims") == size["dims"])
        share = rows / size["n"]
        sample = own.where(hash_share(F.col("node"), share, "grid")).limit(2 * rows).select("node", "unit")
        found = sorted(sample.collect())
        if found:
            codewords = min(MOST_CODEWORDS, max(4, int((size["largest"] / PER_CELL) ** 0.5)))
            grids[size["dims"]] = Grid(np.array([r["unit"] for r in found]), codewords, least, recall)
    return grids


def fold(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with the hashes of their vector, and the usable distinct vectors."""
    e = F.col("embedding")
    numbers = F.transform(e, lambda v: v.cast("double"))
    squared = F.aggregate(numbers, F.lit(0.0), lambda a, v: a + v * v)
    bad = F.exists(numbers, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & ~bad & (squared > 0)
        & ~F.isnan(squared) & (squared < float("inf"))
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumns(
        {"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit("second"), "label", "embedding")}
    )
    distinct = rows.where("usable").groupBy("h1", "h2").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("times"),
    )
    unit = F.transform("embedding", lambda v: v.cast("double") / F.sqrt(squared))
    distinct = distinct.select(
        F.monotonically_increasing_id().alias("node"), "h1", "h2",
        F.col("label").cast("string").alias("label"), "first_id", "times", unit.alias("unit"),
        F.size("embedding").alias("dims"),
    )
    return rows.drop("embedding", "label"), stored(distinct, "vectors")


def linked_blocks(visitors, members, least: float):
    """Link counts and edges between two blocks.

    A block is ``nodes, unit vectors, times, homes, visited`` (sets). Counts go to the visitor; also to the
    member if it does not visit the visitor's cell, so that each end of a pair is told once.
    """
    linked = visitors[1] @ members[1].T >= least
    linked &= visitors[0][:, None] != members[0][None, :]
    counts = linked @ members[2]
    back = np.zeros(len(members[0]), np.int64)
    for home in np.unique(visitors[3]):
        blind = np.array([home not in v for v in members[4]])
        if blind.any():
            own = visitors[3] == home
            back += (linked[own].T @ visitors[2][own]) * blind
    # Smallest node among those connected, over and over.
    left, right = visitors[0].copy(), members[0].copy()
    rows, columns = np.nonzero(linked)
    while len(rows):
        low = np.minimum(left[rows], right[columns])
        new_left, new_right = left.copy(), right.copy()
        np.minimum.at(new_left, rows, low)
        np.minimum.at(new_right, columns, low)
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    nodes = np.concatenate([visitors[0], members[0]])
    return nodes, np.concatenate([counts, back]), np.concatenate([left, right])


def find_links(folded: DataFrame, grids: dict[int, Grid], least: float) -> DataFrame:
    """``node, links, root``: partial counts and edges of the distinct vectors."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            columns = [batch.column(c).to_pylist() for c in ("node", "label", "times", "unit", "dims")]
            by_length: dict[int, list[tuple]] = {}
            for row in zip(*columns):
                by_length.setdefault(row[4], []).append(row)
            for dims, rows in by_length.items():
                x = _unit([r[3] for r in rows])
                homes = grids[dims].cells(x)
                for row, home, cells in zip(rows, homes.tolist(), grids[dims].visited(x)):
                    out.append((*row, home, cells if home in cells else [home, *cells]))
            c = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            names = ["node", "label", "times", "unit", "dims", "home", "cells"]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(c, kinds)], names)

    placed = folded.select("node", "label", "times", "unit", "dims").mapInArrow(
        visit, "node long, label string, times long, unit array<double>, dims int, home int, cells array<int>"
    )
    placed = stored(placed, "placed")
    visits = placed.select("*", F.explode("cells").alias("cell"))
    sizes = visits.groupBy("label", "dims", "cell").agg(
        F.count(F.lit(1)).alias("n_visits"), F.count_if(F.col("cell") == F.col("home")).alias("n_members")
    ).where("n_members > 0 and n_visits > 1")
    blocks = sizes.select(
        F.col("label").alias("l"), F.col("dims").alias("d"), F.col("cell").alias("c"),
        F.ceil(F.col("n_visits") / BLOCK).cast("int").alias("visit_blocks"),
        F.ceil(F.col("n_members") / BLOCK).cast("int").alias("member_blocks"),
    )
    rows = visits.join(
        blocks, (F.col("label") == F.col("l")) & (F.col("dims") == F.col("d")) & (F.col("cell") == F.col("c"))
    )
    spread = F.xxhash64("node")
    as_visitor = rows.select(
        "*", F.lit(True).alias("visitor"), F.pmod(spread, F.col("visit_blocks")).cast("int").alias("v"),
        F.explode(F.sequence(F.lit(0), F.col("member_blocks") - 1)).alias("m"),
    )
    as_member = rows.where("cell = home").select(
        "*", F.lit(False).alias("visitor"),
        F.explode(F.sequence(F.lit(0), F.col("visit_blocks") - 1)).alias("v"),
        F.pmod(spread, F.col("member_blocks")).cast("int").alias("m"),
    )
    wanted = ["label", "dims", "cell", "v", "m", "visitor", "node", "times", "unit", "home", "cells"]
    pairs = as_visitor.select(wanted).unionByName(as_member.select(wanted))

    def compare(group: pa.Table) -> pa.Table:
        c = {n: group.column(n).to_numpy() for n in ("visitor", "node", "times", "home")}
        flat = group.column("unit").combine_chunks()
        unit = flat.flatten().to_numpy().reshape(len(group), -1)
        visited = [set(v) for v in group.column("cells").to_pylist()]

        def block(own: np.ndarray):
            return (
                c["node"][own], unit[own], c["times"][own], c["home"][own], [visited[i] for i in np.flatnonzero(own)]
            )

        is_visitor = c["visitor"].astype(bool)
        nodes, links, roots = linked_blocks(block(is_visitor), block(~is_visitor), least)
        keep = (links > 0) | (roots != nodes)
        return pa.table(
            {"node": nodes[keep], "links": links[keep].astype(np.int64), "root": roots[keep]}
        )

    return pairs.groupBy("label", "dims", "cell", "v", "m").applyInArrow(
        compare, "node long, links long, root long"
    )


def vector_components(
    vectors: DataFrame,
    least: float = LEAST_COSINE,
    recall: float = TARGET_RECALL,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors(vec_id, embedding, label)``."""
    prepare(vectors.sparkSession)
    rows, folded = fold(vectors)
    grids = fit_grids(folded, least, recall, sample_rows)
    found = stored(find_links(folded, grids, least), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "counted")
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = folded.join(parts.withColumnRenamed("node", "placed"), F.col("node") == F.col("placed"), "left").select(
        "node", "h1", "h2", "times", "first_id", F.coalesce("component", "node").alias("component")
    )
    named = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    told = (
        placed.join(named, "component")
        .join(counts, F.col("node") == F.col("counted"), "left")
        .select(
            F.col("h1").alias("g1"), F.col("h2").alias("g2"), "component_id",
            (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"),
        )
    )
    joined = rows.join(
        told, F.col("usable") & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left"
    )
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
