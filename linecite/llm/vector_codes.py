"""Vector code compression: product codebooks by Lloyd's algorithm over cover trees.

Components become integers ``floor(1024 x)`` and vectors are cut into four parts. Each part position has
a codebook that begins as that part of the vectors with the smallest ids; in each round every part
goes to its nearest entry, ties to the lower one, and entries become the floors of their parts' means.
All numbers are integers, so results do not depend on how rows are partitioned.

Vectors are packed into chunks of ``CHUNK`` rows, inside a partition, and each part position of a chunk
gets a cover tree once: a node covers its points from its centre within a radius; points close to the
centre stay with it, the others are covered by further centres at a smaller radius. The points of a subtree
are neighbours in the tree's order, so with cumulative sums any subtree's sum is one subtraction. A round
walks the trees from their roots with the codebook. Where the triangle inequality says that all points
of a node have the same nearest entry, the whole subtree is assigned; only other nodes descend, and the
points of leaves that remain are compared exactly. A task returns one sum per entry, and codebooks,
of 256 entries, are all that reaches the driver.

Dropped: vectors that are null or hold null or non-finite components, and those whose length is not that
of the first vector or cannot be cut into four. Integers are limited to 2^24 either way, so that squares
fit; no component below 16,384 is touched. Fewer vectors than entries make fewer entries. Repeated
vectors and ids are rows like others; of equal ids the smaller vector comes first, null ids come last.
An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecite.llm.common import finite, prepare, slices, stored
from linecite.operators.topn import first_rows

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Rows that share cover trees.
CHUNK = 4096
#: Points that a tree does not split further.
LEAF = 32
#: Radius of a node over that of its children.
_SHRINK = 1.4
_MOST = 1 << 24


def as_integers(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * values.astype(np.float64))
    return np.clip(scaled, -_MOST, _MOST).astype(np.int64)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between all rows of two integer matrices, exactly."""
    bound = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    if 4 * x.shape[1] * int(bound) ** 2 < 1 << 53:
        x, y = x.astype(np.float64), y.astype(np.float64)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)


class CoverTree:
    """``points`` in the order of the tree; ``order`` their rows in the chunk.

    Nodes are numbered from the root, 0. A node covers the points ``begin`` to ``end`` within ``radius``
    of the vector in ``centers``; ``children[first_child[i] : first_child[i + 1]]`` are its parts.
    """

    def __init__(self, points: np.ndarray):
        self._x = points.astype(np.float64)
        order: list[np.ndarray] = []
        self._nodes: list[list] = []
        self._placed = 0
        self._grow(np.arange(len(points)), 0, self._distances(np.arange(len(points)), 0), order)
        self.order = np.concatenate(order)
        self.points = points[self.order].astype(np.int32)
        self.begin, self.end = (np.array([n[i] for n in self._nodes]) for i in (0, 1))
        self.centers = points[[n[2] for n in self._nodes]].astype(np.int32)
        self.radius = np.array([n[3] for n in self._nodes])
        self.first_child = np.cumsum([0, *(len(n[4]) for n in self._nodes)])
        self.children = np.array([c for n in self._nodes for c in n[4]], np.int64)
        del self._x, self._nodes, self._placed

    def _distances(self, rows: np.ndarray, center: int) -> np.ndarray:
        apart = self._x[rows] - self._x[center]
        return np.sqrt(np.einsum("ij,ij->i", apart, apart))

    def _grow(self, rows: np.ndarray, center: int, away: np.ndarray, order: list[np.ndarray]) -> int:
        number = len(self._nodes)
        radius = float(away.max())
        node = [self._placed, 0, center, radius, []]
        self._nodes.append(node)
        if len(rows) <= LEAF or radius == 0:
            order.append(rows)
            self._placed += len(rows)
        else:
            reach = radius / _SHRINK
            near = away <= reach
            parts = [(rows[near], center, away[near])]
            rest, rest_away = rows[~near], away[~near]
            few: list[tuple[np.ndarray, np.ndarray]] = []
            while len(rest):
                own = int(rest[0])
                there = self._distances(rest, own)
                covered = there <= reach
                if covered.sum() * 8 > LEAF:
                    parts.append((rest[covered], own, there[covered]))
                else:  # too few for a node of their own
                    few.append((rest[covered], rest_away[covered]))
                rest, rest_away = rest[~covered], rest_away[~covered]
            for part in parts:
                node[4].append(self._grow(*part, order))
            if few:
                node[4].append(self._scattered(center, few, order))
        node[1] = self._placed
        return number

    def _scattered(self, center: int, few: list[tuple[np.ndarray, np.ndarray]], order: list[np.ndarray]) -> int:
        """A leaf of points that no child covers well."""
        rows = np.concatenate([r for r, _ in few])
        self._nodes.append([self._placed, self._placed + len(rows), center, float(max(a.max() for _, a in few)), []])
        order.append(rows)
        self._placed += len(rows)
        return len(self._nodes) - 1

    def assign(self, codebook: np.ndarray) -> tuple[np.ndarray, int]:
        """The entry nearest to each point, in the tree's order, and how many points were compared."""
        entries, numbers = np.unique(codebook, axis=0, return_index=True)
        lowest = np.argsort(numbers)
        entries, numbers = entries[lowest], numbers[lowest]
        nearest = np.empty(len(self.points), np.int64)
        open_ = np.zeros(1, np.int64)
        exact: list[np.ndarray] = []
        while len(open_):
            away = np.sqrt(squared_distances(self.centers[open_].astype(np.int64), entries).astype(np.float64))
            best = away.argmin(axis=1)
            least = away[np.arange(len(open_)), best]
            if len(entries) > 1:
                away[np.arange(len(open_)), best] = np.inf
                gap = away.min(axis=1) - least
            else:
                gap = np.full(len(open_), np.inf)
            # Distances are rounded, so a whole subtree needs a little more than twice its radius.
            radius = self.radius[open_]
            whole = gap > 2 * radius + 1e-9 * (1 + radius + least)
            for node, entry in zip(open_[whole], numbers[best[whole]]):
                nearest[self.begin[node] : self.end[node]] = entry
            open_ = open_[~whole]
            n = self.first_child[open_ + 1] - self.first_child[open_]
            exact += [np.arange(self.begin[i], self.end[i]) for i in open_[n == 0]]
            at = np.repeat(self.first_child[open_] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            open_ = self.children[at]
        compared = np.concatenate(exact) if exact else np.zeros(0, np.int64)
        if len(compared):
            apart = squared_distances(self.points[compared].astype(np.int64), entries)
            nearest[compared] = numbers[apart.argmin(axis=1)]
        return nearest, len(compared)

    def sums(self, nearest: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of the points of each entry; runs of one entry are one subtraction."""
        totals = np.zeros((len(self.points) + 1, self.points.shape[1]), np.int64)
        np.cumsum(self.points, axis=0, dtype=np.int64, out=totals[1:])
        starts = np.flatnonzero(np.append(True, nearest[1:] != nearest[:-1]))
        ends = np.append(starts[1:], len(nearest))
        of = nearest[starts]
        sums = np.zeros((entries, self.points.shape[1]), np.int64)
        np.add.at(sums, of, totals[ends] - totals[starts])
        return sums, np.bincount(of, weights=ends - starts, minlength=entries).astype(np.int64)


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def plant_trees(vectors: DataFrame, width: int) -> DataFrame:
    """``ids, labels, trees`` of chunks of ``vectors(vec_id, label, vector)``, all of one width."""
    kind = vectors.schema["label"].dataType.simpleString()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in slices(batches, CHUNK):
            while batch.num_rows:
                part = batch.slice(0, CHUNK - rows)
                held, rows, batch = [*held, part], rows + part.num_rows, batch.slice(part.num_rows)
                if rows == CHUNK:
                    yield chunk(held)
                    held, rows = [], 0
        if held:
            yield chunk(held)

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = np.concatenate([as_integers(_vectors(b, width)) for b in held])
        trees = [CoverTree(part) for part in np.split(x, PARTS, axis=1)]
        lists = []
        for name in ("vec_id", "label"):
            column = pa.chunked_array([b.column(name) for b in held]).combine_chunks()
            lists.append(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column))
        return pa.RecordBatch.from_arrays([*lists, pa.array([pickle.dumps(trees)], pa.binary())], ["ids", "labels", "trees"])

    return vectors.select("vec_id", "label", "vector").mapInArrow(chunks, f"ids array<bigint>, labels array<{kind}>, trees binary")


def _trees(batch: pa.RecordBatch) -> Iterator[tuple[int, list[CoverTree]]]:
    for i in range(batch.num_rows):
        yield i, pickle.loads(batch.column("trees")[i].as_py())


def next_codebooks(forest: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """A round of Lloyd's algorithm: entries become the floors of their points' means."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(c.shape, np.int64) for c in codebooks]
        counts = [np.zeros(len(c), np.int64) for c in codebooks]
        for batch in slices(batches, 1):
            for _, trees in _trees(batch):
                for p, (tree, codebook) in enumerate(zip(trees, codebooks)):
                    own, n = tree.sums(tree.assign(codebook)[0], len(codebook))
                    sums[p] += own
                    counts[p] += n
        for p, (own, n) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(n)
            if len(used):
                columns = [np.full(len(used), p, np.int32), used.astype(np.int32), n[used]]
                lists = pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * own.shape[1], own[used].ravel())
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], ["part", "entry", "n", "sums"])

    partial = forest.select("trees").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    means = (
        partial.select("part", "entry", "n", F.posexplode("sums").alias("place", "value"))
        .groupBy("part", "entry", "place")
        .agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    )
    moved = [c.copy() for c in codebooks]
    for part, entry, place, value, n in means.collect():  # at most as many as the codebooks' components
        moved[part][entry, place] = value // n
    return moved


def compress_vectors(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of ``vectors(vec_id, embedding, label)``.

    ``code`` has two hex digits per part, ``error`` is the squared distance to the code's entries, and
    ``label_error`` its sum over equal labels.
    """
    prepare(vectors.sparkSession)
    spark = vectors.sparkSession
    kept = vectors.select("vec_id", "label", F.col("embedding").alias("vector")).where(finite(F.col("vector")))
    kept = kept.withColumn("vec_id", F.col("vec_id").cast("long"))
    label = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, code string, error long"
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = [r["vector"] for r in first_rows(kept.select("vec_id", "vector"), by_id, 1).collect()]
    width = len(first[0]) if first else 0
    if not width or width % PARTS:
        empty = spark.createDataFrame([], schema).drop("label")
        return empty.withColumn("label_error", F.lit(0).cast("long")).withColumn("codebooks_sha256", F.lit(""))
    kept = kept.where(F.size("vector") == width)
    begin = first_rows(kept.select("vec_id", "vector"), by_id, entries).collect()
    begin.sort(key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["vector"]))
    codebooks = np.split(as_integers(np.array([r["vector"] for r in begin], np.float64)), PARTS, axis=1)
    forest = stored(plant_trees(kept, width), "cover-trees")
    for _ in range(rounds):
        codebooks = next_codebooks(forest, codebooks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for i, trees in _trees(batch):
                codes, error = [], 0
                for tree, codebook in zip(trees, codebooks):
                    nearest = tree.assign(codebook)[0]
                    apart = tree.points.astype(np.int64) - codebook[nearest]
                    own = np.empty((2, len(nearest)), np.int64)
                    own[:, tree.order] = nearest, (apart * apart).sum(axis=1)
                    codes.append(own[0])
                    error = error + own[1]
                text = [bytes(c).hex() for c in np.stack(codes, axis=1).astype(np.uint8)]
                columns = [batch.column(c).slice(i, 1).flatten() for c in ("ids", "labels")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(text, pa.string()), pa.array(error, pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    coded = stored(forest.mapInArrow(encode, schema), "vector-codes")
    of_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    digits = ",".join(str(v) for codebook in codebooks for v in codebook.ravel().tolist())
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", "error", "label_error",
        F.lit(hashlib.sha256(digits.encode()).hexdigest()).alias("codebooks_sha256"),
    )


def _oracle() -> str:
    """The rounds written out. Distances are doubles of small integers, hence exact."""
    steps = [
        f"""k AS MATERIALIZED (
      SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""x AS MATERIALIZED (
      SELECT vec_id, label, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS p
      FROM k, (SELECT unnest(range({PARTS})) AS part))""",
        f"""c0 AS MATERIALIZED (
      SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, p AS e
      FROM x QUALIFY entry < {ENTRIES})""",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
      SELECT vec_id, label, part, any_value(p) AS p, min({{'d': list_inner_product(p, p)
               - 2 * list_inner_product(p, e) + list_inner_product(e, e), 'e': entry}}) AS best
      FROM x JOIN c{i} USING (part) GROUP BY vec_id, label, part)""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (
      SELECT part, entry, list(mean ORDER BY place) AS e FROM (
        SELECT part, best.e AS entry, place, floor(sum(value) / count(*)) AS mean
        FROM (SELECT part, best, unnest(p) AS value, generate_subscripts(p, 1) AS place FROM a{i})
        GROUP BY ALL) GROUP BY part, entry)""")
            steps.append(f"""c{i + 1} AS MATERIALIZED (
      SELECT part, entry, coalesce(m{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN m{i} USING (part, entry))""")
    last = ROUNDS
    return f"""WITH {", ".join(steps)},
    h AS (
      SELECT sha256(string_agg(value::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS h
      FROM (SELECT part, entry, unnest(e) AS value, generate_subscripts(e, 1) AS place FROM c{last})),
    r AS (
      SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code,
             sum(best.d)::BIGINT AS error
      FROM a{last} GROUP BY vec_id)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           h AS codebooks_sha256 FROM r, h"""


ORACLE = _oracle()
