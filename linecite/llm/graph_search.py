"""Approximate nearest neighbours by robust-pruned directed graphs.

Equal vectors are folded: one is indexed, with the smallest ``NEAREST + 1`` ids of its rows, more than an
answer can show. They are dealt by hash to shards of about ``SHARD_ROWS`` vectors, and each shard gets a
graph. Vectors enter it in runs: a greedy search over the graph so far proposes the ``BEAM`` nearest as
neighbours, and pruning keeps the nearest one, drops every candidate that is closer to it by the factor
``RELAX`` than to the vector, and goes on with the next, up to ``DEGREE`` edges. Edges back are pruned in
the same way where a vector has too many. Vectors that no path from the entry reaches get an edge from
the nearest one that is reached, so every vector can be found.

Queries go in blocks of ``QUERY_BLOCK`` to every shard, where a beam search from the entry, the vector
next to the mean, visits neighbours of the nearest vectors seen until the ``BEAM`` nearest have all been
visited. What it ends with is scored in double precision on the vectors as given; shards return each query's
nearest, and those of all shards are merged.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an
id. Vectors of different lengths do not meet. A repeated id is a row like others: a query leaves out one
row of its own id and vector, and equal query rows are answered once each. Fewer candidates than asked
for are all returned. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linecite.llm.common import finite, prepare, stored

NEAREST = 5
DEGREE = 32
BEAM = 64
#: How much closer to a kept neighbour than to the vector a candidate must be to be dropped.
RELAX = 1.2
SHARD_ROWS = 4096
QUERY_BLOCK = 2048
#: Vectors that enter a graph, or are searched for, side by side.
_RUN = 256
#: Nodes of a beam whose neighbours are looked at in one step.
_STEP = 4
#: Rows with one vector are first cut among this many parts of them.
_SALT = 32


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one. Scaling by powers of two first keeps squares within range."""
    x = power_scaled(x)
    return (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32)


def power_scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, which changes no cosine, so that components are below one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


class Graph:
    """A directed graph over unit vectors ``x``; ``edges`` holds neighbours by row, -1 where there is none."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None, entry: int | None = None):
        self.x = x
        self.entry = int((x @ x.mean(axis=0)).argmax()) if entry is None else entry
        if edges is None:
            self.edges = np.full((len(x), DEGREE), -1, np.int32)
            self._build()
            self._connect()
        else:
            self.edges = edges

    def search(self, queries: np.ndarray, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """``ids, distances`` of the vectors that beam searches end with, nearest first, padded by -1."""
        found = [self._beam(queries[i : i + _RUN], width) for i in range(0, len(queries), _RUN)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _beam(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(self.x), len(queries)
        ids = np.full((m, width), -1, np.int32)
        away = np.full((m, width), np.inf, np.float32)
        ids[:, 0], away[:, 0] = self.entry, 1 - queries @ self.x[self.entry]
        visited = np.zeros((m, width), bool)
        seen = np.zeros((m, n), bool)
        seen[:, self.entry] = True
        live = np.arange(m)
        while len(live):
            waiting = (ids[live] >= 0) & ~visited[live]
            waiting &= np.cumsum(waiting, axis=1) <= _STEP
            some = waiting.any(axis=1)
            live, waiting = live[some], waiting[some]
            if not len(live):
                break
            row, place = np.nonzero(waiting)
            visited[live[row], place] = True
            near = self.edges[ids[live[row], place]]
            key = (live[row][:, None] * n + near)[near >= 0]
            key = np.unique(key[~seen.ravel()[key]])
            if not len(key):
                continue
            seen.ravel()[key] = True
            who, node = key // n, key % n
            new = 1 - np.einsum("ij,ij->i", self.x[node], queries[who])
            # New ones behind the beam of each query, then the nearest of all.
            heads = np.searchsorted(who, live)
            behind = np.arange(len(who)) - heads[np.searchsorted(live, who)]
            more = int(behind.max()) + 1
            new_ids = np.full((len(live), more), -1, np.int32)
            new_away = np.full((len(live), more), np.inf, np.float32)
            at = np.searchsorted(live, who), behind
            new_ids[at], new_away[at] = node, new
            all_away = np.concatenate([away[live], new_away], axis=1)
            all_ids = np.concatenate([ids[live], new_ids], axis=1)
            all_visited = np.concatenate([visited[live], np.zeros((len(live), more), bool)], axis=1)
            best = np.argsort(all_away, axis=1, kind="stable")[:, :width]
            away[live] = np.take_along_axis(all_away, best, axis=1)
            ids[live] = np.take_along_axis(all_ids, best, axis=1)
            visited[live] = np.take_along_axis(all_visited, best, axis=1)
        return ids, away

    def prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Diverse neighbours of ``nodes`` among the rows of ``candidates`` (-1: none)."""
        unit = self.x[candidates]
        away = 1 - np.einsum("ijk,ik->ij", unit, self.x[nodes])
        away[(candidates < 0) | (candidates == nodes[:, None])] = np.inf
        order = np.argsort(away, axis=1, kind="stable")
        candidates = np.take_along_axis(candidates, order, axis=1)
        away = np.take_along_axis(away, order, axis=1)
        unit = np.take_along_axis(unit, order[:, :, None], axis=1)
        apart = (1 - unit @ unit.transpose(0, 2, 1)) * np.float32(RELAX**2)
        left = np.isfinite(away)
        rows = np.arange(len(nodes))
        kept = np.full((len(nodes), DEGREE), -1, np.int32)
        for k in range(DEGREE):
            nearest = left.argmax(axis=1)
            any_ = left[rows, nearest]
            if not any_.any():
                break
            kept[any_, k] = candidates[rows, nearest][any_]
            left &= apart[rows, nearest] > away
            left[rows, nearest] = False
        return kept

    def _build(self) -> None:
        n = len(self.x)
        order = np.append(self.entry, np.delete(np.arange(n), self.entry))
        # The first ones are all neighbours of each other.
        first = order[: DEGREE + 1]
        for i, node in enumerate(first):
            others = np.delete(first, i)
            self.edges[node, : len(others)] = others
        done = len(first)
        while done < n:
            # Runs double, so that each looks for its neighbours among at least as many.
            nodes = order[done : done + min(done, _RUN)]
            kept = self.prune(nodes, self.search(self.x[nodes])[0])
            self.edges[nodes] = kept
            self._link_back(nodes, kept)
            done += len(nodes)

    def _link_back(self, nodes: np.ndarray, kept: np.ndarray) -> None:
        target, source = kept.ravel(), np.repeat(nodes, kept.shape[1])
        target, source = target[target >= 0], source[target >= 0]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        heads = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        sizes = np.diff(np.append(heads, len(target)))
        owners, by_size = target[heads], np.argsort(sizes, kind="stable")
        start = 0
        while start < len(by_size):
            # Like sizes together, and fewer of large ones.
            width = DEGREE + int(sizes[by_size[min(start + 255, len(by_size) - 1)]])
            own = by_size[start : start + max(1, min(256, 6_000_000 // width**2))]
            start += len(own)
            width = int(sizes[own].max())
            candidates = np.full((len(own), DEGREE + width), -1, np.int32)
            candidates[:, :DEGREE] = self.edges[owners[own]]
            place = np.repeat(np.arange(len(own)), sizes[own])
            inside = np.arange(len(place)) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
            candidates[place, DEGREE + inside] = source[np.repeat(heads[own], sizes[own]) + inside]
            full = (candidates >= 0).sum(axis=1) > DEGREE
            if full.any():
                self.edges[owners[own[full]]] = self.prune(owners[own[full]], candidates[full])
            if not full.all():
                packed = -np.sort(-candidates[~full], axis=1)[:, :DEGREE]
                self.edges[owners[own[~full]]] = packed

    def reached(self) -> np.ndarray:
        seen = np.zeros(len(self.x), bool)
        seen[self.entry] = True
        border = np.array([self.entry])
        while len(border):
            near = np.unique(self.edges[border])
            border = near[(near >= 0) & ~seen[near]]
            seen[border] = True
        return seen

    def _connect(self) -> None:
        """Edges to vectors that cannot be reached, from the nearest ones that can."""
        while not (seen := self.reached()).all():
            lost = np.flatnonzero(~seen)[:_RUN]
            self.edges = np.concatenate([self.edges, np.full((len(self.x), 1), -1, np.int32)], axis=1)
            for node, found in zip(lost, self.search(self.x[lost])[0]):
                free = found[(found >= 0) & (self.edges[found, -1] < 0)]
                if len(free):
                    self.edges[free[0], -1] = node


def _matrix(lists: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in lists.chunks]) if isinstance(lists, pa.ChunkedArray) else lists.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


_INDEX = "dims int, shard long, node int, entry boolean, vector array<double>, ids array<long>, edges array<int>"


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The stored graphs of ``vectors(vec_id, embedding)``: a row per different vector, with its edges."""
    prepare(vectors.sparkSession)
    rows = usable(vectors).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(_SALT)))
    part = Window.partitionBy("vector", "salt").orderBy("vec_id")
    whole = Window.partitionBy("vector").orderBy("vec_id")
    first = rows.withColumn("n", F.row_number().over(part)).where(F.col("n") <= NEAREST + 1)
    first = first.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= NEAREST + 1)
    folded = stored(
        first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "folded-vectors"
    ).withColumn("dims", F.size("vector"))
    shards = folded.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("long").alias("shards"))
    dealt = folded.join(shards, "dims").select(
        "dims", F.pmod(F.xxhash64("vector"), "shards").alias("shard"), "vector", "ids"
    )

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dims = key[0].as_py()
        # By the smallest id, mixed: an order that does not depend on how rows arrive.
        smallest = np.array([i[0] for i in table.column("ids").to_pylist()], np.uint64)
        table = table.take(pa.array(np.argsort(smallest * np.uint64(0x9E3779B97F4A7C15))))
        graph = Graph(unit_rows(_matrix(table.column("vector"), dims)))
        n = table.num_rows
        edges = pa.FixedSizeListArray.from_arrays(pa.array(graph.edges.ravel()), graph.edges.shape[1])
        return pa.table(
            [
                table.column("dims"), table.column("shard"), pa.array(np.arange(n, dtype=np.int32)),
                pa.array(np.arange(n) == graph.entry), table.column("vector"), table.column("ids"),
                edges.cast(pa.list_(pa.int32())),
            ],
            ["dims", "shard", "node", "entry", "vector", "ids", "edges"],
        )

    # As many tasks as shards, which are few bytes but much work.
    tasks = shards.agg(F.sum("shards")).first()[0] or 1
    spread = dealt.repartition(max(2 * tasks, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "dims", "shard")
    return stored(spread.groupBy("dims", "shard").applyInArrow(build, _INDEX), "graphs")


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` of rows that take part, components as doubles."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.where(
        F.col("vec_id").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda v: v != 0)
    )


def search_index(index: DataFrame, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows nearest to each row of ``queries(vec_id, embedding)``.

    ``nearest`` is at most ``NEAREST``, for which the index keeps ids.
    """
    asked = usable(queries).groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("times"))
    asked = stored(asked, "queries").withColumn("dims", F.size("vector"))
    sizes = index.groupBy("dims").agg(F.max("shard").alias("last_shard")).join(
        asked.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("long").alias("blocks")), "dims"
    )
    sizes = stored(sizes, "index-sizes")
    sent = asked.join(sizes, "dims").select(
        F.col("dims").alias("to_dims"), F.explode(F.sequence(F.lit(0).cast("long"), "last_shard")).alias("to_shard"),
        F.pmod(F.xxhash64("vec_id", "vector"), "blocks").alias("to_block"), "vec_id", "vector", "times",
        F.xxhash64("vector").alias("print"),
    )
    copies = index.join(sizes, "dims").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )

    def look(key: tuple[pa.Scalar, ...], nodes: pa.Table, asked: pa.Table) -> pa.Table:
        return _nearest_rows(key[0].as_py() if key[0].is_valid else 0, nodes, asked, nearest)

    found = (
        copies.select("dims", "shard", "block", "node", "entry", "vector", "ids", "edges")
        .groupBy("dims", "shard", "block")
        .cogroup(sent.groupBy("to_dims", "to_shard", "to_block"))
        .applyInArrow(look, "query_id long, print long, times long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id", "print").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", each.alias("_time")).drop("_time")


def _nearest_rows(dims: int, nodes: pa.Table, asked: pa.Table, nearest: int) -> pa.Table:
    out: list[list] = [[], [], [], [], []]
    if nodes.num_rows and asked.num_rows:
        nodes = nodes.take(pa.array(np.argsort(nodes.column("node").to_numpy())))
        x, q = _matrix(nodes.column("vector"), dims), _matrix(asked.column("vector"), dims)
        ids = nodes.column("ids").to_pylist()
        edges = np.array(nodes.column("edges").to_pylist(), np.int32)
        entry = int(np.flatnonzero(np.array(nodes.column("entry").to_pylist()))[0])
        found = Graph(unit_rows(x), edges, entry).search(unit_rows(q))[0]
        x, q = power_scaled(x), power_scaled(q)
        length = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        own = (asked.column(c).to_pylist() for c in ("vec_id", "print", "times"))
        for i, (query_id, mark, times) in enumerate(zip(*own)):
            near = found[i][found[i] >= 0]
            score = (x[near] @ q[i]) / (length[0][near] * length[1][i])
            rows: list[tuple[float, int]] = []
            for node, s in zip(near.tolist(), score.tolist()):
                same = ids[node]
                if query_id in same and np.array_equal(x[node], q[i]):
                    same = same.copy()
                    same.remove(query_id)
                rows += [(-s, vec_id) for vec_id in same]
            for s, vec_id in sorted(rows)[:nearest]:
                for column, value in zip(out, (query_id, mark, times, vec_id, -s)):
                    column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], ["query_id", "print", "times", "vec_id", "score"])


def nearest_neighbours(vectors: DataFrame, every: int = 50) -> DataFrame:
    """The ``NEAREST`` rows nearest to each row whose id is divisible by ``every``, among all others."""
    index = build_index(vectors)
    return search_index(index, vectors.where(F.col("vec_id") % every == 0))
