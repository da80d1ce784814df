"""Graph search, source divergence and vector codes against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from linecite.llm import divergence, graph_search, vector_codes

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


# ---- graph search ---------------------------------------------------------------------------


def plain_nearest(rows, every, nearest=5):
    """``(query_id, rank, vec_id, score)``; rows are ``(vec_id, vector)``."""
    good = [
        (i, np.array(v, np.float64)) for i, v in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    out = []
    for n, (i, v) in enumerate(good):
        if i % every:
            continue
        scored = [
            (-float(v @ w) / float(np.sqrt(v @ v) * np.sqrt(w @ w)), j)
            for m, (j, w) in enumerate(good) if m != n and len(w) == len(v)
        ]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:nearest])]
    return out


def assert_same_nearest(got, wanted):
    key = lambda r: (r[0], r[1], r[2])
    got, wanted = sorted(map(tuple, got), key=key), sorted(wanted, key=key)
    assert [r[:3] for r in got] == [r[:3] for r in wanted]
    assert np.allclose([r[3] for r in got], [r[3] for r in wanted], rtol=0, atol=1e-12)


def random_vectors(n, dims, seed, spread=1.0):
    pick = np.random.default_rng(seed)
    centers = pick.normal(size=(8, dims))
    return (centers[pick.integers(0, 8, n)] + spread * pick.normal(size=(n, dims))).astype(np.float32)


@pytest.mark.parametrize("shard_rows,block", [(4096, 2048), (60, 2)])
def test_nearest_neighbours(spark, monkeypatch, shard_rows, block):
    monkeypatch.setattr(graph_search, "QUERY_BLOCK", block)
    x = random_vectors(400, 12, 1)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    # A third of the rows hold one vector; others are a multiple, and of another length.
    rows += [(1000 + i, rows[7][1]) for i in range(250)]
    rows += [(2000, [2 * c for c in rows[7][1]]), (2050, [1.0, 2.0]), (2051, [2.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = graph_search.build_index(docs, shard_rows)
    got = graph_search.search_index(index, docs.where("vec_id % 50 = 0")).collect()
    assert_same_nearest([r[:3] + (r[3],) for r in map(tuple, got)], plain_nearest(rows, 50))


def test_nearest_of_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 2), (50, [0.0, 1e-30], 3), (1, [1e30, 1e30], 4), (2, None, 5),
        (None, [1.0, 1.0], 6), (3, [], 7), (100, [0.0, 0.0], 8), (4, [NAN, 1.0], 9), (5, [INF, 1.0], 10),
        (6, [None, 1.0], 11), (150, [3.0], 12), (1, [-1.0, 0.5], 13), (200, None, 14),
    ]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = graph_search.nearest_neighbours(docs).collect()
    wanted = plain_nearest([r[:2] for r in rows], 50)
    assert_same_nearest(got, wanted)
    assert {r["query_id"] for r in got} == {0, 50}
    assert graph_search.nearest_neighbours(docs.limit(0)).collect() == []


def test_recall_of_the_graph():
    path = "/root/testdata/sf0.1/embeddings.parquet"
    x = np.array([r[0] for r in duckdb.sql(f"SELECT embedding FROM '{path}' ORDER BY vec_id").fetchall()], np.float64)
    unit = graph_search.unit_rows(np.unique(x, axis=0))
    graph = graph_search.Graph(unit)
    assert graph.reached().all()
    found = graph.search(unit[::10])[0][:, :6]
    true = np.argsort(-(unit[::10] @ unit.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(found, true)]) >= 0.97


def test_pruning_drops_what_a_kept_neighbour_covers():
    angles = np.deg2rad([0, 10, 12, -30])
    graph = graph_search.Graph(np.stack([np.cos(angles), np.sin(angles)], axis=1).astype(np.float32))
    assert graph.prune(np.array([0]), np.array([[3, 2, 1, 0, -1]])).tolist()[0][:3] == [1, 3, -1]


# ---- source divergence ----------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_divergence(rows):
    groups, in_docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall((text or "").translate(UPPER))
        groups[lang or "", source or ""].update(found)
        in_docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in in_docs[lang].items() if n >= 3)
        own = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def p(counts):
            total = sum(counts.values()) + len(kept)
            return {t: 1 + 10**9 * (n + 1) // total for t, n in counts.items()}

        shares, q = {s: p(c) for s, c in own.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
            best = [(-f(shares[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] and shares[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(best)[:200])]
    return sorted(out)


@pytest.fixture(scope="module")
def sourced():
    pick = random.Random(9)
    words = ["alpha", "Beta", "ÄRGER", "ärger", "İx", "don't", "x9y", "\U0001f600", "z" * 3000] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(None, None, None), ("", "en", ""), ("123 456", "xx", "only"), (None, "xx", "other"), ("a a a", None, "s")]
    for _ in range(250):
        lang, source = pick.choice(["en", "de", None]), pick.choice(["a", "b", "b", "b", "c", "", None, "日本"])
        size = pick.choice([0, 3, 20, 400])
        weights = [1 / (i + 1 + (len(source or "") * 7) % 11) for i in range(len(words))]
        rows.append((" ".join(pick.choices(words, weights, k=size)) + pick.choice(["", "\n", "\x85."]), lang, source))
    return rows + rows[:20] + [("The end " * 30_000, "en", "long")]


@pytest.mark.parametrize("size,frontier,combined", [(250_000, 2_000_000, 200_000), (40, 64, 10)])
def test_source_divergence(spark, monkeypatch, sourced, size, frontier, combined):
    monkeypatch.setattr(divergence, "BLOCK_SIZE", size)
    monkeypatch.setattr(divergence, "COMBINED", combined)
    rows = [(*r, i, "x") for i, r in enumerate(sourced)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string, term int, value string")
    got = divergence.source_divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergence(sourced)
    assert divergence.source_divergence(docs.limit(0)).collect() == []


def test_divergence_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = divergence.source_divergence(docs).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(divergence.ORACLE).fetchall())


def test_trees_share_equal_counts_and_meet_each_pair_once(monkeypatch):
    monkeypatch.setattr(divergence, "FRONTIER", 64)
    pick = np.random.default_rng(3)
    counts = pick.poisson(0.3, (7, 300))
    counts[3], counts[5, 150:] = counts[1], 0
    trees = divergence.SharedTrees(counts)
    assert trees.roots[3] == trees.roots[1] and len(set(trees.roots.tolist())) == 6
    assert sum(len(left) for left, _ in trees.halves) < counts.size / 2
    first, second = np.array([0, 1, 4]), np.array([5, 3, 2])
    pair, a, b, times = trees.leaf_pairs(first, second)
    for i in range(3):
        met = Counter()
        for k in np.flatnonzero(pair == i):
            assert (trees.values[a[k]], trees.values[b[k]]) not in met
            met[trees.values[a[k]], trees.values[b[k]]] = times[k]
        assert met == Counter(zip(counts[first[i]].tolist(), counts[second[i]].tolist()))
    totals = counts.sum(axis=1)
    seen = set()
    for run in divergence.group_divergences(counts, totals, 300):
        for x, y, there, back in zip(*run):
            p, q = (1 + 10**9 * (counts[g] + 1) // (totals[g] + 300) for g in (x, y))
            assert there == ((p - q) ** 2 // q).sum() and back == ((p - q) ** 2 // p).sum()
            seen.add((x, y))
    assert seen == {(x, y) for x in range(7) for y in range(x + 1, 7)}


def test_shares_of_large_counts_are_exact():
    counts, total = np.array([0, 5 * 10**10, 10**13 + 7]), 10**13 + 5 * 10**10 + 7
    assert divergence.shares(counts, total, 3).tolist() == [1 + 10**9 * (int(c) + 1) // (total + 3) for c in counts]


# ---- vector codes ---------------------------------------------------------------------------


def plain_codes(rows, rounds=4, entries=256):
    """``(vec_id, code, error, label_error, hash)``; rows are ``(vec_id, vector, label)``."""
    good = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    x = np.floor(1024 * np.array([r[1] for r in good], np.float64)).clip(-(1 << 24), 1 << 24).astype(np.int64)
    codes, errors, digits = [], 0, []
    for part in np.split(x, 4, axis=1):
        book = part[:entries].copy()
        for step in range(rounds + 1):
            apart = ((part[:, None, :] - book[None]) ** 2).sum(axis=2)
            nearest = apart.argmin(axis=1)
            for e in range(len(book)) if step < rounds else ():
                own = part[nearest == e]
                if len(own):
                    book[e] = own.sum(axis=0) // len(own)
        codes.append(nearest)
        errors = errors + apart.min(axis=1)
        digits += book.ravel().tolist()
    whole = Counter()
    for r, e in zip(good, errors):
        whole[r[2]] += int(e)
    mark = hashlib.sha256(",".join(map(str, digits)).encode()).hexdigest()
    return [
        (r[0], "".join(f"{c[i]:02x}" for c in codes), int(errors[i]), whole[r[2]], mark) for i, r in enumerate(good)
    ]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("chunk", [4096, 100])
def test_vector_codes(spark, monkeypatch, chunk):
    monkeypatch.setattr(vector_codes, "CHUNK", chunk)
    pick = random.Random(3)
    x = random_vectors(700, 16, 2, 0.1)
    rows = [(i, [float(c) for c in v], pick.choice([1, 2, None])) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[300][1], 3) for i in range(300)]  # one vector in a third of the rows
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    assert order(vector_codes.compress_vectors(docs).collect()) == order(plain_codes(rows))


def test_vector_codes_of_odd_rows(spark):
    rows = [
        (5, [0.5, -0.25, 1.0, 0.0], "a", 1), (5, [0.5, -0.25, 1.0, 0.0], "a", 1), (5, [0.1, 0.2, 0.3, 0.4], None, 2),
        (None, [9.0, 9.0, 9.0, 9.0], None, 3), (6, None, "a", 4), (7, [], "a", 5), (8, [1.0, NAN, 0.0, 0.0], "a", 6),
        (9, [1.0, INF, 0.0, 0.0], "a", 7), (10, [1.0, None, 0.0, 0.0], "a", 8), (11, [1.0] * 8, "a", 9),
        (12, [3e38, -3e38, 1e-40, -1e-40], "", 10),
    ]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, n int")
    got = vector_codes.compress_vectors(docs)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    as_stored = [(i, v and [None if c is None else float(np.float32(c)) for c in v], s) for i, v, s, _ in rows]
    assert order(got.collect()) == order(plain_codes(as_stored))
    assert vector_codes.compress_vectors(docs.limit(0)).collect() == []
    assert vector_codes.compress_vectors(docs.where("vec_id = 6 or vec_id = 7")).collect() == []
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress_vectors(odd).collect() == []


def test_vector_codes_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = vector_codes.compress_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert order(got.collect()) == order(con.execute(vector_codes.ORACLE).fetchall())


def test_cover_trees_assign_like_brute_force():
    pick = np.random.default_rng(8)
    centers = pick.integers(-500, 500, (40, 6))
    points = centers[pick.integers(0, 40, 3000)] + pick.integers(-2, 3, (3000, 6))
    points[:900] = points[0]
    codebook = np.concatenate([centers, centers[:3], points[:2]])
    tree = vector_codes.CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(3000)) and (tree.points == points[tree.order]).all()
    for i in range(len(tree.begin)):
        own = tree.points[tree.begin[i] : tree.end[i]]
        assert np.sqrt(((own - tree.centers[i]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-9
    nearest, compared = tree.assign(codebook)
    assert compared < 600, "most points go with their subtrees"
    assert (nearest == ((tree.points[:, None] - codebook[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    sums, counts = tree.sums(nearest, len(codebook))
    for e in range(len(codebook)):
        assert counts[e] == (nearest == e).sum() and (sums[e] == tree.points[nearest == e].sum(axis=0)).all()


def test_distances_of_large_integers_are_exact():
    x, y = np.array([[1 << 24, -(1 << 24)], [3, 5]]), np.array([[-(1 << 24), (1 << 24) - 1]])
    wanted = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s)) for s in y] for r in x]
    assert vector_codes.squared_distances(x, y).astype(object).tolist() == wanted
