"""Suffix-array, vector and SimHash deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash

from linecite.llm import simhash, suffix_dedup, vector_dedup
from linecite.llm.components import connected_components
from linecite.llm.queries import LLM_QUERIES

DOCS = "doc_id long, text string"


def plain_components(ids, links):
    """The smallest id reachable from each place."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    low = {}
    for i, own in enumerate(ids):
        if own is not None:
            low[find(i)] = min(own, low.get(find(i), own))
    return [low.get(find(i)) for i in range(len(ids))]


def plain_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    times = Counter(hash(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
    rows = []
    for d in data:
        covered = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if times[hash(d[i : i + length])] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(d, covered) if not c)
        spans = sum(c and (not i or not covered[i - 1]) for i, c in enumerate(covered))
        rows.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return rows


@pytest.fixture(scope="module")
def repetitive():
    pick = random.Random(2)
    base = ["".join(pick.choice("ab é") for _ in range(pick.randint(50, 300))) for _ in range(10)]
    texts = [None, "", "a" * 50, "ab" * 200, "x" * 19, "x" * 20, "x" * 21]
    for _ in range(80):
        text = ""
        for _ in range(pick.randint(1, 4)):
            part = pick.choice(base)
            at = pick.randrange(len(part))
            text += part[at : at + pick.randint(1, 200)] + "".join(pick.choice("abc") for _ in range(pick.randint(0, 30)))
        texts.append(text)
    return texts + texts[:15]


@pytest.mark.parametrize("length,shard_segments", [(20, 4000), (60, 4000), (60, 3)])
def test_suffix_removal(spark, repetitive, length, shard_segments):
    docs = spark.createDataFrame(list(enumerate(repetitive)), DOCS)
    got = {r[0]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(docs, length, shard_segments).collect()}
    wanted = plain_removal(repetitive, length)
    assert [got[i] for i in range(len(wanted))] == wanted


def test_suffix_removal_of_production_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    got = {r[0]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(docs).collect()}
    wanted = plain_removal([r["text"] for r in rows], suffix_dedup.LENGTH)
    assert {r["doc_id"]: w for r, w in zip(rows, wanted)} == got


def test_suffix_removal_odd_rows(spark):
    rows = [(None, "q" * 500, 1), (5, "q" * 500, 2), (5, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = sorted(tuple(r)[:3] for r in suffix_dedup.remove_repeats(docs).collect() if r[0])
    assert got == [(5, 0, 0), (5, 500, 500)]
    assert suffix_dedup.remove_repeats(docs.limit(0)).collect() == []


@pytest.mark.parametrize("shard_segments", [5, 4000])
def test_suffix_removal_over_many_shards(spark, monkeypatch, shard_segments):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 60_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    found = suffix_dedup.remove_repeats(docs, shard_segments=shard_segments).collect()
    wanted = plain_removal([r["text"] for r in rows], suffix_dedup.LENGTH)
    assert {r["doc_id"]: w for r, w in zip(rows, wanted)} == {r[0]: tuple(r)[1:5] for r in found}


def test_suffix_removal_query_names_the_remaining_text(spark, tmp_path):
    pick = random.Random(8)
    own = [" ".join("".join(pick.choice("abcdé") for _ in range(5)) for _ in range(90)) for _ in range(7)]
    passage = own.pop()
    assert len(passage.encode()) > suffix_dedup.LENGTH and len(passage.split()) > 50
    texts = [f"{t}{i}\n{passage}\n{i}{t[:20]}" if i < 3 else t for i, t in enumerate(own)] + [None]
    spark.createDataFrame(list(enumerate(texts)), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = LLM_QUERIES["op2_suffix_dedup"](spark, str(tmp_path)).collect()
    got = {r["doc_id"]: (r["text"], r["n_removed"] > 0, r["n_bytes"]) for r in rows}
    # The line breaks around the passage repeat with it.
    wanted = [f"{t}{i}{i}{t[:20]}" if i < 3 else t for i, t in enumerate(own)] + [""]
    assert got == {i: (w, i < 3, len((t or "").encode())) for i, (w, t) in enumerate(zip(wanted, texts))}


def shared_prefix(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_suffix_array_and_prefixes():
    pick = random.Random(4)
    for round_ in range(400):
        alphabet = pick.choice([b"a", b"ab", b"abcdefgh", b"\x00\xff"])
        base = bytes(pick.choice(alphabet) for _ in range(pick.randint(0, 90)))
        data = base * pick.randint(1, 4) + bytes(pick.choice(alphabet) for _ in range(pick.randint(0, 60)))
        array = np.frombuffer(data, np.uint8)
        order = suffix_dedup.suffix_array(array)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        shared = suffix_dedup.common_prefixes(array, order).tolist() if data else []
        for n in range(1, len(data)):
            assert shared[n] == shared_prefix(data[order[n] :], data[order[n - 1] :])


def test_prefixes_of_long_repeats():
    pick = np.random.default_rng(5)
    base = pick.integers(0, 256, 30_000).astype(np.uint8)
    data = np.concatenate([base, pick.integers(0, 256, 99).astype(np.uint8), base[5:], base[:9000]])
    raw = data.tobytes()
    order = suffix_dedup.suffix_array(data)
    shared = suffix_dedup.common_prefixes(data, order)
    for n in pick.integers(1, len(data), 300).tolist():
        a, b = int(order[n]), int(order[n - 1])
        assert raw[b:] < raw[a:]
        most, same = len(raw) - max(a, b), int(shared[n])
        assert raw[a : a + same] == raw[b : b + same]
        assert same == most or raw[a + same] != raw[b + same]
    assert shared.max() == 29_995


def test_memory_of_a_shard():
    """Workers of an executor sort a shard each: it must take little beside the JVM's heap."""
    pick = np.random.default_rng(6)
    base = pick.integers(97, 101, 100_000).astype(np.uint8)
    copies = []
    for _ in range(4):
        copies.append(base.copy())
        copies[-1][pick.integers(0, len(base), 300)] = 65
    data = np.concatenate(copies).tobytes()
    rows = [(data[i : i + 584], 185, 1) for i in range(0, len(data) - 584, 584)]
    tracemalloc.start()
    try:
        repeated, _, text = suffix_dedup.shard_windows(rows, suffix_dedup.LENGTH)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert 0 < repeated.sum() < len(repeated)
    assert most < 60 * len(text)
    assert most / len(text) * suffix_dedup.SHARD_BYTES < 100e6


# ---- SimHash --------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    joined = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in joined]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", " \n", "A", "a B", "ÄB c D e", "x y z w", "one two three four five " * 9):
        assert simhash.fingerprint(text) == plain_fingerprint(text), text


@pytest.mark.parametrize("spread", [0, 3])
def test_fingerprint_links(spark, spread):
    pick = random.Random(spread)
    prints = []
    for _ in range(150):
        one = pick.getrandbits(64)
        prints.append(one)
        for _ in range(pick.choice([0, 0, 1, 2, 12]) + spread):
            one ^= sum(1 << b for b in pick.sample(range(64), pick.choice([1, 2, 3])))
            prints.append(one)
    center = pick.getrandbits(64)
    prints += [center ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)] + [0, 0, center]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    ids = list(range(len(prints)))
    df = spark.createDataFrame(list(zip(ids, signed)), "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.with_components(df).collect()}
    links = [(a, b) for a in ids for b in ids[:a] if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert [got[i] for i in ids] == plain_components(ids, links)


def test_simhash_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    ids, prints = [r["doc_id"] for r in rows], [plain_fingerprint(r["text"]) for r in rows[:200]]
    assert [got[i][0] for i in ids[:200]] == prints
    prints = [got[i][0] for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert [got[i][1] for i in ids] == plain_components(ids, links)
    kept = sorted(r["doc_id"] for r in simhash.keep_first_of_each(docs).collect())
    assert kept == sorted(i for i in ids if got[i][1] == i)


def test_simhash_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " ", 1), (None, "", 1), (4, "lonely words here", 2), (4, "lonely words here", 2), (None, "other words there now", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((str(r["doc_id"]), r["fingerprint"] == "0" * 16, r["component_id"]) for r in simhash.simhash_components(docs).collect())
    assert got == [("1", True, 1), ("2", True, 1), ("3", True, 1), ("4", False, 4), ("4", False, 4), ("None", False, None), ("None", True, 1)]
    kept = simhash.keep_first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "None", "None"]
    assert simhash.simhash_components(docs.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(7, 7), (500, 300)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 300, 300: 300}
    assert connected_components(edges.limit(0)).collect() == []


# ---- vectors --------------------------------------------------------------------------------


def plain_vectors(rows, least=0.93):
    def usable(v):
        return v[0] is not None and v[2] is not None and v[1] and all(x is not None and np.isfinite(x) for x in v[1]) and any(v[1])

    good = [bool(usable(v)) for v in rows]
    unit = [np.array(v[1]) / np.linalg.norm(v[1]) if g else None for v, g in zip(rows, good)]
    links = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if good[a] and good[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least
    ]
    n = Counter(x for link in links for x in link)
    ids = [r[0] for r in rows]
    return [(i, n[k], c, i is None or c == i) for k, (i, c) in enumerate(zip(ids, plain_components(ids, links)))]


@pytest.mark.parametrize("block", [2048, 7])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    noise = np.random.default_rng(1)
    vectors = []
    for _ in range(250):
        center = noise.standard_normal(16)
        vectors.append(center)
        vectors += [center + noise.standard_normal(16) * noise.choice([0.05, 0.2, 0.35]) for _ in range(noise.integers(0, 4))]
    vectors = [np.float32(v).astype(float).tolist() for v in vectors]
    rows = [(i, v, int(noise.integers(0, 3))) for i, v in enumerate(vectors + vectors[:30])]
    rows += [
        (2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0, None] * 8, 1),
        (2004, vectors[3], None), (None, vectors[3], 1), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [], 1),
        (2006, [2.0, 4.0], 1), (2008, [float("inf")] * 16, 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((tuple(r) for r in vector_dedup.vector_components(df).collect()), key=str)
    assert got == sorted(plain_vectors(rows), key=str)


def test_vectors_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, kept int")
    assert vector_dedup.vector_components(df).collect() == []


def test_walk_visits_cells_in_order():
    noise = np.random.default_rng(3)
    first, second = noise.random(7), noise.random(5)
    seen = list(vector_dedup.multi_sequence(first, second))
    assert len({(i, j) for _, i, j in seen}) == 35
    assert [c for c, *_ in seen] == sorted(float(a + b) for a in first for b in second)


def test_recall_at_the_threshold():
    """Partners at exactly the least cosine are in visited cells nearly always."""
    noise = np.random.default_rng(8)
    sample = noise.standard_normal((3000, 64))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    grid = vector_dedup.Grid(sample[:1500], 24, 0.93, 0.999)
    query, side = sample[1500:], noise.standard_normal((1500, 64))
    side -= (side * query).sum(axis=1, keepdims=True) * query
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    homes = grid.cells(0.93 * query + (1 - 0.93**2) ** 0.5 * side)
    visited = grid.visited(query)
    assert np.mean([h in v for h, v in zip(homes, visited)]) > 0.98
    assert np.mean([len(v) for v in visited]) < 0.5 * 24 * 24
