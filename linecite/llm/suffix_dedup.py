"""Removal of long repeated byte strings by suffix arrays.

A byte of a text goes if it is covered by a string of ``LENGTH`` bytes that also starts anywhere else
in the corpus, in the same text or another; matches stay within texts.

1. The windows of ``LENGTH`` bytes of a text are cut into segments: runs of windows whose smallest hash
   of ``ANCHOR`` bytes is the same. That hash, the segment's key, depends on nothing but the window, so
   equal windows have equal keys. Keys are counted without their bytes. One that occurs once cannot
   repeat; one whose segments are all equal repeats whole. Neither needs a suffix array.
2. The other segments go to shards by key. A shard is bounded: keys are dealt by their share of bytes,
   and one with more than ``SHARD_SEGMENTS`` segments is spread over shards of its own. A task sorts its
   shards one after the other, so its memory is that of one shard. Each shard
   builds a suffix array by Larsson and Sadakane's refinement, doubling the compared length and sorting
   only groups that are still tied, until none is. Kasai's common prefixes of neighbours tell which
   windows repeat.
3. The shards of a spread key are merged: each sends one 128-bit fingerprint per distinct window; those
   of two shards return to them as a sorted list, in which each shard finds its windows by binary
   search. Equal fingerprints count as equal windows.
4. Repeated windows return to their texts, where their union is removed.

Null texts are empty. Texts shorter than ``LENGTH`` lose nothing. Rows without an id or with a repeated
id are texts like others. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecite.llm.common import prepare, slices, stored

LENGTH = 400
ANCHOR = 32
#: A key with more different segments is spread over several shards.
SHARD_SEGMENTS = 4000
#: Bytes of segments that a shard holds, about. Sorting takes some 50 bytes of memory for each.
SHARD_BYTES = 1_000_000
#: Shards that a task sorts, about.
TASK_SHARDS = 4
_BASE = 0x9E3779B97F4A7C15
_BASE2 = 0xC2B2AE3D27D4EB4F
_ALL = (1 << 64) - 1
_U = np.uint64
#: So few suffixes are not worth comparing side by side.
_FEW = 16


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2 ** 64."""
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def window_hashes(data: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """A mixed polynomial hash of each run of ``width`` bytes."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    scattered = (data.astype(np.uint64) + _U(1)) * _U(0xD6E8FEB86659FD93)
    scattered ^= scattered >> _U(29)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(scattered * _powers(base, n), out=sums[1:])
    h = (sums[width:] - sums[:-width]) * _powers(pow(base, -1, 1 << 64), n - width + 1)
    h ^= h >> _U(32)
    h *= _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by minima within blocks from both ends."""
    n = len(values)
    if width == 1:
        return values
    padded = np.full(-(-n // width) * width, _ALL, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def segments(data: bytes, length: int, anchor: int):
    """``keys, starts, counts, weights``: runs of windows under one key.

    ``counts`` are windows per run; ``weights`` how often the key's hash occurs in the run's bytes.
    """
    h = window_hashes(np.frombuffer(data, np.uint8), anchor)
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4
    smallest = sliding_minimum(h, length - anchor + 1)
    starts = np.flatnonzero(np.append(True, smallest[1:] != smallest[:-1]))
    ends = np.append(starts[1:], len(smallest))
    keys = smallest[starts]
    # Anchors are at places where the hash is the minimum of some window around.
    reach = length - anchor
    weights = np.ones(len(keys), np.int64)
    place = np.argsort(h, kind="stable")
    ordered = h[place]
    low = np.searchsorted(ordered, keys)
    many = np.flatnonzero(np.searchsorted(ordered, keys, side="right") - low > 1)
    for i in many:
        high = np.searchsorted(ordered, keys[i], side="right")
        own = place[low[i] : high]
        weights[i] = int(((own >= starts[i]) & (own < ends[i] + reach)).sum())
    return keys.view(np.int64), starts, ends - starts, weights


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes.

    Larsson and Sadakane: a group is numbered by its last place; groups of one are done; the others
    are sorted by the group of the position ``h`` behind, and ``h`` doubles until none is tied.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    # The first seven bytes at once: nine bits each, an end below every byte.
    key = np.zeros(n, np.uint64)
    padded = np.zeros(n + 8, np.uint16)
    np.add(data, 1, out=padded[:n], dtype=np.uint16)
    for i in range(7):
        key <<= _U(9)
        key |= padded[i : i + n]
    # Places take four bytes, unless a sum of two needs more.
    place = np.int32 if n < 1 << 30 else np.int64
    order = np.argsort(key).astype(place)
    ranks = np.empty(n + 1, place)
    ranks[n] = -1

    def number(places: np.ndarray, first: np.ndarray) -> None:
        """Groups begin where ``first`` is true; each gets the number of its last place."""
        heads = np.flatnonzero(first)
        ends = np.append(heads[1:], len(places)) - 1
        ranks[order[places]] = np.repeat(places[ends], ends - heads + 1)

    places = np.arange(n, dtype=place)
    key = key[order]
    first = np.append(True, key[1:] != key[:-1])
    del key, padded
    number(places, first)
    h = 7
    while True:
        # Places in groups of more than one.
        places = places[~(first & np.append(first[1:], True))]
        if not len(places):
            return order
        own = order[places]
        # One number holds the group and, below it, the group of what is behind.
        key = ranks[own].astype(np.int64)
        key *= n + 1
        key += ranks[np.minimum(own + min(h, n), n)]
        key += 1
        inside = np.argsort(key)
        order[places] = own[inside]
        key = key[inside]
        del own, inside
        first = np.append(True, key[1:] != key[:-1])
        del key
        number(places, first)
        h *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order of all suffixes.

    Kasai: a suffix shares one byte less with the one before it than the suffix a byte further left
    does, as long as the bytes to the left of both are the same. So only suffixes behind different
    bytes are compared, all of them together and eight bytes at a time; the others count down.
    """
    n = len(data)
    before = np.full(n, -1, order.dtype)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray(n + 8, "<u8", padded, strides=(1,))
    # Suffixes at the beginning have no byte to their left.
    compared = np.flatnonzero(np.append(True, data[:-1] != data[before[1:] - 1]) | (before <= 0))
    shared = np.zeros(n, order.dtype)
    live = compared[before[compared] >= 0]
    partner, most = before[live], n - np.maximum(live, before[live])
    length = np.zeros(len(live), order.dtype)
    open_ = np.arange(len(live), dtype=order.dtype)
    while len(open_) > _FEW:
        at = length[open_]
        differing = words[live[open_] + at] ^ words[partner[open_] + at]
        same = differing == 0
        differing &= ~differing + _U(1)  # the lowest bit
        np.maximum(differing, _U(1), out=differing)
        length[open_] = at + np.where(same, 8, np.log2(differing).astype(np.int8) // 8)
        del differing
        open_ = open_[same]
        open_ = open_[length[open_] < most[open_]]
    for k in open_.tolist():  # few long ones: in growing blocks, one after the other
        a, b, done, block, end = int(live[k]), int(partner[k]), int(length[k]), 64, int(most[k])
        while done < end:
            block = min(block, end - done)
            unlike = data[a + done : a + done + block] != data[b + done : b + done + block]
            if unlike.any():
                done += int(unlike.argmax())
                break
            done, block = done + block, block * 2
        length[k] = done
    shared[live] = np.minimum(length, most)
    last = before  # its memory serves once more
    last[:] = 0
    last[compared] = compared
    np.maximum.accumulate(last, out=last)
    shared = shared[last]
    shared += last
    shared -= np.arange(n, dtype=order.dtype)
    return shared[order]


def _union(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(pieces):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def shard_windows(rows: list[tuple[bytes, int, int]], length: int):
    """``repeated, spots, text``: of the windows of a shard's segments ``(bytes, windows, times)``.

    ``repeated`` tells per window, in the order of the segments, whether it occurs twice; ``spots`` is
    its place in ``text``, the segments' bytes behind each other.
    """
    sizes, counts, times = (np.array(c) for c in zip(*((len(b), n, t) for b, n, t in rows)))
    joined = b"".join(r[0] for r in rows)
    text = np.frombuffer(joined, np.uint8)
    offsets, first = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
    order = suffix_array(text)
    # Suffixes that share ``length`` bytes with the one before are of one group.
    group = np.empty(len(text), order.dtype)
    group[order] = np.cumsum(common_prefixes(text, order) < length, dtype=order.dtype)
    spots = np.repeat((offsets - first).astype(order.dtype), counts)
    spots += np.arange(len(spots), dtype=order.dtype)
    del order
    group = group[spots]
    totals = np.bincount(group, weights=np.repeat(times, counts))
    return totals[group] > 1, spots, text


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and lengths of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist()


_RUNS = "key long, print binary, starts array<int>, counts array<int>"
_INTS = pa.list_(pa.int32())


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in columns))


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds.values())]
    return pa.RecordBatch.from_arrays(arrays, list(kinds))


def cut_segments(texts: DataFrame, length: int) -> DataFrame:
    """``text_key, key, print, start, windows, weight`` of the segments of all texts.

    ``print`` is a 128-bit hash of the segment's bytes.
    """
    anchor = min(ANCHOR, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            marks, numbers, prints = [], [[] for _ in range(4)], []
            for mark, data in _rows(batch, "text_key", "data"):
                found = segments(data, length, anchor)
                for out, column in zip(numbers, found):
                    out.append(column)
                marks += [mark] * len(found[0])
                prints += [
                    hashlib.blake2b(data[s : s + n + length - 1], digest_size=16).digest()
                    for s, n in zip(found[1].tolist(), found[2].tolist())
                ]
            key, start, windows, weight = (np.concatenate(c) for c in numbers)
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks, pa.binary()), pa.array(key), pa.array(prints, pa.binary()),
                 pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(weight)],
                ["text_key", "key", "print", "start", "windows", "weight"],
            )

    return texts.where(F.length("data") >= length).mapInArrow(
        cut, "text_key binary, key long, print binary, start int, windows int, weight long"
    )


def sort_shards(pieces: DataFrame, length: int) -> DataFrame:
    """Suffix arrays of shards. ``pieces``: ``shard, spread, key, print, times, windows, bytes``.

    Returns the runs of repeated windows per segment, and for segments of spread keys their windows'
    fingerprints.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            repeated, spots, text = shard_windows([(r[5], r[4], r[3]) for r in rows], length)
            if rows[0][2]:
                one, two = (window_hashes(text, length, base) for base in (_BASE, _BASE2))
            out, first = [], 0
            for key, mark, spread, _, windows, _ in rows:
                own = slice(first, first + windows)
                first += windows
                prints = None
                if spread:
                    prints = np.stack([one[spots[own]], two[spots[own]]], axis=1).tobytes()
                out.append((shard, key, mark, *_runs(repeated[own]), prints))
            yield _batch(
                out, shard=pa.int64(), key=pa.int64(), print=pa.binary(), starts=_INTS, counts=_INTS, prints=pa.binary()
            )

    return pieces.mapInArrow(run, "shard long, " + _RUNS + ", prints binary")


def _by_shard(batches: Iterator[pa.RecordBatch]):
    """``shard, rows`` of each run of rows of one shard; a segment fetched twice counts once."""
    current, rows, seen = None, [], set()
    for batch in slices(batches):
        for shard, *row in _rows(batch, "shard", "key", "print", "spread", "times", "windows", "bytes"):
            if shard != current and rows:
                yield current, rows
                rows, seen = [], set()
            current = shard
            if (row[0], row[1]) not in seen:
                seen.add((row[0], row[1]))
                rows.append(row)
    if rows:
        yield current, rows


def merge_shards(shards: DataFrame) -> DataFrame:
    """Runs of windows that shards of spread keys share with each other, per segment."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            for shard, prints in _rows(batch, "shard", "prints"):
                both = np.unique(np.frombuffer(prints, np.int64).reshape(-1, 2), axis=0)
                columns = [np.full(len(both), shard), both[:, 0].copy(), both[:, 1].copy()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "high", "low"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out, lists = [], batch.column("shared")
            for i, (key, mark, prints) in enumerate(_rows(batch, "key", "print", "prints")):
                pairs = lists.slice(i, 1).flatten()
                high, low = (pairs.field(f).to_numpy(zero_copy_only=False) for f in (0, 1))
                own = np.frombuffer(prints, np.int64).reshape(-1, 2)
                at, hit = np.searchsorted(high, own[:, 0]), np.zeros(len(own), bool)
                live = np.flatnonzero(at < len(high))
                while len(live):  # prints with equal first halves are neighbours
                    same = high[at[live]] == own[live, 0]
                    equal = same & (low[at[live]] == own[live, 1])
                    hit[live[equal]] = True
                    live = live[same & ~equal]
                    at[live] += 1
                    live = live[at[live] < len(high)]
                starts, counts = _runs(hit)
                if starts:
                    out.append((key, mark, starts, counts))
            yield _batch(out, key=pa.int64(), print=pa.binary(), starts=_INTS, counts=_INTS)

    windows = shards.mapInArrow(send, "shard long, high long, low long").distinct()
    shared = windows.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = (
        windows.join(shared.drop("n"), ["high", "low"], "left_semi")
        .groupBy("shard")
        .agg(F.sort_array(F.collect_list(F.struct("high", "low"))).alias("shared"))
    )
    return shards.join(lists, "shard").select("key", "print", "prints", "shared").mapInArrow(search, _RUNS)


def repeated_windows(texts: DataFrame, length: int, shard_segments: int) -> DataFrame:
    """``text_key, start, count``: runs of repeated windows of ``texts(text_key, data)``."""
    spark = texts.sparkSession
    parts = stored(cut_segments(texts, length), "segments")
    keys = (
        parts.groupBy("key")
        .agg(
            F.sum("weight").alias("times"),
            F.count(F.lit(1)).alias("n"),
            (F.min("print") == F.max("print")).alias("alike"),
        )
        .where("times > 1")
        # One segment that recurs repeats whole. Alone but with its anchor twice, it needs a shard.
        .select(F.col("key").alias("shared_key"), F.expr("alike and n > 1").alias("whole"))
    )
    shared = stored(
        parts.join(keys, F.col("key") == F.col("shared_key")).drop("shared_key", "weight"), "shared-segments"
    )
    found = shared.where("whole").select("text_key", "start", F.col("windows").alias("count"))

    different = stored(
        shared.where("not whole")
        .groupBy("key", "print")
        .agg(F.min(F.struct("text_key", "start", "windows")).alias("at"), F.count(F.lit(1)).alias("n")),
        "different-segments",
    )
    per_key = different.groupBy("key").agg(F.count(F.lit(1)).alias("n_prints")).select(
        F.col("key").alias("sized_key"), F.ceil(F.col("n_prints") / shard_segments).alias("n_shards")
    )
    n_bytes = different.agg(F.sum(F.col("at.windows").cast("long") + length)).first()[0] or 0
    shards = 1 + n_bytes // SHARD_BYTES
    spread = F.col("n_shards") > 1
    number = F.when(
        spread, F.xxhash64("key", F.pmod(F.xxhash64("print"), F.col("n_shards")))
    ).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards).cast("long")))
    asked = different.join(per_key, F.col("key") == F.col("sized_key")).select(
        F.col("at.text_key").alias("asked_key"),
        F.struct(
            number.alias("shard"), spread.alias("spread"), "key", "print",
            F.least("n", F.lit(2)).cast("int").alias("times"),
            F.col("at.windows").alias("windows"), F.col("at.start").alias("start"),
        ).alias("ask"),
    )
    asked = asked.groupBy("asked_key").agg(F.collect_list("ask").alias("asks"))
    one_each = texts.groupBy("text_key").agg(F.first("data").alias("data"))
    pieces = (
        one_each.join(asked, F.col("text_key") == F.col("asked_key"))
        .select("data", F.explode("asks").alias("ask"))
        .select(
            "ask.shard", "ask.spread", "ask.key", "ask.print", "ask.times", "ask.windows",
            F.expr(f"substring(data, ask.start + 1, ask.windows + {length - 1})").alias("bytes"),
        )
    )
    tasks = max(1 + shards // TASK_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_shard = pieces.repartition(tasks, "shard").sortWithinPartitions("shard")
    sorted_ = stored(sort_shards(by_shard, length), "sorted-shards")
    ranges = sorted_.select("key", "print", "starts", "counts").unionByName(
        merge_shards(sorted_.where("prints is not null"))
    )
    ranges = ranges.select(
        F.col("key").alias("found_key"),
        F.col("print").alias("found_print"),
        F.inline(F.arrays_zip(F.col("starts").alias("offset"), F.col("counts").alias("count"))),
    )
    same = (F.col("key") == F.col("found_key")) & (F.col("print") == F.col("found_print"))
    placed = shared.where("not whole").join(ranges, same)
    return found.unionByName(
        placed.select("text_key", (F.col("start") + F.col("offset")).alias("start"), "count")
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` per row of ``docs(doc_id, text)``.

    ``kept`` has the remaining bytes.
    """
    prepare(docs.sparkSession)
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"))
    # Equal texts have one key; what goes from one goes from all.
    texts = rows.select(
        "doc_id", F.unhex(F.substring(F.sha2("data", 256), 1, 32)).alias("text_key"), "data"
    )
    runs = repeated_windows(texts.select("text_key", "data"), length, shard_segments)
    runs = runs.distinct().groupBy(F.col("text_key").alias("cut_key")).agg(
        F.collect_list(F.struct("start", "count")).alias("runs")
    )
    joined = texts.join(runs, F.col("text_key") == F.col("cut_key"), "left").select("doc_id", "data", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            out = []
            for doc_id, data, runs in _rows(batch, "doc_id", "data", "runs"):
                spans = _union([(r["start"], r["start"] + r["count"] + length - 1) for r in runs or []])
                edges = [0, *[x for span in spans for x in span], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                removed = len(data) - len(kept)
                out.append((doc_id, len(data), removed, len(spans), hashlib.sha256(kept).hexdigest(), kept))
            yield _batch(
                out, doc_id=pa.int64(), n_bytes=pa.int64(), n_removed=pa.int64(), n_spans=pa.int64(),
                kept_sha256=pa.string(), kept=pa.binary(),
            )

    return joined.mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
