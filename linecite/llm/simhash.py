"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; two documents link when theirs differ in at most two. Cut into two segments
of 32 bits, two such fingerprints have a segment that differs in at most one bit (three differing
bits would be needed otherwise). So each segment is indexed under its 32 one-wildcard variants, the
segment with one bit left out, and linked fingerprints share a variant.

Variants are counted. One with a single fingerprint links nothing. One with two gives a pair, which
is verified. The members of fuller variants are not paired with each other: each is indexed once more
under itself and its 64 one-bit changes, and members that share such a change are at most two bits
apart. A change has at most 65 members, so no group is unbounded, and work is linear in the number of
different fingerprints. Every linked pair is found: it shares a variant, and either that variant has
no third member and the pair is verified, or both members are indexed under the change between them.

Null and empty texts, or ones of white space, have the fingerprint zero and link like others. Rows
with a null id get a fingerprint and the component of their fingerprint; they never name one, so it
is null where no linked row has an id. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linecite.llm.common import prepare, slices, stored
from linecite.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    # Of bytes, lower() changes A-Z only and split() parts at space and \t \n \v \f \r.
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(words, len(found))
    spans = zip(starts[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist())
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) per row of ``docs(doc_id, text)``."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))],
                ["doc_id", "fp"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, fp long")


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


def _segment_variants(fp: Column) -> Column:
    """64 keys: both 32-bit segments with each of their bits left out in turn."""
    low = fp.bitwiseAND(_long(0xFFFFFFFF))
    keys = []
    for part, segment in ((0, low), (1, F.shiftrightunsigned(fp, 32))):
        for bit in range(32):
            kept = segment.bitwiseAND(_long(0xFFFFFFFF ^ (1 << bit)))
            keys.append(kept.bitwiseOR(_long((part << 37) | (bit << 32))))
    return F.array(*keys)


def _one_bit_changes(fp: Column) -> Column:
    """The fingerprint and its 64 neighbours at one bit."""
    return F.array(fp, *[fp.bitwiseXOR(_long(1 << bit)) for bit in range(64)])


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def linked_pairs(distinct: DataFrame) -> DataFrame:
    """``a, b``: links between different fingerprints ``fp``, enough to connect all that link."""
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Each row becomes 64, so the few files of a narrow table are spread first.
    spread = distinct.repartition(tasks, "fp")
    variants = spread.select("fp", F.explode(_segment_variants(F.col("fp"))).alias("key"))
    shared = stored(
        variants.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("n > 1"),
        "variants",
    )
    pairs = shared.where("n = 2").select("a", "b").where(_near("a", "b"))
    crowded = shared.where("n > 2").select(F.col("key").alias("crowded_key"))
    members = (
        variants.join(crowded, F.col("key") == F.col("crowded_key")).select("fp").distinct()
    )
    changes = members.select("fp", F.explode(_one_bit_changes(F.col("fp"))).alias("change"))
    first = F.min("fp").over(Window.partitionBy("change"))
    stars = changes.select(first.alias("a"), F.col("fp").alias("b")).where("a <> b")
    return pairs.unionByName(stars.where(_near("a", "b"))).distinct()


def with_components(prints: DataFrame) -> DataFrame:
    """Add ``component_id``, the smallest ``doc_id`` reachable over links, to ``doc_id, fp``."""
    prints = stored(prints, "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    found = connected_components(linked_pairs(classes.select("fp")))
    # Components of fingerprints first, then the smallest id over each.
    placed = classes.join(found, classes.fp == found.node, "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    named = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_print = placed.join(named, "component").select(F.col("fp").alias("class_fp"), "component_id")
    return prints.join(by_print, F.col("fp") == F.col("class_fp")).select(
        "doc_id", "fp", "component_id"
    )


def simhash_components(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs(doc_id, text)``."""
    return with_components(fingerprints(docs, words)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first_of_each(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` whose id names their component: one document of each group.

    Rows that repeat an id stay once. Rows without an id all stay: nothing tells them apart.
    """
    named = docs.where("doc_id is not null")
    kept = (
        simhash_components(named.select("doc_id", "text"), words)
        .where("component_id = doc_id")
        .select(F.col("doc_id").alias("kept_id"))
        .distinct()
    )
    first = named.join(kept, named["doc_id"] == kept["kept_id"], "left_semi")
    return first.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))
