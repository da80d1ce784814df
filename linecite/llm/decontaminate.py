"""Benchmark decontamination: pigeonhole edit matching.

A document is contaminated by an item when a stretch of it is within an edit distance of ``rate``
(default 0.1) of the item's length from the whole item, both lower-cased with white space as single
spaces. An item with a budget of e errors is cut into e + 1 pieces; one of them occurs unchanged in
every such stretch. One pass of an automaton finds the pieces. Pieces come from halving the item and
sharing out the budget, so a hit is verified upwards: first the block of two pieces around it with
the small budget of that block, then larger blocks, last the item. Each block is verified with Myers'
bit-parallel distance, so accidental hits end after a few characters.

Null and empty texts and items match nothing. Repeated items with one text each are reported, repeated
documents too. Items come to the driver in groups of at most ``GROUP_CHARS``, one pass per group; there
is one group unless the benchmark is very large.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecite.llm.common import prepare, slices

ERROR_RATE = 0.1
#: Items of about so many characters are matched in one pass.
GROUP_CHARS = 8_000_000


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers_distance(pattern: str, text: str) -> int:
    """The smallest edit distance between ``pattern`` and any stretch of ``text``."""
    size = len(pattern)
    if not size:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best = full, 0, size, size
    for c in text:
        match = masks.get(c, 0)
        carried = ((match & up) + up) ^ up | match | down
        plus = down | ~(carried | up) & full
        minus = up & carried
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best = score
        plus, minus = plus << 1 & full, minus << 1 & full
        up = minus | ~(carried & full | plus) & full
        down = plus & carried
        # The first row stays zero, so a match may begin anywhere.
    return best


class Block:
    """A stretch of an item with its error budget, halved until the budget is zero."""

    __slots__ = ("start", "end", "budget", "parent")

    def __init__(self, start: int, end: int, budget: int, parent: "Block | None"):
        self.start, self.end, self.budget, self.parent = start, end, budget, parent

    def pieces(self) -> Iterator["Block"]:
        if self.budget == 0:
            yield self
            return
        # If both halves had more errors than their share, the block would have more than its own.
        left = (self.budget - 1) // 2
        right = self.budget - 1 - left
        middle = self.start + (self.end - self.start) * (left + 1) // (self.budget + 1)
        yield from Block(self.start, middle, left, self).pieces()
        yield from Block(middle, self.end, right, self).pieces()

    def beside(self, item: str) -> list[tuple[int, str]]:
        """Pieces of what the parent adds, with places from this block's start; one occurs near it."""
        if self.parent is None:
            return []
        parent, cuts = self.parent, self.parent.budget + 1
        a, b = (self.end, parent.end) if self.start == parent.start else (parent.start, self.start)
        at = [a + (b - a) * i // cuts for i in range(cuts + 1)]
        return [(x - self.start, item[x:y]) for x, y in zip(at, at[1:])]


class ItemMatcher:
    """Finds items in texts. ``items``: ``(item_id, text)`` pairs."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.rate = rate
        by_text: dict[str, list[int]] = {}
        for item_id, text in items:
            if key := normalised(text):
                by_text.setdefault(key, []).append(item_id)
        self.texts = list(by_text)
        self.ids = [sorted(by_text[t], key=lambda i: (i is None, i)) for t in self.texts]
        pieces: dict[str, list[tuple[int, Block, list[tuple[int, str]]]]] = {}
        for k, text in enumerate(self.texts):
            budget = min(int(len(text) * rate), len(text) - 1)
            for block in Block(0, len(text), budget, None).pieces():
                piece = text[block.start : block.end]
                pieces.setdefault(piece, []).append((k, block, block.beside(text)))
        self.pieces = list(pieces.items())
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def matches(self, text: str | None) -> dict[int, int]:
        """The smallest distance by index of the item text."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for piece, uses in self.pieces:
                self._automaton.add_word(piece, (len(piece), uses))
            self._automaton.make_automaton()
        found: dict[int, int] = {}
        if not self.pieces:
            return found
        text = normalised(text)
        seen: dict[tuple, int] = {}
        for end, (size, uses) in self._automaton.iter(text):
            at = end + 1 - size
            for k, block, beside in uses:
                if found.get(k) == 0:
                    continue
                if beside:
                    slack = block.parent.budget
                    for offset, part in beside:
                        place = at + offset
                        if text.find(part, max(0, place - slack), max(0, place + len(part) + slack)) >= 0:
                            break
                    else:
                        continue
                distance = self._climb(text, at, k, block, seen)
                if distance is not None:
                    found[k] = min(distance, found.get(k, distance))
        return found

    def _climb(self, text: str, at: int, k: int, piece: Block, seen: dict) -> int | None:
        """The distance of the item around a piece found at ``at``, or None beyond the budget."""
        item, block, distance = self.texts[k], piece.parent, 0
        while block is not None:
            begin = at - (piece.start - block.start) - block.budget
            end = at + (block.end - piece.start) + block.budget
            # Not cut at zero here: windows cut there begin alike but end apart.
            key = (k, id(block), begin)
            if key not in seen:
                seen[key] = myers_distance(item[block.start : block.end], text[max(0, begin) : end])
            distance = seen[key]
            if distance > block.budget:
                return None
            block = block.parent
        return distance


def _matchers(benchmark: DataFrame, rate: float) -> Iterator[ItemMatcher]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        "length(text) > 0"
    )
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = -(-chars // GROUP_CHARS) or 1
    for group in range(groups):
        chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == group)
        yield ItemMatcher([tuple(r) for r in chosen.collect()], rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """``doc_id, item_id, distance``: the items found in each row of ``docs(doc_id, text)``."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def find(matcher: ItemMatcher):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                ids = batch.column("doc_id").to_pylist()
                found = [
                    (doc, item, distance)
                    for doc, text in zip(ids, batch.column("text").to_pylist())
                    for k, distance in matcher.matches(text).items()
                    for item in matcher.ids[k]
                ]
                columns = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                     pa.array(columns[2], pa.int32())],
                    ["doc_id", "item_id", "distance"],
                )

        return run

    result = None
    for matcher in _matchers(benchmark, rate):
        part = rows.mapInArrow(find(matcher), "doc_id long, item_id long, distance int")
        result = part if result is None else result.unionByName(part)
    return result


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns kept."""
    prepare(docs.sparkSession)

    def keep(matcher: ItemMatcher):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                texts = batch.column("text").to_pylist()
                yield batch.filter(pa.array([not matcher.matches(t) for t in texts], pa.bool_()))

        return run

    for matcher in _matchers(benchmark, rate):
        docs = docs.mapInArrow(keep(matcher), docs.schema)
    return docs
