"""Language identification by bit-sliced Bloom filters over letter n-grams.

For each language, the letter trigrams in at least ``LEAST_SHARE`` of its training texts are put in a
Bloom filter. The filters are sliced: one table of slots, in which bit ``l`` of a slot belongs to
language ``l``, so reading an n-gram's slots and taking their common bits gives all languages that
contain it. For a text, the bits of its n-grams are counted per language. A filter that is filled to a
share f answers wrongly for about f to the power of the number of hashes; the counts are corrected for
that, and the language with the largest corrected share is the answer, that share its score.

Texts that are null or have no letter are ``und`` with score 0; so is every text if nothing is learned.
Among equal shares the language first in order wins. Texts without a language and held-out ones are
not learned from; a row with a null id is never held out. Rows are handled one by one, so repeated
rows and further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linecite.llm.common import hash_share, held_out, prepare, slices

#: About so many texts are learned from, chosen by a hash of their id, and n-grams per language.
TRAINING_ROWS = 6000
MOST_GRAMS = 20_000
LEAST_SHARE = 0.01
HASHES = 3
SLOTS_PER_GRAM = 12
UNKNOWN = "und"
_U = np.uint64
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """True for the code points that are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_ids(text: str | None) -> np.ndarray:
    """Hashes of the trigrams of the text's words, a space before and behind each; repeats included."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letter_table()[points]
    if not letter.any():
        return np.zeros(0, np.uint64)
    points = np.concatenate([[0], np.where(letter, points, 0), [0]]).astype(np.uint64)
    # One space between words.
    keep = np.append(True, (points[1:] != 0) | (points[:-1] != 0))
    points = points[keep]
    grams = points[:-2] << _U(42) | points[1:-1] << _U(21) | points[2:]
    grams = grams[points[1:-1] != 0]
    grams = (grams ^ (grams >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return grams ^ (grams >> _U(29))


@dataclass(frozen=True)
class SlicedFilters:
    """``slots``: 64 languages per column of bits."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, languages: list[str], grams: dict[str, np.ndarray]) -> "SlicedFilters":
        most = max((len(g) for g in grams.values()), default=1)
        size = 1 << max(10, int(most * SLOTS_PER_GRAM).bit_length())
        slots = np.zeros((size, -(-len(languages) // 64) or 1), np.uint64)
        filled = np.zeros(len(languages))
        for i, language in enumerate(languages):
            for at in cls._places(grams.get(language, np.zeros(0, np.uint64)), size):
                slots[at, i // 64] |= _U(1 << i % 64)
            filled[i] = ((slots[:, i // 64] >> _U(i % 64)) & _U(1)).mean()
        return cls(languages, slots, filled**HASHES)

    @staticmethod
    def _places(grams: np.ndarray, size: int) -> Iterator[np.ndarray]:
        step = (grams >> _U(40)) | _U(1)
        for k in range(HASHES):
            yield ((grams + _U(k) * step) & _U(size - 1)).astype(np.int64)

    def containing(self, grams: np.ndarray) -> np.ndarray:
        """Bits of all languages whose filter has each n-gram."""
        bits = np.full((len(grams), self.slots.shape[1]), ~_U(0), np.uint64)
        for at in self._places(grams, len(self.slots)):
            bits &= self.slots[at]
        return bits

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = gram_ids(text)
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        bits = self.containing(grams)
        counts = np.array(
            [int(((bits[:, i // 64] >> _U(i % 64)) & _U(1)).sum()) for i in range(len(self.languages))]
        )
        share = (counts / len(grams) - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9)
        best = int(np.argmax(share))
        return self.languages[best], float(np.clip(share[best], 0.0, 1.0))


def train(docs: DataFrame, rows: int = TRAINING_ROWS) -> SlicedFilters:
    """Learn from about ``rows`` of the texts of ``docs(doc_id, text, lang)`` that are not held out.

    Texts are counted in the executors; at most ``MOST_GRAMS`` n-grams per language come to the driver.
    """
    prepare(docs.sparkSession)
    usable = docs.select("doc_id", "text", F.col("lang").alias("language")).where(
        F.col("language").isNotNull() & ~held_out(F.col("doc_id"), 4, 2)
    )
    share = rows / max(1, usable.count())
    chosen = usable.where(hash_share(F.col("doc_id"), share, "language")).select("language", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: dict[str, list[np.ndarray]] = {}
            for language, text in zip(batch.column("language").to_pylist(), batch.column("text").to_pylist()):
                found.setdefault(language, []).append(np.unique(gram_ids(text)))
            for language, texts in found.items():
                grams, times = np.unique(np.concatenate(texts), return_counts=True)
                # The number of texts goes along as the count of a gram that does not occur.
                grams, times = np.append(grams, _U(0)), np.append(times, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(grams)), pa.array(grams.view(np.int64)), pa.array(times)],
                    ["language", "gram", "texts"],
                )

    counts = chosen.mapInArrow(count, "language string, gram long, texts long")
    counts = counts.groupBy("language", "gram").agg(F.sum("texts").alias("texts"))
    totals = counts.where("gram = 0").select(F.col("language").alias("l"), F.col("texts").alias("all_texts"))
    frequent = counts.where("gram <> 0").join(totals, F.col("language") == F.col("l")).where(
        F.col("texts") >= F.col("all_texts") * LEAST_SHARE
    )
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("texts"), "gram"))
    kept = frequent.withColumn("rank", rank).where(F.col("rank") <= MOST_GRAMS).select("language", "gram")
    grams: dict[str, list[int]] = {}
    for row in kept.collect():
        grams.setdefault(row["language"], []).append(row["gram"])
    languages = sorted(grams)
    return SlicedFilters.build(
        languages, {k: np.sort(np.array(v, np.int64)).view(np.uint64) for k, v in grams.items()}
    )


def identify(docs: DataFrame, filters: SlicedFilters) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs(doc_id, text)``."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [filters.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id"), 4, 2).alias("held_out")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
