"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL.

Words and runs of punctuation, alone and in pairs, hash into ``2 ** bits`` weights; a word said again at
once is replaced by a mark for repetition. A text's features
are shares of its n-grams, so its length does not matter. Weights follow the regularised leader: each
coordinate keeps its gradient sum and squared sum, from which the weight is solved with an L1 and an
L2 penalty, so rare n-grams stay at exactly zero. A score is a sparse dot product.

Null and empty texts have no features and score as the bias alone. Rows are scored one by one, so
repeated rows, null ids and further columns change nothing. Without labelled rows every score is 0.5
and every text counts as good.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecite.llm.common import hash_share, held_out, prepare, slices

#: About so many labelled rows are trained on, chosen by a hash of their id.
TRAINING_ROWS = 6000
_AGAIN = np.uint64(0x5EED)
_TOKEN = re.compile(r"\w+|[^\w\s]+")


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    #: Scale of the feature values, which are shares of a text's n-grams.
    gain: float = 16.0


class _WordHashes(dict):
    """Hash per word; forgets all once it is large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word)
        return value


_hashes = _WordHashes()


def feature_ids(text: str | None, bits: int) -> np.ndarray:
    """Hashed ids of the words, then of the pairs of neighbours, repeats included."""
    words = _TOKEN.findall((text or "").lower())
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    # Whatever the word, one that is said again at once is the same word to the model.
    h[1:][h[1:] == h[:-1]] = _AGAIN
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = np.concatenate([h * np.uint64(0x9E3779B97F4A7C15), pairs])
    return (mixed >> np.uint64(64 - bits)).astype(np.int32)


def train_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings):
    """``weights, bias`` after ``epochs`` passes over ``(ids, values, label)``, in the given order."""
    size = 1 << settings.bits
    z, n = np.zeros(size), np.zeros(size)
    bias_z = bias_n = 0.0

    def solve(z, n):
        shrunk = np.sign(z) * np.maximum(np.abs(z) - settings.l1, 0)
        return -shrunk / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2)

    def bias() -> float:
        return -bias_z / ((settings.beta + bias_n**0.5) / settings.alpha)

    for _ in range(settings.epochs):
        for ids, values, label in examples:
            w, b = solve(z[ids], n[ids]), bias()
            error = 1 / (1 + np.exp(-np.clip(w @ values + b, -35, 35))) - label
            g = error * values
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / settings.alpha * w
            n[ids] += g * g
            bias_z += error - ((bias_n + error**2) ** 0.5 - bias_n**0.5) / settings.alpha * b
            bias_n += error**2
    return solve(z, n).astype(np.float32), bias()


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    settings: Settings

    def score(self, text: str | None) -> float:
        """The probability of label 1."""
        ids = feature_ids(text, self.settings.bits)
        total = self.bias
        if len(ids):
            total += float(self.weights[ids].sum(dtype=np.float64)) / len(ids) * self.settings.gain
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.score(t) for t in texts], np.float64)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """``text, label, order`` of a bounded sample of the labelled documents not held out.

    A document labelled more than once counts with its smallest label.
    """
    usable = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .where(~held_out(F.col("doc_id"), 3, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"))
    )
    share = rows / max(1, usable.count())
    chosen = usable.where(hash_share(F.col("doc_id"), share, "quality")).limit(2 * rows)
    chosen = chosen.withColumnRenamed("doc_id", "labelled_id")
    # At most 2 * rows pairs of numbers, so a copy for every executor is small.
    return docs.select("doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")
    ).select("text", "label", F.xxhash64("doc_id", "text").alias("order"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, settings=Settings()):
    """Fit a :class:`QualityModel` to ``labels(doc_id, quality)`` of ``docs(doc_id, text)``.

    Features are taken in the executors. Only they, of at most ``2 * rows`` documents, come to the
    driver.
    """
    prepare(docs.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, values = [], []
            for text in batch.column("text").to_pylist():
                found, counts = np.unique(feature_ids(text, settings.bits), return_counts=True)
                ids.append(found.tobytes())
                share = counts / max(1, counts.sum()) * settings.gain
                values.append(share.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("label"), pa.array(ids, pa.binary()),
                 pa.array(values, pa.binary())],
                ["order", "label", "ids", "values"],
            )

    found = training_rows(docs, labels, rows).mapInArrow(
        features, "order long, label int, ids binary, values binary"
    )
    rows_found = sorted(found.collect(), key=lambda r: (r["order"], r["label"]))
    examples = [
        (np.frombuffer(r["ids"], np.int32), np.frombuffer(r["values"], np.float32).astype(float), r["label"])
        for r in rows_found
    ]
    weights, bias = train_ftrl(examples, settings)
    return QualityModel(weights, bias, settings)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs(doc_id, text)``, in one pass."""
    prepare(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = model.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores),
                 pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        held_out(F.col("doc_id"), 3, 1).alias("held_out"),
    )
    return rows.mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int"
    )


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns kept."""
    prepare(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = model.scores(batch.column("text").to_pylist()) >= 0.5
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
