"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader, sparse dot products.

Features of a text, hashed into ``2**bits`` places: words and marks (case kept), pairs of neighbours, and triples of
word shapes (case, digits, the mark itself, or "same as the word before"). Values are square roots of counts, scaled
to unit length, so texts of any length compare. Labels, language, source and id are never features.

Training takes at most about ``sample`` labelled rows (documented bound, 12,000 by default): a labelled row is taken
if the hash of its id falls under ``sample / n_labelled``, which doesn't depend on partitioning. Where ids repeat, more
rows can be taken; of those the first ``most`` in the order of the hash are learned from (documented bound, 24,000 by
default). The rows go through one task in that order; the weights (``2**bits`` floats, 1 MB) are all that reaches the
driver. Scoring is a narrow pass over whole texts.

Defined cases: null or empty texts score the bias alone; labels outside {0, 1} and null labels are not learned from; with no
labelled rows every score is 0.5; repeated rows are scored each; an empty table gives an empty table; extra columns
of the input are kept out of the result and may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import TwoGenerationCache, fold, keep_rows, map_texts, saved, slices

TOKENS = re.compile(r"\w+|[^\w\s]+").findall
SAMPLE, MOST, BITS, EPOCHS = 12_000, 24_000, 18, 3


def shape(token: str) -> int:
    if not token[0].isalnum() and token[0] != "_":
        return 16 + zlib.crc32(token.encode()) % 4000
    if token.isdigit():
        return 1
    if token.islower():
        return 2 if len(token) > 2 else 3
    if token.isupper():
        return 4 if len(token) > 1 else 5
    if token[0].isupper() and token[1:].islower():
        return 6
    return 7 if any(c.isdigit() for c in token) else 8


class Features:
    """Sparse hashed features of texts, with a bounded cache of tokens."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.cache = TwoGenerationCache(200_000)

    def _codes(self, tokens: list[str]) -> np.ndarray:
        get, put, codes = self.cache.get, self.cache.put, []
        for t in tokens:
            code = get(t)
            if code is None:
                code = zlib.crc32(t.encode()) << 12 | shape(t)
                if len(t) <= 64:
                    put(t, code)
            codes.append(code)
        return np.array(codes, np.uint64)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of a text; place 0 is the bias."""
        codes = self._codes(TOKENS(text or ""))
        if not len(codes):
            return np.zeros(1, np.int64), np.ones(1)
        words, shapes = codes >> np.uint64(12), codes & np.uint64(4095)
        shapes[1:][words[1:] == words[:-1]] = 0
        odd = np.uint64(0x9E3779B97F4A7C15)
        keys = [words * odd + np.uint64(1), shapes * odd + np.uint64(2)]
        if len(codes) > 1:
            keys.append((words[:-1] * odd + words[1:]) * odd + np.uint64(3))
        if len(codes) > 2:
            keys.append((shapes[:-2] << np.uint64(24) | shapes[1:-1] << np.uint64(12) | shapes[2:]) * odd + np.uint64(4))
        mixed = np.concatenate(keys)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        places, counts = np.unique((mixed >> self.shift).astype(np.int64), return_counts=True)
        values = np.sqrt(counts)
        values /= np.sqrt(counts.sum())
        return np.append(places[places > 0], 0), np.append(values[places > 0], 1.0)


class Leader:
    """Follow-the-regularised-leader with per-coordinate rates and L1 and L2 penalties."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(places)
        g = (sigmoid(float(w @ values)) - label) * values
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[places] = n + g * g


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def train(labelled: DataFrame, most: int = MOST, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from rows (key, text, label), the first ``most`` by hash of their key."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, leader, rows = Features(bits), Leader(bits), []
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                places, values = features(text.as_py())
                rows.append((places.astype(np.int32), values.astype(np.float32), label))
        for _ in range(epochs):
            for places, values, label in rows:
                leader.learn(places, values.astype(float), label)
        yield pa.RecordBatch.from_pydict({"weights": [leader.weights().astype("<f4").tobytes()]})

    ordered = labelled.orderBy(F.xxhash64("key"), "key", "label", F.xxhash64("text")).limit(most)
    rows = ordered.select("text", "label").coalesce(1).mapInArrow(fit, "weights binary").collect()
    return np.frombuffer(rows[0][0], "<f4").astype(float) if rows else np.zeros(1 << bits)


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: int = 1) -> DataFrame:
    """(key, text, label) of about ``sample`` labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").alias("key"), F.col("quality").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("key").isNotNull() & (fold("key", 3) != held_out))
    n = known.count()
    place = F.pmod(F.xxhash64(F.col("key"), F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = saved(known.where(place < F.lit(sample / max(n, 1))), "quality-sample")
    texts = docs.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(taken, "key")


def score(docs: DataFrame, weights: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits doubles, whatever the input
    bits = int(np.log2(len(weights)))

    def make():
        features, w = Features(bits), shared.value

        def kernel(batch: pa.RecordBatch):
            for part in slices(batch, 1):
                for key, text, held in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist()):
                    places, values = features(text.as_py())
                    p = sigmoid(float(w[places] @ values))
                    yield key, held, p, int(p >= 0.5)

        return kernel

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), (fold(id_column, 3) == 1).alias("held_out"))
    return map_texts(rows, f"`{id_column}` {kind}, held_out boolean, score double, predicted int", make)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Train on the labelled rows outside fold 1 and score every document."""
    return score(docs, train(labelled_rows(docs, labels, sample)))


def keep_good(docs: DataFrame, weights: np.ndarray, least: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, columns untouched."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = shared.value
        features = Features(int(np.log2(len(w))))

        def passes(text: str | None) -> bool:
            places, values = features(text)
            return sigmoid(float(w[places] @ values)) >= least

        return passes

    return keep_rows(docs, text_column, make)
