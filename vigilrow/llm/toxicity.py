"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased runs of letters and non-ASCII bytes. A document's features are the distinct
hashed unigrams (whole words and their first 4, 5 and 6 bytes, which stand for a word's inflections),
bigrams and one-gap skip-grams of its whole text, each with value 1. Each coordinate
has its own learning rate; the L1 term leaves most weights at exactly zero, so that the model is a short
list of (coordinate, weight) pairs, bounded by 2**bits, and can be broadcast.

Training: rows of labels with toxic 0 or 1 whose document exists, at most about `max_rows` of them,
chosen by a hash of doc_id. Rounds of training run on shards; between rounds the shards' states are
averaged coordinate by coordinate in Spark.

Edge cases: null or empty texts have the bias alone; null labels are not learned from; repeated rows each
count; without any usable label every score is the clipped prior 0.5 - epsilon, that is predicted 0;
extra columns of either table are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import LOWER, Hashes, bounded_sample, materialize, mix, shared_dir

#: Letters stay (A-Z lower-cased), bytes from 0x80 stay, all else is space.
_WORDS = bytes(LOWER[b] if chr(b).isascii() and chr(b).isalpha() or b >= 0x80 else 0x20 for b in range(256))


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 0.1
    rounds: int = 2
    epochs: int = 2
    shards: int = 4
    max_rows: int = 20_000


class Stems(dict):
    """For each word the hashes of its first 4, 5 and 6 bytes; of a shorter word, of the word."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = b"".join(xxhash.xxh3_64_digest(word[:k], k) for k in (4, 5, 6))
        return value


def features(text: str | None, hashes: Hashes, stems: Stems, bits: int) -> np.ndarray:
    """Hashed coordinates of a text, with repeats."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
    if not words:
        return np.empty(0, np.int64)
    h, odd = hashes.of(words), np.uint64(0xD6E8FEB86659FD93)
    parts = [h, np.frombuffer(b"".join(map(stems.__getitem__, set(words))), np.uint64)]
    if len(h) > 1:
        parts.append(mix(h[:-1] * odd + h[1:]))
    if len(h) > 2:
        parts.append(mix(h[:-2] * odd + h[2:] + np.uint64(1)))
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


def _pressed(sorted_coordinates: np.ndarray) -> bytes:
    """Gaps between coordinates, compressed: a third of the plain size."""
    return zlib.compress(np.diff(sorted_coordinates, prepend=0).astype(np.int32).tobytes(), 1)


def _opened(pressed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(pressed), np.int32).cumsum(dtype=np.int32)


def _weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
    return np.where(np.abs(z) <= s.l1, 0.0, w)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _ftrl(rows: list[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray, s: Settings) -> None:
    """Passes over rows; the last coordinate is the bias."""
    for epoch in range(s.epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            x, y = rows[k]
            w = _weights(z[x], n[x], s)
            g = float(_sigmoid(w.sum())) - y
            step = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / s.alpha
            z[x] += g - step * w
            n[x] += g * g


def train(documents: DataFrame, labels: DataFrame, usable: Column, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) learned from the labelled documents for which `usable` (over doc_id) holds."""
    spark = documents.sparkSession
    shared_dir(spark)
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & usable)
    # max_rows bounds this side, whatever the size of labels
    sample = F.broadcast(bounded_sample(rows, "doc_id", s.max_rows))
    joined = documents.select("doc_id", "text").join(sample, "doc_id")

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, stems = Hashes(), Stems()
        for b in batches:
            x = [_pressed(np.append(np.unique(features(t, hashes, stems, s.bits)), 1 << s.bits)) for t in b.text]
            yield pd.DataFrame({"shard": b.doc_id % s.shards, "doc_id": b.doc_id, "toxic": b.toxic, "x": x})

    data = materialize(joined.mapInPandas(featurize, "shard long, doc_id long, toxic int, x binary"), "toxicity")
    idx, z0, n0 = np.empty(0, np.int64), np.empty(0), np.empty(0)
    size = (1 << s.bits) + 1
    for _ in range(s.rounds):

        def learn(group: pd.DataFrame) -> pd.DataFrame:
            z, n = np.zeros(size), np.zeros(size)
            z[idx], n[idx] = z0, n0  # at most `size` coordinates
            group = group.sort_values("doc_id", kind="stable")
            _ftrl([(_opened(x), y) for x, y in zip(group.x, group.toxic)], z, n, s)
            at = np.flatnonzero(n)
            return pd.DataFrame({"at": at, "z": z[at], "n": n[at]})

        merged = data.groupBy("shard").applyInPandas(learn, "at long, z double, n double")
        shards = max(1, data.select("shard").distinct().count())
        mean = merged.groupBy("at").agg((F.sum("z") / shards).alias("z"), (F.sum("n") / shards).alias("n")).toPandas().sort_values("at")
        idx, z0, n0 = mean["at"].to_numpy(np.int64), mean["z"].to_numpy(float), mean["n"].to_numpy(float)
    w = _weights(z0, n0, s)
    return idx[w != 0], w[w != 0]


def _scorer(shared, s: Settings):
    """A function from a text to its score; shared: the broadcast model."""
    dense = np.zeros((1 << s.bits) + 1, np.float64)
    dense[shared.value[0]] = shared.value[1]
    bias, hashes, stems = dense[-1] if len(shared.value[0]) else -1e-9, Hashes(), Stems()

    def score_of(text: str | None) -> float:
        x = features(text, hashes, stems, s.bits)
        return _sigmoid(dense[np.unique(x[dense[x] != 0])].sum() + bias)

    return score_of


def _shared(documents: DataFrame, model: tuple[np.ndarray, np.ndarray]):
    return documents.sparkSession.sparkContext.broadcast((model[0].astype(np.int32), model[1].astype(np.float32)))


def keep_clean(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], s: Settings = Settings()) -> DataFrame:
    """The rows of documents, all columns, whose score is below 0.5."""
    shared = _shared(documents, model)
    opened: list = []  # a task opens the model once

    def probability(text: str | None) -> float:
        if not opened:
            opened.append(_scorer(shared, s))
        return float(opened[0](text))

    # row by row: an Arrow batch would hold all columns of 10,000 documents, in the JVM and in Python
    return documents.filter(F.udf(probability, "double", useArrow=False)("text") < 0.5)


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], s: Settings = Settings()) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) for every row of documents."""
    shared = _shared(documents, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score_of = _scorer(shared, s)
        for b in batches:
            p = np.fromiter(map(score_of, b.text), np.float64, len(b))
            yield pd.DataFrame({"doc_id": b.doc_id, "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, predicted int")
