"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its lower-cased words, pairs of neighbours, pairs
with one word between, and triples. Each coordinate has a rate of its own and the L1 term keeps at
zero those that do not earn their place, so the model sent to executors is a short list of weights.

Learning takes a bounded sample (``rows`` texts of at most ``longest`` characters), in the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.llm.common import held_out, label_sample

BITS, ROWS, LONGEST = 22, 8000, 20_000
ALPHA, BETA, L1, L2, ROUNDS = 1.0, 1.0, 6.0, 0.1, 6
_STRIP = re.compile(r"^\W+|[\W_]+$")


@dataclass(frozen=True)
class Model:
    places: np.ndarray  # sorted hashes with a weight
    weights: np.ndarray
    bias: float


class _Words(dict):
    """Word -> 32-bit hash of its lower-cased form without outer punctuation; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = crc32(_STRIP.sub("", word.lower()).encode())
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def features(text: str | None) -> np.ndarray:
    """Places (with repeats) of the n-grams and skip-grams of one whole text."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words)) * np.uint64(0x9E3779B97F4A7C15)
    parts = [h]
    for salt, gaps in ((1, (0, 1)), (2, (0, 2)), (3, (0, 1, 2))):  # pairs, skip-grams, triples
        n = len(h) - gaps[-1]
        if n > 0:
            x = np.full(n, salt, np.uint64)
            for g in gaps:
                x = (x ^ h[g : g + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
                x ^= x >> np.uint64(31)
            parts.append(x)
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(sample: list[tuple[str, int]], rounds: int = ROUNDS) -> Model:
    """FTRL-proximal over the sample in a fixed shuffled order, ``rounds`` times."""
    total, positive = len(sample), sum(y for _, y in sample)
    if not positive or positive == total:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0 if not total else 4.0 if positive else -4.0)
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    rows = [(np.unique(features(t)), float(y)) for t, y in sample]
    order = np.random.default_rng(7).permutation(total)
    weight = lambda z, n: np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    bias = 0.0
    for _ in range(rounds):
        for k in order.tolist():
            x, y = rows[k]
            zx, nx = z[x], n[x]
            w = weight(zx, nx)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = p - y
            step = (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA
            z[x], n[x] = zx + g - step * w, nx + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias  # no L1 on the bias
            bias_n += g * g
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
    w = weight(z, n)
    places = np.flatnonzero(w)
    return Model(places, w[places], float(bias))


def score_texts(model: Model, texts) -> np.ndarray:
    """Probabilities of the texts: each weight counts once a text."""
    table = np.zeros(1 << BITS, np.float32)
    table[model.places] = model.weights
    hit = table != 0
    out = np.empty(len(texts))
    for k, text in enumerate(texts):
        x = features(text)
        out[k] = table[np.unique(x[hit[x]])].sum(dtype=np.float64) + model.bias
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _scorer(sent: Broadcast):
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(score_texts(sent.value, text))

    return F.pandas_udf(score, DoubleType())


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = ROWS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents``.

    Labels are learned only from rows that are not held out. A null or empty text has the bias
    alone. Rows without doc_id are scored and not held out. With labels of one class only, or none,
    every text gets one score. Repeated rows come back each; other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    model = fit(label_sample(documents, labels, "toxic", rows, longest))
    score = _scorer(documents.sparkSession.sparkContext.broadcast(model))
    scored = documents.select("doc_id", score("text").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
