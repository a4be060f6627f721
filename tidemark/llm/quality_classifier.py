"""Compression quality classifier.

Two zstandard dictionaries of one size are trained from good and from bad labelled texts; the size
follows the smaller class, so both are trained however few the labels. A text is cut into
blocks of ``BLOCK`` bytes, all of which are compressed with either dictionary; the sums of the
compressed sizes give the normalised difference (bad - good) / (bad + good), which is larger the
more the text is like the good ones. A logistic curve fitted on labelled texts that the
dictionaries did not see turns it into a probability.

Learning takes a bounded sample (``rows`` texts of at most ``longest`` characters) and happens in
the driver; the model sent to executors is two dictionaries and two numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.llm.common import held_out, label_sample

BLOCK, DICT_BYTES, LEVEL = 512, 96 * 1024, 3
SHARE, LEAST_DICT, LEAST_BLOCK = 4, 1024, 64
ROWS, LONGEST = 6000, 20_000


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    bias: float


@lru_cache(maxsize=4)
def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)


def difference(good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor, text: str | None) -> float:
    """(bad - good) / (bad + good) over all blocks of the text; 0 for an empty one."""
    raw = (text or "").encode()
    g = b = 0
    for k in range(0, len(raw), BLOCK):
        part = raw[k : k + BLOCK]
        g += len(good.compress(part))
        b += len(bad.compress(part))
    return (b - g) / (b + g) if raw else 0.0


def _blocks(texts: list[str]) -> list[bytes]:
    return [x for t in texts for r in (t.encode(),) for k in range(0, len(r), BLOCK) if len(x := r[k : k + BLOCK]) >= LEAST_BLOCK]


def _dictionary(blocks: list[bytes], size: int) -> bytes:
    """A dictionary of ``size`` bytes trained from all blocks; the blocks themselves where zstd finds too few to train from."""
    try:
        return zstandard.train_dictionary(size, blocks, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:size].ljust(64)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton steps with a little ridge; scaled so that steps are tame."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(sample: list[tuple[str, int]]) -> Model:
    """Dictionaries from two thirds of the sample, the curve from the rest; deterministic."""
    parts = {y: [t for t, v in sample if v == y and t] for y in (0, 1)}
    if not parts[0] or not parts[1]:
        return Model(b" " * 64, b" " * 64, 0.0, 4.0 if parts[1] else -4.0 if parts[0] else 0.0)
    seen = {y: [t for k, t in enumerate(x) if k % 3 or len(x) < 3] for y, x in parts.items()}
    rest = [(t, y) for y, x in parts.items() for k, t in enumerate(x) if k % 3 == 0]
    blocks = {y: _blocks(x) for y, x in seen.items()}
    # both dictionaries have one size, which the smaller class can fill SHARE times over
    size = max(LEAST_DICT, min(DICT_BYTES, min(sum(map(len, x)) for x in blocks.values()) // SHARE))
    good, bad = _dictionary(blocks[1], size), _dictionary(blocks[0], size)
    g, b = _compressor(good), _compressor(bad)
    slope, bias = _logistic(np.array([difference(g, b, t) for t, _ in rest]), np.array([float(y) for _, y in rest]))
    return Model(good, bad, slope, bias)


def _scorer(sent: Broadcast):
    def score(text: pd.Series) -> pd.Series:
        m = sent.value
        g, b = _compressor(m.good), _compressor(m.bad)
        x = np.fromiter((difference(g, b, t) for t in text), np.float64, len(text))
        return pd.Series(1 / (1 + np.exp(-np.clip(m.slope * x + m.bias, -30, 30))))

    return F.pandas_udf(score, DoubleType())


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = ROWS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents``.

    Labels are learned only from rows that are not held out. A null or empty text has the curve's
    value at difference 0. Rows without doc_id are scored and not held out. With labels of one
    class only, or none, every text gets one score. Repeated rows come back each; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    model = fit(label_sample(documents, labels, "quality", rows, longest))
    score = _scorer(documents.sparkSession.sparkContext.broadcast(model))
    scored = documents.select("doc_id", score("text").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
