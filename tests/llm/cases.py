"""Awkward rows that every corpus operator must take, and small texts to make cases from."""

from __future__ import annotations

import random

LONG = " ".join(f"w{k % 997}x{k % 89}" for k in range(30_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, base string, fp long, spans int"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = ["".join(r.choice(["th", "er", "on", "an", "re", "ti", "es", "or"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(w.capitalize() + ("." if r.random() < 0.1 else "") if r.random() < 0.1 else w for w in out)


def awkward(spark):
    """Nulls in each column, empty, blank and very long texts, repeated ids and rows, clashing extra columns."""
    texts = [None, "", "  \n\t ", LONG, words(1, 80), words(1, 80), words(2, 60), "é ü 日本 💥 \x1c x", "a" * 50_000, words(3, 3)]
    rows = [(k, t, None if k == 4 else "en", None, None, "s", 1, "b", 7, 3) for k, t in enumerate(texts)]
    rows += [(None, words(4, 50), None, None, None, None, None, None, None, None), rows[4], rows[4], (6, words(5, 40), "de", "x", 1, "s", 1, "b", 7, 3)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame([*rows, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
