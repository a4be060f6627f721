"""Image-to-plan homographies: least-squares fit by groups, and their errors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geometry import apply_homography


def _normaliser(p: np.ndarray) -> np.ndarray:
    """Similarity that centres points and gives them mean distance sqrt(2)."""
    c = p.mean(axis=0)
    s = np.sqrt(2) / max(np.linalg.norm(p - c, axis=1).mean(), 1e-12)
    return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])


def _through(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.c_[p, np.ones(len(p))] @ h.T
    return q[:, :2] / q[:, 2:]


def fit_homography(img: np.ndarray, plan: np.ndarray, steps: int = 100) -> np.ndarray:
    """Matrix with the least squared plan error over all pairs (four or more, no outlier rejection).

    A linear solution in normalised coordinates, then damped Gauss-Newton on the plan error itself.
    """
    if len(img) < 4:
        raise ValueError("a homography needs four pairs")
    t, u = _normaliser(img), _normaliser(plan)
    a, b = _through(t, img), _through(u, plan)
    rows = []
    for (x, y), (p, q) in zip(a, b):
        rows += [[x, y, 1, 0, 0, 0, -p * x, -p * y, -p], [0, 0, 0, x, y, 1, -q * x, -q * y, -q]]
    h = np.linalg.svd(np.array(rows))[2][-1]
    h = h / h[8] if abs(h[8]) > 1e-12 else h
    par, damp = h[:8].copy(), 1e-3
    residual = lambda v: (_through(np.append(v, 1.0).reshape(3, 3), a) - b).ravel()
    err = residual(par)
    for _ in range(steps):
        m = np.append(par, 1.0).reshape(3, 3)
        q = np.c_[a, np.ones(len(a))]
        d = q @ m[2]
        f = _through(m, a)
        jac = np.zeros((2 * len(a), 8))
        jac[0::2, 0:3] = jac[1::2, 3:6] = q / d[:, None]
        jac[0::2, 6:8] = -f[:, :1] * a / d[:, None]
        jac[1::2, 6:8] = -f[:, 1:] * a / d[:, None]
        normal, slope = jac.T @ jac, jac.T @ err
        trial = par - np.linalg.solve(normal + damp * np.diag(np.diag(normal) + 1e-12), slope)
        new = residual(trial)
        if new @ new < err @ err:
            done = err @ err - new @ new < 1e-18
            par, err, damp = trial, new, damp / 10
            if done:
                break
        else:
            damp *= 10
            if damp > 1e12:
                break
    out = np.linalg.inv(u) @ np.append(par, 1.0).reshape(3, 3) @ t
    return out / out[2, 2]


def fit_cameras(pairs: DataFrame) -> DataFrame:
    """(camera, n, h, problem) from pairs (camera, ix, iy, px, py); under four pairs h is null with a problem."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        cam, n = pdf["camera"].iloc[0], len(pdf)
        ok = n >= 4
        h = fit_homography(pdf[["ix", "iy"]].to_numpy(float), pdf[["px", "py"]].to_numpy(float)).tolist() if ok else None
        return pd.DataFrame({"camera": [cam], "n": [n], "h": [h], "problem": [None if ok else f"{n} pairs, four are needed"]})

    return pairs.groupBy("camera").applyInPandas(fit, "camera string, n long, h array<array<double>>, problem string")


def landmark_pairs(scene: DataFrame) -> DataFrame:
    """(camera, landmark, ix, iy, px, py) of a scene's landmarks: those each camera has."""
    marks = scene.select(F.posexplode("landmarks").alias("landmark", "m"))
    return marks.select("landmark", F.col("m.map").alias("p"), F.explode("m.cams").alias("camera", "i")).select(
        "camera", "landmark", F.col("i")[0].alias("ix"), F.col("i")[1].alias("iy"), F.col("p")[0].alias("px"), F.col("p")[1].alias("py"))


def errors(pairs: DataFrame, fitted: DataFrame) -> DataFrame:
    """Pairs with their plan error in pixels."""
    both = pairs.join(fitted.where("h is not null").select("camera", "h"), "camera")
    x, y = apply_homography(F.col("h"), F.col("ix"), F.col("iy"))
    return both.withColumn("error", F.hypot(x - F.col("px"), y - F.col("py"))).drop("h")


def accuracy(errs: DataFrame) -> DataFrame:
    """(camera, rms, worst)."""
    return errs.groupBy("camera").agg(F.round(F.sqrt(F.avg(F.col("error") ** 2)), 2).alias("rms"), F.round(F.max("error"), 2).alias("worst"))
