"""Held objects, contacts with fixtures, and the run statistics of a detection table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions import geometry as G
from tidemark.operators import sequence
from tidemark.operators.joins import relabel

BOX = ("x1", "y1", "x2", "y2")


def holders(objects: DataFrame, people: DataFrame, on: list[str], least: float = 0.4) -> DataFrame:
    """Objects with person_id: who overlaps them most (to one decimal), the nearer centre on ties, null if none.

    ``objects`` has object_id, ``people`` person_id; both have ``on`` and a box.
    """
    p = people.select(*on, "person_id", *[F.col(c).alias(f"p_{c}") for c in BOX])
    o, q = [F.col(c) for c in BOX], [F.col(f"p_{c}") for c in BOX]
    share = G.overlap_fraction(o, q)
    apart = F.hypot((o[0] + o[2] - q[0] - q[2]) / 2, (o[1] + o[3] - q[1] - q[3]) / 2)
    found = objects.join(p, on).withColumns({"share": share, "apart": apart}).where(F.col("share") >= least)
    best = found.groupBy(*on, "object_id").agg(F.min_by("person_id", F.struct(-F.round("share", 1), F.col("apart"), F.col("person_id"))).alias("person_id"))
    return objects.join(best, [*on, "object_id"], "left")


def held_items(objects: DataFrame) -> DataFrame:
    """(person_id, label, n) of the objects that have a holder."""
    return objects.where("person_id is not null").groupBy("person_id", "label").agg(F.count("*").alias("n"))


def items_of(items: DataFrame) -> DataFrame:
    """(person_id, items): label counts, most first, ties by label."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "label", "n")))
    return items.groupBy("person_id").agg(F.map_from_entries(F.transform(ranked, lambda s: F.struct(s["label"], s["n"]))).alias("items"))


def top_labels(items: DataFrame, k: int = 2) -> DataFrame:
    w = Window.partitionBy("person_id").orderBy(F.desc("n"), "label")
    return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def by_label(objects: DataFrame) -> DataFrame:
    return objects.groupBy("label").agg(F.count("*").alias("n"), F.count("person_id").alias("held"))


def carriers(objects: DataFrame, least: int = 3) -> DataFrame:
    """Persons holding something in ``least`` samples or more."""
    return objects.where("person_id is not null").groupBy("person_id").agg(F.count("*").alias("samples")).where(F.col("samples") >= least)


def clip_area(polygon: np.ndarray, box: tuple[float, float, float, float]) -> float:
    """Area of a polygon inside a box, by clipping at its four sides."""
    pts = polygon
    for axis, bound, keep_low in ((0, box[0], False), (0, box[2], True), (1, box[1], False), (1, box[3], True)):
        if not len(pts):
            return 0.0
        out = []
        inside = pts[:, axis] <= bound if keep_low else pts[:, axis] >= bound
        for k in range(len(pts)):
            a, b = pts[k - 1], pts[k]
            if inside[k] != inside[k - 1]:
                out.append(a + (b - a) * (bound - a[axis]) / (b[axis] - a[axis]))
            if inside[k]:
                out.append(b)
        pts = np.array(out).reshape(-1, 2)
    x, y = pts[:, 0], pts[:, 1]
    return float(abs(np.dot(x, np.roll(y, 1)) - np.dot(y, np.roll(x, 1))) / 2) if len(pts) else 0.0


def covered_share(pts: list[tuple[float, float]]):
    """Column function of a box: the share of it that the polygon covers. Exact areas, no pixels."""
    polygon = np.array(pts, float)

    def share(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
        area = (x2 - x1) * (y2 - y1)
        return pd.Series([clip_area(polygon, b) / s if s > 0 else 0.0 for *b, s in zip(x1, y1, x2, y2, area)], dtype=float)

    return F.pandas_udf(share, DoubleType())


def contacts(samples: DataFrame, fixtures: dict[str, list[tuple[float, float]]], least_conf: float = 0.3, least_share: float = 0.5) -> DataFrame:
    """(sample columns, fixture, contact): a visible wrist in the fixture, else the box over half covered."""
    kps = F.col("kps")
    out = None
    for name, pts in fixtures.items():
        wrist = F.lit(False)
        for k in G.WRISTS:
            p = F.get(kps, F.lit(k))
            wrist = wrist | F.coalesce((p["c"] >= least_conf) & G.in_or_on(p["x"], p["y"], pts), F.lit(False))
        xs, ys = [p[0] for p in pts], [p[1] for p in pts]
        near = samples.where((F.col("x2") >= min(xs)) & (F.col("x1") <= max(xs)) & (F.col("y2") >= min(ys)) & (F.col("y1") <= max(ys)))
        found = near.withColumn("fixture", F.lit(name)).withColumn("__s", covered_share(pts)(*BOX)).withColumn(
            "contact", F.when(wrist, "wrist").when(F.col("__s") >= least_share, "box")).where("contact is not null").drop("__s")
        out = found if out is None else out.unionByName(found)
    return out


def contact_segments(found: DataFrame, gap: float = 1.0, least: float = 1.0) -> DataFrame:
    """(track_id, fixture, run, t_start, t_end, n, wrists, contact) of contacts that last, in order."""
    segs = sequence.runs(found, ["track_id", "fixture"], "t", ["t"], gap, F.count_if(F.col("contact") == "wrist").alias("wrists"))
    kept = segs.where(F.col("t_end") - F.col("t_start") >= least)
    return kept.withColumn("contact", F.when(F.col("wrists") > 0, "wrist").otherwise("box")).orderBy("t_start", "track_id")


def crop_area(boxes: DataFrame, keys: list[str], fixture: tuple[float, float, float, float], pad: float = 0.15) -> DataFrame:
    """The box around a fixture and all person boxes of a segment, wider by ``pad`` on each side."""
    g = boxes.groupBy(*keys).agg(*[f(c).alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))])
    e = [F.least("x1", F.lit(fixture[0])), F.least("y1", F.lit(fixture[1])), F.greatest("x2", F.lit(fixture[2])), F.greatest("y2", F.lit(fixture[3]))]
    w, h = (e[2] - e[0]) * pad, (e[3] - e[1]) * pad
    return g.select(*keys, (e[0] - w).alias("x1"), (e[1] - h).alias("y1"), (e[2] + w).alias("x2"), (e[3] + h).alias("y2"))


def height_model(samples: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """(keys, slope, intercept, n): body height as a line over the box's upper edge, where there is enough to learn from."""
    h = F.col("y2") - F.col("y1")
    g = samples.groupBy(*keys).agg(F.regr_slope(h, F.col("y1")).alias("slope"), F.regr_intercept(h, F.col("y1")).alias("intercept"), F.count("*").alias("n"))
    return g.where(F.col("n") >= least)


def frame_panel(detections: DataFrame, objects: DataFrame, conf: str = "conf") -> DataFrame:
    """(frame, people, estimated, mean_conf, held) of each frame with people or held objects; ``objects`` have a person_id where held."""
    people = detections.groupBy("frame").agg(
        F.count("*").alias("people"), F.count_if(F.coalesce(F.col("foot_src") != "box", F.lit(False))).alias("estimated"), F.round(F.avg(conf), 4).alias("mean_conf"))
    held = objects.where("person_id is not null").groupBy("frame").agg(F.count("*").alias("held"))
    return people.join(held, "frame", "full").select(
        "frame", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("people", "estimated")], "mean_conf", F.coalesce("held", F.lit(0)).alias("held"))


def attribute_late(samples: DataFrame, finals: DataFrame) -> DataFrame:
    """(person_id, label, n, first_t, last_t): objects sampled under live ids, told by the ids settled later.

    ``finals`` has old_id and new_id; a live id that was never changed stays. Samples without a holder are left out.
    """
    named = relabel(samples.where("person_id is not null"), finals, "person_id")
    return named.groupBy("person_id", "label").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def run_statistics(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """One row: detections, ids, most and mean per frame (empty frames count), lasting tracks, share estimated."""
    per = frames.join(detections.groupBy("frame").agg(F.count("*").alias("k")), "frame", "left")
    f = per.agg(F.max(F.coalesce("k", F.lit(0))).alias("most"), F.round(F.avg(F.coalesce("k", F.lit(0))), 2).alias("mean"))
    t = detections.groupBy("track_id").agg(F.count("*").alias("k")).agg(F.count("*").alias("ids"), F.count_if(F.col("k") >= 3).alias("stable"))
    d = detections.agg(F.count("*").alias("detections"), F.round(F.avg((F.col("foot_src") != "box").cast("int")) * 100, 1).alias("pct_estimated"))
    return d.crossJoin(t).crossJoin(f)  # one row each
