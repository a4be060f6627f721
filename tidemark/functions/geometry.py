"""Planar geometry as Column expressions: everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int


def _c(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def at(h: Column, r: int, c: int) -> Column:
    """Cell of a matrix kept as array<array<double>>."""
    return h[r][c]


def apply_homography(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Plan coordinates of an image point under a 3x3 matrix; null where the point lies at infinity."""
    w = F.nullif(at(h, 2, 0) * x + at(h, 2, 1) * y + at(h, 2, 2), F.lit(0.0))
    return (at(h, 0, 0) * x + at(h, 0, 1) * y + at(h, 0, 2)) / w, (at(h, 1, 0) * x + at(h, 1, 1) * y + at(h, 1, 2)) / w


def invert3(h: Column) -> Column:
    """Inverse of a 3x3 matrix by cofactors; null when it is singular."""
    m = lambda r, c: at(h, r, c)
    minor = lambda r, c: (
        m((r + 1) % 3, (c + 1) % 3) * m((r + 2) % 3, (c + 2) % 3) - m((r + 1) % 3, (c + 2) % 3) * m((r + 2) % 3, (c + 1) % 3)
    )
    det = m(0, 0) * minor(0, 0) + m(0, 1) * minor(0, 1) + m(0, 2) * minor(0, 2)
    rows = [F.array(*[minor(c, r) / F.nullif(det, F.lit(0.0)) for c in range(3)]) for r in range(3)]
    return F.when(F.abs(det) > 1e-12, F.array(*rows))


def _crosses(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    slope = (bx - ax) / F.nullif(by - ay, F.lit(0.0))
    return F.coalesce(((ay > y) != (by > y)) & (x < slope * (y - ay) + ax), F.lit(False))


def in_polygon(x: Column, y: Column, pts: Sequence[Sequence[float]]) -> Column:
    """Ray casting against a polygon known at plan time: one flat expression, half-open edges."""
    inside = F.lit(False)
    for (ax, ay), (bx, by) in zip(pts, [*pts[1:], pts[0]]):
        if ay == by:
            continue
        inside = inside != _crosses(x, y, _c(ax), _c(ay), _c(bx), _c(by))
    return inside


def in_polygon_column(x: Column, y: Column, pts: Column) -> Column:
    """The same against a polygon in a column, array<array<double>>."""
    n = F.size(pts)

    def edge(inside: Column, k: Column) -> Column:
        a, b = F.get(pts, k), F.get(pts, (k + 1) % n)
        return inside != _crosses(x, y, a[0], a[1], b[0], b[1])

    return F.when(n >= 3, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), edge)).otherwise(F.lit(False))


def on_edge(x: Column, y: Column, pts: Sequence[Sequence[float]], tol: float = 1e-9) -> Column:
    """Whether the point lies on the polygon's border."""
    hit = F.lit(False)
    for (ax, ay), (bx, by) in zip(pts, [*pts[1:], pts[0]]):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        inside = x.between(min(ax, bx) - tol, max(ax, bx) + tol) & y.between(min(ay, by) - tol, max(ay, by) + tol)
        hit = hit | (F.abs(cross) <= tol) & inside
    return hit


def in_or_on(x: Column, y: Column, pts: Sequence[Sequence[float]]) -> Column:
    """Point in polygon, border included."""
    return in_polygon(x, y, pts) | on_edge(x, y, pts)


def bounding_box(pts: Column) -> Column:
    """struct<x1, y1, x2, y2> of array<array<double>>."""
    xs, ys = F.transform(pts, lambda p: p[0]), F.transform(pts, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def overlap_area(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Area shared by two boxes (x1, y1, x2, y2)."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def area(a: Sequence[Column]) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of two boxes; 0 where the union is empty."""
    both = overlap_area(a, b)
    return F.coalesce(both / F.nullif(area(a) + area(b) - both, F.lit(0.0)), F.lit(0.0))


def overlap_fraction(part: Sequence[Column], whole: Sequence[Column]) -> Column:
    """Share of ``part`` that lies in ``whole``."""
    return F.coalesce(overlap_area(part, whole) / F.nullif(area(part), F.lit(0.0)), F.lit(0.0))


def fused_distance(distance: Column, score: Column) -> Column:
    """IoU distance weighed by the detection's score."""
    return 1 - (1 - distance) * score


def distance(x1: Column, y1: Column, x2: Num, y2: Num) -> Column:
    return F.hypot(x1 - _c(x2), y1 - _c(y2))


def manhattan(x1: Column, y1: Column, x2: Num, y2: Num) -> Column:
    return F.abs(x1 - _c(x2)) + F.abs(y1 - _c(y2))


def tlwh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    return x, y, x + w, y + h


def xyxy_to_xyah(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, ...]:
    """Centre, aspect ratio and height, the tracker's measurement."""
    return (x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0)), y2 - y1


def parse_keypoints(text: Column) -> Column:
    """``x:y:c;x:y:c…`` as array<struct<x, y, c>>; empty text gives an empty array."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda s: s != "")

    def one(s: Column) -> Column:
        f = F.split(s, ":")
        return F.struct(*[F.get(f, F.lit(k)).try_cast("double").alias(n) for k, n in enumerate("xyc")])

    return F.transform(parts, one)


def format_keypoints(kps: Column) -> Column:
    return F.array_join(F.transform(kps, lambda k: F.format_string("%.1f:%.1f:%.2f", k["x"], k["y"], k["c"])), ";")


def visible(kps: Column, k: int, least: float = 0.3) -> Column:
    return F.coalesce(F.get(kps, F.lit(k))["c"] >= least, F.lit(False))


def midpoint(kps: Column, a: int, b: int, least: float = 0.3) -> Column:
    """Mean of the visible ones of two keypoints, struct<x, y>; null when neither is visible."""
    seen = F.filter(F.array(F.get(kps, F.lit(a)), F.get(kps, F.lit(b))), lambda k: F.coalesce(k["c"] >= least, F.lit(False)))
    total = lambda f: F.aggregate(seen, F.lit(0.0), lambda s, k: s + k[f]) / F.size(seen)
    return F.when(F.size(seen) > 0, F.struct(total("x").alias("x"), total("y").alias("y")))


# Keypoint numbers, and body proportions as shares of the height.
SHOULDERS, WRISTS, HIPS, KNEES, ANKLES, FACE = (5, 6), (9, 10), (11, 12), (13, 14), (15, 16), range(5)
KNEE_TO_FOOT, HIP_TO_KNEE, SHOULDER_TO_HIP = 0.249, 0.229, 0.311


def foot(x1: Column, y1: Column, x2: Column, y2: Column, kps: Column) -> Column:
    """Where a person stands: struct<x, y, src> by the visible joints, src in box, knees, torso, position.

    With an ankle, or without keypoints, it is the middle of the box's lower edge. Else the legs
    are carried on from the knees, or the body from the shoulders, but never above that edge.
    """
    knees, hips, shoulders = (midpoint(kps, *p) for p in (KNEES, HIPS, SHOULDERS))
    plain = F.coalesce(F.size(kps), F.lit(0)) < 1
    ankle = visible(kps, ANKLES[0]) | visible(kps, ANKLES[1])
    fx = F.coalesce(hips["x"], (x1 + x2) / 2)
    by_knees = knees["y"] + (knees["y"] - hips["y"]) * (KNEE_TO_FOOT / HIP_TO_KNEE)
    by_torso = y1 + (hips["y"] - shoulders["y"]) / SHOULDER_TO_HIP
    place = lambda x, y, s: F.struct(x.alias("x"), y.alias("y"), F.lit(s).alias("src"))
    return (
        F.when(plain | ankle, place((x1 + x2) / 2, y2, "box"))
        .when(knees.isNotNull() & hips.isNotNull(), place(fx, F.greatest(by_knees, y2), "knees"))
        .when(shoulders.isNotNull() & hips.isNotNull(), place(fx, F.greatest(by_torso, y2), "torso"))
        .otherwise(place(fx, y2, "position"))
    )


def full_body(kps: Column) -> Column:
    """Both ankles, a shoulder and a hip are visible: fit to learn heights from."""
    either = lambda p: visible(kps, p[0]) | visible(kps, p[1])
    return visible(kps, ANKLES[0]) & visible(kps, ANKLES[1]) & either(SHOULDERS) & either(HIPS)


def position_foot(y1: Column, y2: Column, slope: Column, intercept: Column, frame_height: Num) -> Column:
    """Foot of a person whose legs are hidden, from the height learned for boxes that begin at y1."""
    return F.least(F.greatest(y1 + slope * y1 + intercept, y2), _c(frame_height))


def head(x1: Column, y1: Column, x2: Column, kps: Column, least: float = 0.3) -> Column:
    """struct<x, y>: mean x of visible face keypoints, else the box's centre; its upper edge."""
    face = F.filter(F.slice(kps, 1, 5), lambda k: k["c"] >= least)
    mean = F.aggregate(face, F.lit(0.0), lambda s, k: s + k["x"]) / F.nullif(F.size(face), F.lit(0))
    return F.struct(F.coalesce(mean, (x1 + x2) / 2).alias("x"), y1.alias("y"))


def region(x1: Column, y1: Column, x2: Column, y2: Column, kps: Column, part: str) -> Column:
    """Rectangle of the torso or legs: between the joints' midpoints, else a fixed share of the box."""
    top, bottom = (midpoint(kps, *SHOULDERS), midpoint(kps, *HIPS)) if part == "torso" else (midpoint(kps, *HIPS), midpoint(kps, *KNEES))
    lo, hi = (0.2, 0.5) if part == "torso" else (0.5, 0.85)
    known, inset = top.isNotNull() & bottom.isNotNull(), (x2 - x1) * 0.2
    return F.struct(
        (x1 + inset).alias("x1"), F.when(known, top["y"]).otherwise(y1 + (y2 - y1) * lo).alias("y1"),
        (x2 - inset).alias("x2"), F.when(known, bottom["y"]).otherwise(y1 + (y2 - y1) * hi).alias("y2"),
    )


def allowed_walk(height: Column, gap: Column, base: float = 0.6, per_s: float = 0.8, cap: float = 3.5) -> Column:
    """Distance a person of a pixel height may have walked in a gap."""
    return height * F.least(base + per_s * gap, F.lit(cap))


def handoff_reach(max_dist: Column, gap: Column, per_s: float = 0.7, cap: float = 3.0) -> Column:
    return max_dist * F.least(1 + per_s * gap, F.lit(cap))


def arrival_curve(minute: Column, peak: float, day_start: float = 0.0) -> Column:
    """Chance of an arrival: a floor and two humps at 13:00 and 16:30."""
    hour = day_start + minute / 60.0
    hump = lambda m, s: F.exp(-0.5 * F.pow((hour - m) / s, F.lit(2.0)))
    return peak * (0.15 + 0.85 * F.greatest(hump(13.0, 1.5), hump(16.5, 1.2)))


def abandon_probability(p: Column, position: Column) -> Column:
    return F.least(p * (1 + 0.4 * (position - 1)), F.lit(0.6))


def scale_range(value: Column, factor: Num) -> Column:
    return F.greatest(F.lit(1), (value * _c(factor)).cast("int"))
