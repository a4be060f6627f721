"""Rows of detected boxes: their rounded form, and the filters every detection job applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Everyday names of object classes.
ALIASES = {"phone": "cell phone", "mobile phone": "cell phone", "smartphone": "cell phone", "bag": "handbag", "purse": "handbag", "trolley": "suitcase"}


def box_rows(boxes: DataFrame, score: str = "score", t: str | None = None) -> DataFrame:
    """``boxes`` (x1, y1, x2, y2, score) with cx, cy, w, h; places to 1 digit, scores and times to 3."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    made = {"cx": F.col("x1") + w / 2, "cy": F.col("y1") + h / 2, "w": w, "h": h} | {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    fine = {c: F.round(F.col(c), 3) for c in (score, t) if c}
    return boxes.withColumns({c: F.round(v, 1) for c, v in made.items()} | fine)


def wanted_classes(names: list[str], known: list[str]) -> tuple[list[str], list[str]]:
    """(classes to keep, names that no class has), after aliases and case."""
    named = {ALIASES.get(x.lower(), x.lower()) for x in names}
    return sorted(named & set(known)), sorted(named - set(known))


def of_classes(boxes: DataFrame, names: list[str], known: list[str], least: float, label: str = "label", score: str = "score") -> DataFrame:
    """Boxes of the wanted classes whose score is ``least`` or more."""
    return boxes.where(F.col(label).isin(wanted_classes(names, known)[0]) & (F.col(score) >= least))


def auto_stride(fps: Column) -> Column:
    """Every how many frames to look, for about six a second."""
    return F.greatest(F.lit(1), F.rint(fps / 6).cast("int"))


def every(frames: DataFrame, stride: Column | int, start: Column | int = 0, frame: str = "frame") -> DataFrame:
    """Frames from ``start`` on, every ``stride``-th."""
    after = F.col(frame) - F.lit(start)
    return frames.where((after >= 0) & (after % F.lit(stride) == 0))


def time_slice(frames: DataFrame, start_s: float, max_s: float | None, fps: float, frame: str = "frame") -> DataFrame:
    """Frames of ``max_s`` seconds (all if None) from ``start_s`` on, as frame numbers at ``fps``."""
    first = int(start_s * fps)
    rows = frames.where(F.col(frame) >= first)
    return rows if max_s is None else rows.where(F.col(frame) < first + int(max_s * fps))


def visible_objects(objects: DataFrame, people: DataFrame, least: float, loose: bool = True, score: str = "score") -> DataFrame:
    """Objects of ``least`` score whose holder (person_id, in the same frame) is among ``people``.

    Objects without a holder stay only where ``loose`` allows them.
    """
    sure = objects.where(F.col(score) >= least)
    held = sure.join(people.select("frame", F.col("id").alias("person_id")).distinct(), ["frame", "person_id"], "left_semi").select(*objects.columns)
    return held.unionByName(sure.where("person_id is null")) if loose else held


def frame_objects(frames: DataFrame, objects: DataFrame, t: str = "t") -> DataFrame:
    """Each frame with the objects of its instant; frames without one stay, with nulls."""
    return frames.join(objects, t, "left")


def trailing(samples: DataFrame, keys: list[str], t: str, seconds: float, *aggs: tuple[str, Column]) -> DataFrame:
    """``samples`` with aggregates (name, column) over each row's last ``seconds``, its own instant included."""
    w = Window.partitionBy(*keys).orderBy(t).rangeBetween(-seconds, 0)
    return samples.withColumns({name: c.over(w) for name, c in aggs})


def newest_first(jobs: DataFrame, started: str = "started_at", tie: str = "id") -> DataFrame:
    """Jobs in the order they are listed: latest start first, those not started last."""
    return jobs.orderBy(F.col(started).desc_nulls_last(), tie)
