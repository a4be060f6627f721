"""Multi-object tracking by detection: Kalman prediction and two rounds of box matching a frame.

A tracker is a state machine over the frames of one video, so it runs as one grouped Arrow function
a video; ``Tracker`` itself is plain numpy and also serves the streaming processor.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.matching import assign


@dataclass(frozen=True)
class TrackerParams:
    high: float = 0.35
    low: float = 0.1
    new: float = 0.45
    buffer: int = 30
    match: float = 0.8
    second: float = 0.5
    unconfirmed: float = 0.7
    duplicate: float = 0.15

    @staticmethod
    def for_rate(conf: float, fps: float, stride: int = 1, buffer_s: float = 4.0) -> TrackerParams:
        """Settings for a detector's confidence and the analysed frame rate."""
        return TrackerParams(new=max(conf, 0.45), buffer=max(5, int(round(buffer_s * fps / stride))))


# Noise of the motion model, as shares of the box's height.
_POS, _VEL = 1 / 20, 1 / 160


@dataclass
class _Track:
    mean: np.ndarray
    cov: np.ndarray
    score: float
    det: int
    start: int
    frame: int
    id: int = 0
    confirmed: bool = False
    lost: bool = False

    def box(self) -> np.ndarray:
        x, y, a, h = self.mean[:4]
        return np.array([x - a * h / 2, y - h / 2, x + a * h / 2, y + h / 2])


def _measure(box: np.ndarray) -> np.ndarray:
    w, h = box[2] - box[0], max(box[3] - box[1], 1e-6)
    return np.array([box[0] + w / 2, box[1] + h / 2, w / h, h])


_MOVE = np.eye(8) + np.eye(8, k=4)


def _begin(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = z[3]
    std = np.array([2 * _POS * h, 2 * _POS * h, 1e-2, 2 * _POS * h, 10 * _VEL * h, 10 * _VEL * h, 1e-5, 10 * _VEL * h])
    return np.concatenate((z, np.zeros(4))), np.diag(std**2)


def _predict(t: _Track) -> None:
    if t.lost:
        t.mean[7] = 0.0  # a person out of sight does not grow
    h = t.mean[3]
    std = np.array([_POS * h, _POS * h, 1e-2, _POS * h, _VEL * h, _VEL * h, 1e-5, _VEL * h])
    t.mean, t.cov = _MOVE @ t.mean, _MOVE @ t.cov @ _MOVE.T + np.diag(std**2)


def _update(t: _Track, z: np.ndarray) -> None:
    h = t.mean[3]
    seen = t.cov[:4, :4] + np.diag(np.array([_POS * h, _POS * h, 1e-1, _POS * h]) ** 2)
    gain = np.linalg.solve(seen, t.cov[:4]).T
    t.mean = t.mean + gain @ (z - t.mean[:4])
    t.cov = t.cov - gain @ seen @ gain.T


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.reshape(-1, 1, 4), b.reshape(1, -1, 4)
    side = np.maximum(np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]), 0)
    both = side.prod(-1)
    area = lambda x: np.maximum(x[..., 2:] - x[..., :2], 0).prod(-1)
    return both / np.maximum(area(a) + area(b) - both, 1e-12)


@dataclass
class Tracker:
    """Feed frames in order; each call gives (id, box, det_index, score) of the confirmed tracks seen."""

    params: TrackerParams = field(default_factory=TrackerParams)
    frame: int = 0
    last_id: int = 0
    tracks: list[_Track] = field(default_factory=list)

    def _distance(self, tracks: list[_Track], boxes: np.ndarray, scores: np.ndarray | None) -> np.ndarray:
        if not tracks or not len(boxes):
            return np.zeros((len(tracks), len(boxes)))
        near = iou_matrix(np.array([t.box() for t in tracks]), boxes)
        return 1 - near * scores if scores is not None else 1 - near

    def _match(self, tracks: list[_Track], dets: list[int], boxes: np.ndarray, scores: np.ndarray, limit: float, fused: bool) -> tuple[list[_Track], list[int]]:
        """Assign, update the matched tracks, and give what is left of both."""
        idx = np.array(dets, int)
        pairs, rest, free = assign(self._distance(tracks, boxes[idx], scores[idx] if fused else None), limit)
        for r, c in pairs:
            t, d = tracks[r], dets[c]
            _update(t, _measure(boxes[d]))
            t.score, t.det, t.frame, t.lost, t.confirmed = float(scores[d]), d, self.frame, False, True
        return [tracks[r] for r in rest], [dets[c] for c in free]

    def step(self, boxes: np.ndarray, scores: np.ndarray) -> list[tuple[int, np.ndarray, int, float]]:
        p = self.params
        self.frame += 1
        high = [k for k, s in enumerate(scores) if s >= p.high]
        low = [k for k, s in enumerate(scores) if p.low <= s < p.high]
        pool = [t for t in self.tracks if t.confirmed]
        fresh = [t for t in self.tracks if not t.confirmed]
        for t in pool:
            _predict(t)
        rest, free = self._match(pool, high, boxes, scores, p.match, True)
        rest, _ = self._match([t for t in rest if not t.lost], low, boxes, scores, p.second, False)
        for t in rest:
            t.lost = True
        gone, free = self._match(fresh, free, boxes, scores, p.unconfirmed, True)
        for d in free:
            if scores[d] >= p.new:
                self.last_id += 1
                mean, cov = _begin(_measure(boxes[d]))
                self.tracks.append(_Track(mean, cov, float(scores[d]), d, self.frame, self.frame, self.last_id, confirmed=self.frame == 1))
        old = {id(t) for t in gone} | {id(t) for t in self.tracks if t.lost and self.frame - t.frame > p.buffer}
        self.tracks = self._distinct([t for t in self.tracks if id(t) not in old])
        return [(t.id, t.box(), t.det, t.score) for t in self.tracks if t.confirmed and not t.lost and t.frame == self.frame]

    def _distinct(self, tracks: list[_Track]) -> list[_Track]:
        """Of a tracked and a lost track on one place the one that has lived longer stays; ties keep the lost one."""
        here, lost = [t for t in tracks if not t.lost], [t for t in tracks if t.lost]
        if not here or not lost:
            return tracks
        close = 1 - iou_matrix(np.array([t.box() for t in here]), np.array([t.box() for t in lost])) < self.params.duplicate
        drop = set()
        for i, j in zip(*np.nonzero(close)):
            a, b = here[i], lost[j]
            drop.add(id(b) if a.frame - a.start > b.frame - b.start else id(a))
        return [t for t in tracks if id(t) not in drop]


_OUT = "frame long, track_id long, det_index int, x1 double, y1 double, x2 double, y2 double, score double"


def track(detections: DataFrame, video: str = "video", params: TrackerParams | None = None) -> DataFrame:
    """Tracks of detections (video, frame, id, x1, y1, x2, y2, score): smoothed boxes with ids a video.

    Frames without detections inside a video still age its tracks. ``det_index`` is the row's place
    in its frame by id.
    """
    p = params or TrackerParams()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "id"], kind="stable")
        frames, tracker, rows = dict(tuple(pdf.groupby("frame", sort=True))), Tracker(p), []
        for f in range(int(pdf["frame"].min()), int(pdf["frame"].max()) + 1):
            own = frames.get(f)
            boxes = own[["x1", "y1", "x2", "y2"]].to_numpy(float) if own is not None else np.zeros((0, 4))
            scores = own["score"].to_numpy(float) if own is not None else np.zeros(0)
            rows += [(pdf[video].iloc[0], f, t, d, *map(float, b), s) for t, b, d, s in tracker.step(boxes, scores)]
        return pd.DataFrame(rows, columns=[video, "frame", "track_id", "det_index", "x1", "y1", "x2", "y2", "score"])

    kind = detections.schema[video].dataType.simpleString()
    return detections.groupBy(video).applyInPandas(run, f"{video} {kind}, {_OUT}")
