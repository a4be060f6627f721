from itertools import permutations

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import matching as M
from tidemark.operators.tracking import Tracker, TrackerParams, track


def cheapest(cost, limit):
    n, m = cost.shape
    best = None
    for k in range(min(n, m) + 1):
        for rows in permutations(range(n), k):
            for cols in permutations(range(m), k):
                if all(cost[r, c] <= limit for r, c in zip(rows, cols)):
                    total = sum(cost[r, c] for r, c in zip(rows, cols)) + limit / 2 * (n + m - 2 * k)
                    best = total if best is None else min(best, total)
    return best


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3), st.integers(1, 4), st.integers(0, 10**6))
def test_assignment_is_cheapest(n, m, seed):
    cost = np.random.default_rng(seed).uniform(0, 1, (n, m)).round(2)
    pairs, rows, cols = M.assign(cost, 0.7)
    assert len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
    assert sorted([a for a, _ in pairs] + rows) == list(range(n)) and sorted([b for _, b in pairs] + cols) == list(range(m))
    total = sum(cost[a, b] for a, b in pairs) + 0.35 * (len(rows) + len(cols))
    assert abs(total - cheapest(cost, 0.7)) < 1e-9


def test_assignment_of_nothing():
    assert M.assign(np.zeros((0, 3)), 1.0) == ([], [], [0, 1, 2])


def test_greedy_and_chains():
    links = M.greedy_pairs([(0.5, 1, 2), (0.1, 1, 3), (0.3, 3, 2), (0.3, 4, 2)])
    assert links == [(1, 3), (3, 2)]
    assert M.chain_heads(links, [1, 2, 3, 4]) == {1: 1, 2: 1, 3: 1, 4: 4}


def test_groups_refuse_two_spans_of_one_camera():
    g = M.SpanGroups({1: (0, 0.0, 10.0), 2: (1, 0.0, 10.0), 3: (0, 5.0, 15.0), 4: (0, 10.2, 12.0)})
    assert g.join(1, 2) and not g.join(2, 3) and g.join(2, 4) and g.root(4) == g.root(1) and not g.join(1, 4)


def test_groups_ask_for_the_walk():
    tracks = {1: (0, 0.0, 1.0), 2: (1, 2.0, 3.0)}
    assert not M.SpanGroups(tracks).join(1, 2, lambda last, first: False) and M.SpanGroups(tracks).join(1, 2, lambda last, first: (last, first) == (1, 2))


def test_suppression_against_a_plain_loop():
    rng = np.random.default_rng(5)
    xy = rng.uniform(0, 50, (60, 2))
    boxes, scores, cls = np.c_[xy, xy + rng.uniform(5, 30, (60, 2))], rng.uniform(0, 1, 60), rng.integers(0, 3, 60)

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(h, 0)
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    kept = []
    for k in np.argsort(-scores):
        if all(cls[k] != cls[j] or iou(boxes[k], boxes[j]) <= 0.4 for j in kept):
            kept.append(int(k))
    assert M.suppress(boxes, scores, 0.4, cls).tolist() == kept


def test_tracker_keeps_ids_through_a_short_gap():
    t, ids = Tracker(), []
    for f in range(12):
        a, b = [10 + 5 * f, 10, 50 + 5 * f, 110], [400 - 5 * f, 20, 440 - 5 * f, 120]
        boxes = np.array([b] if 5 <= f < 8 else [a, b], float)
        ids.append({tuple(np.round(x[1][:1], -2)): x[0] for x in t.step(boxes, np.full(len(boxes), 0.9))})
    assert len(ids[0]) == 2 and t.last_id == 2 and len(ids[-1]) == 2


def test_a_track_born_later_is_told_at_its_second_frame():
    t = Tracker(TrackerParams())
    box = np.array([[0, 0, 40, 100]], float)
    assert t.step(np.zeros((0, 4)), np.zeros(0)) == [] and t.step(box, np.array([0.9])) == []
    assert [x[0] for x in t.step(box, np.array([0.9]))] == [1]


def test_tracks_by_video(spark):
    rows = [(v, f, k, 10.0 + f, 10.0 + 200 * k, 50.0 + f, 110.0 + 200 * k, 0.9) for v in ("a", "b") for f in range(4) for k in range(2)]
    got = track(spark.createDataFrame(rows, "video string, frame long, id long, x1 double, y1 double, x2 double, y2 double, score double")).toPandas()
    assert isinstance(got, pd.DataFrame) and len(got) == 16 and set(got.groupby("video").track_id.nunique()) == {2}
