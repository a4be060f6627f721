import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import sequence as Q


def trail(spark, rows):
    return spark.createDataFrame(rows, "vid int, t double, x double, y double")


def test_runs_break_only_beyond_the_gap(spark):
    t = trail(spark, [(1, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (1, 4.1, 0.0, 0.0), (2, 7.0, 0.0, 0.0)])
    got = sorted((r.vid, r.t_start, r.t_end, r.n) for r in Q.runs(t, ["vid"], "t", ["t"], 2.0).collect())
    assert got == [(1, 0.0, 2.0, 2), (1, 4.1, 4.1, 1), (2, 7.0, 7.0, 1)]


def test_runs_of_an_empty_table(spark):
    assert Q.runs(trail(spark, []), ["vid"], "t", ["t"], 2.0).count() == 0


def test_weights_are_capped_and_zero_for_a_single_sample(spark):
    t = trail(spark, [(1, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (1, 9.0, 0.0, 0.0), (2, 3.0, 0.0, 0.0)])
    got = {(r.vid, r.t): r.w for r in Q.weights(t, ["vid"], "t", ["t"], 2.0).collect()}
    assert got == {(1, 0.0): 0.5, (1, 1.0): 1.5, (1, 9.0): 1.0, (2, 3.0): 0.0}


def test_weights_never_add_up_to_more_than_the_span(spark):
    rows = [(k % 7, (k * 37 % 101) / 3.0, 0.0, 0.0) for k in range(400)]
    w = Q.weights(trail(spark, rows), ["vid"], "t", ["t"], 1.5).groupBy("vid").agg(F.sum("w").alias("w"), (F.max("t") - F.min("t")).alias("span"))
    assert all(r.w <= r.span + 1e-9 for r in w.collect())


def test_segments_only_see_flagged_rows(spark):
    t = trail(spark, [(1, float(k), float(k % 4 > 0), 0.0) for k in range(8)])
    w = Q.weights(t, ["vid"], "t", ["t"], 2.0)
    got = Q.segments(w, ["vid"], "t", ["t"], F.col("x") > 0, 1.0).orderBy("t_start").collect()
    assert [(r.t_start, r.t_end, r.n, r.seconds) for r in got] == [(1.0, 3.0, 3, 3.0), (5.0, 7.0, 3, 2.5)]


def test_thinning_keeps_first_stepwise_and_last(spark):
    t = trail(spark, [(1, k / 10.0, 0.0, 0.0) for k in range(25)])
    got = [r.t for r in Q.thin(t, ["vid"], "t", ["x", "y"], 1.0).orderBy("t").collect()]
    assert got == [0.0, 1.0, 2.0, 2.4]


def test_rolling_median_shrinks_at_the_ends(spark):
    t = trail(spark, [(1, float(k), v, 0.0) for k, v in enumerate([5.0, 1.0, 9.0, 2.0])])
    got = [r.med for r in Q.rolling_median(t, ["vid"], ["t"], "x", 1).orderBy("t").collect()]
    assert got == [5.0, 5.0, 2.0, 9.0]


def test_dead_band_against_a_plain_fold(spark):
    rows = [(1, float(k), 10 * math.sin(k), 7 * math.cos(2 * k), ) for k in range(30)]
    t = trail(spark, rows).withColumn("band", F.lit(4.0))
    got = [(r.sx, r.sy) for r in Q.dead_band(t, ["vid"], "t", "x", "y", "band").orderBy("t").collect()]
    x, y, want = rows[0][2], rows[0][3], []
    for _, _, a, b in rows:
        d = math.hypot(a - x, b - y)
        if d > 4:
            x, y = x + (a - x) * (d - 4) / d, y + (b - y) * (d - 4) / d
        want.append((x, y))
    assert all(math.isclose(p, q, abs_tol=1e-9) for g, w in zip(got, want) for p, q in zip(g, w))


def test_resampling_hits_samples_once(spark):
    t = trail(spark, [(1, 0.0, 0.0, 0.0), (1, 1.0, 10.0, 0.0), (1, 2.5, 25.0, 0.0)])
    got = [(r.i, r.x) for r in Q.resample(t, ["vid"], "t", ["x"], 0.5).orderBy("i").collect()]
    assert got == [(k, 5.0 * k) for k in range(6)]


def test_occupancy_counts_both_ends_and_empty_steps(spark):
    spans = spark.createDataFrame([(0.0, 1.0), (0.6, 0.9), (3.0, 3.0)], "a double, b double")
    assert [r.n for r in Q.occupancy(spans, "a", "b", 0.0, 4.0, 0.5).orderBy("i").collect()] == [1, 2, 2, 0, 0, 0, 1, 0, 0]


def test_tail_velocity_needs_two_instants(spark):
    t = trail(spark, [(1, 0.0, 0.0, 0.0), (1, 5.0, 1.0, 1.0), (1, 6.0, 3.0, 1.0), (2, 1.0, 4.0, 4.0)])
    got = {r.vid: (r.vx, r.vy) for r in Q.tail_velocity(t, ["vid"], "t", "x", "y", 1.5).collect()}
    assert got == {1: (2.0, 0.0), 2: (0.0, 0.0)}


def test_evidence_of_pairs_against_a_join_of_steps(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(v % 2, v, int(k), None if rng.uniform() < 0.1 else round(float(rng.uniform(0, 60)), 3)) for v in range(30) for k in range(int(rng.integers(0, 8)), int(rng.integers(8, 14)))]
    rows += [(0, 98, 500, 1.0), (0, 99, 500, None), (1, 97, 900, 2.0)]
    df = spark.createDataFrame(rows, "lane int, vid long, i long, x double").localCheckpoint()
    side = lambda s: df.select("lane", "i", F.col("vid").alias(s), F.col("x").alias(f"{s}_x"))
    d = F.abs(F.col("a_x") - F.col("b_x"))
    want = side("a").join(side("b"), ["lane", "i"]).where("a < b").groupBy("a", "b").agg(
        F.count("*").alias("steps"), F.round(F.percentile(d, 0.5), 4).alias("d"), F.round(F.avg((d <= 30).cast("int")), 6).alias("close")).localCheckpoint()
    for block, steps in ((1000, 500_000), (4, 40)):  # one block a lane, or several in small pieces
        monkeypatch.setattr(Q, "SERIES_A_BLOCK", block)
        monkeypatch.setattr(Q, "STEPS_AT_ONCE", steps)
        got = Q.pair_evidence(df, "lane", "vid", "i", "x", 30.0).localCheckpoint()
        assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 200


def test_rounding_half_up():
    assert Q.half_up(np.array([0.00005, 2.34565, 1.000049999, 7.5, 0.1]), 4).tolist() == [0.0001, 2.3457, 1.0, 7.5, 0.1]
