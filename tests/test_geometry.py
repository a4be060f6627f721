import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions import text as T
from tidemark.functions import vectors as X
from tidemark.operators.calibration import _through, fit_cameras, fit_homography
from tidemark.operators.objects import clip_area, covered_share

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
CONCAVE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 4.0), (0.0, 10.0)]


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).collect()[0]


def test_polygon_edges_are_half_open(spark):
    inside = lambda x, y, p=SQUARE: G.in_polygon(F.lit(x), F.lit(y), p)
    assert tuple(one(spark, inside(0.0, 5.0), inside(10.0, 5.0), inside(5.0, 5.0), inside(5.0, 8.0, CONCAVE), inside(5.0, 3.0, CONCAVE))) == (True, False, True, False, True)


def test_polygon_column_agrees_with_literal(spark):
    pts = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in CONCAVE])
    grid = spark.range(400).select((F.col("id") % 20 * 0.61 - 1).alias("x"), (F.floor(F.col("id") / 20) * 0.59 - 1).cast("double").alias("y"))
    assert grid.where(G.in_polygon(F.col("x"), F.col("y"), CONCAVE) != G.in_polygon_column(F.col("x"), F.col("y"), pts)).count() == 0


def test_border_inclusive_variant(spark):
    on = lambda x, y: G.in_or_on(F.lit(x), F.lit(y), SQUARE)
    assert tuple(one(spark, on(10.0, 5.0), on(10.0, 10.0), on(10.1, 5.0))) == (True, True, False)


def test_iou_and_fraction_of_empty_boxes(spark):
    box = lambda *v: [F.lit(float(x)) for x in v]
    got = one(spark, G.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)), G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), G.overlap_fraction(box(0, 0, 2, 2), box(1, 0, 9, 9)))
    assert [round(x, 6) for x in got] == [round(1 / 7, 6), 0.0, 0.5]


def test_singular_matrix_has_no_inverse(spark):
    m = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in ((1, 2, 3), (2, 4, 6), (0, 0, 1))])
    assert one(spark, G.invert3(m))[0] is None


def test_keypoints_there_and_back(spark):
    got = one(spark, G.format_keypoints(G.parse_keypoints(F.lit("1.5:2.0:0.90;3.0:4.0:0.10"))), F.size(G.parse_keypoints(F.lit(""))), G.midpoint(G.parse_keypoints(F.lit("1:2:0.9;3:4:0.1")), 0, 1))
    assert got[0] == "1.5:2.0:0.90;3.0:4.0:0.10" and got[1] == 0 and tuple(got[2]) == (1.0, 2.0)


def test_homography_is_found_again():
    rng = np.random.default_rng(3)
    h = np.array([[1.1, 0.2, 30.0], [-0.1, 0.9, 5.0], [0.0003, -0.0002, 1.0]])
    img = rng.uniform(0, 1000, (12, 2))
    assert np.allclose(fit_homography(img, _through(h, img)), h, atol=1e-6)
    noisy = _through(h, img) + rng.normal(0, 3, (12, 2))
    fitted = fit_homography(img, noisy)
    best = np.square(_through(fitted, img) - noisy).sum()
    for _ in range(50):  # no matrix nearby does better
        other = fitted * (1 + rng.normal(0, 1e-4, (3, 3)))
        assert np.square(_through(other, img) - noisy).sum() >= best - 1e-6


def test_too_few_pairs_are_a_problem_row(spark):
    p = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 0.0)] * 3, "camera string, ix double, iy double, px double, py double")
    r = fit_cameras(p).collect()[0]
    assert r.h is None and "four" in r.problem


def test_clipped_areas(spark):
    assert clip_area(np.array(SQUARE), (5, 5, 20, 20)) == 25 and clip_area(np.array(SQUARE), (20, 20, 30, 30)) == 0
    got = spark.createDataFrame([(5.0, 0.0, 15.0, 10.0), (1.0, 1.0, 1.0, 1.0)], "x1 double, y1 double, x2 double, y2 double").select(covered_share(SQUARE)("x1", "y1", "x2", "y2").alias("s"))
    assert [r.s for r in got.collect()] == [0.5, 0.0]


def test_vectors(spark):
    a, b = F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.25), F.lit(0.75))
    none = F.lit(None).cast("array<double>")
    got = one(spark, X.intersection(a, b), X.similarity(a, b, none, b), X.similarity(none, b, a, b), X.norm(X.unit(b)))
    assert [round(x, 9) for x in got] == [0.75, 0.75, 0.0, 1.0]


def test_text(spark):
    got = one(spark, T.clock(F.lit(1505)), T.minutes(F.lit("25:05")), T.minutes(F.lit("x")), T.duration(F.lit(61.4)), T.safe_name(F.lit("a b/c")), T.weekday(F.lit("Sunday")), T.weekday(F.lit("?")))
    assert tuple(got) == ("25:05", 1505, None, "1m 01s", "a_b_c", 6, 99)
    assert one(spark, T.name_list(F.lit(" a, ,b "), ["x"]), T.name_list(F.lit(None).cast("string"), ["x"]))[:] == (["a", "b"], ["x"])
