"""Queries over points, boxes and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions import vectors as X
from tidemark.operators import objects as O
from tidemark.plans import views as V
from tidemark.plans.registry import query

H = ((1.2, 0.1, 5.0), (-0.05, 0.9, 12.0), (0.0004, 0.0002, 1.0))
_W = f"({H[2][0]} * x + {H[2][1]} * y + {H[2][2]})"


def _h() -> object:
    return F.array(*[F.array(*[F.lit(v) for v in r]) for r in H])


@query(f"""with {V.TRAIL} select event_id, round(({H[0][0]} * x + {H[0][1]} * y + {H[0][2]}) / {_W}, 6) as px, round(({H[1][0]} * x + {H[1][1]} * y + {H[1][2]}) / {_W}, 6) as py from trail""")
def homography_apply(spark: SparkSession, d: str) -> DataFrame:
    x, y = G.apply_homography(_h(), F.col("x"), F.col("y"))
    return V.trail(spark, d).select("event_id", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


@query(f"with {V.TRAIL} select event_id, round(x, 4) as x, round(y, 4) as y from trail")
def homography_inverse(spark: SparkSession, d: str) -> DataFrame:
    """There and back again gives the point."""
    t = V.trail(spark, d)
    px, py = G.apply_homography(_h(), F.col("x"), F.col("y"))
    there = t.withColumns({"px": px, "py": py, "inv": G.invert3(_h())})
    x, y = G.apply_homography(F.col("inv"), F.col("px"), F.col("py"))
    return there.select("event_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query(f"""with {V.TRAIL}, e as (select vid % 4 as camera, sqrt((({H[0][0]} * x + {H[0][1]} * y + {H[0][2]}) / {_W} - x) ** 2 + (({H[1][0]} * x + {H[1][1]} * y + {H[1][2]}) / {_W} - y) ** 2) as error from trail)
select camera, round(sqrt(avg(error ** 2)), 2) as rms, round(max(error), 2) as worst from e group by camera""")
def calib_rms(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.calibration import accuracy, errors

    t = V.trail(spark, d).select((F.col("vid") % 4).alias("camera"), F.col("x").alias("ix"), F.col("y").alias("iy"), F.col("x").alias("px"), F.col("y").alias("py"))
    fitted = spark.range(4).select(F.col("id").alias("camera"), _h().alias("h"))
    return accuracy(errors(t, fitted))


def _sides(spark: SparkSession, d: str) -> DataFrame:
    b = V.boxes(spark, d)
    side = lambda s: b.select("frame", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "x1", "y1", "x2", "y2", "score")])
    return side("a").join(side("b"), "frame").where("a_id < b_id")


_A, _B = ([f"{s}_{c}" for c in ("x1", "y1", "x2", "y2")] for s in "ab")
_INTER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_IOU = f"coalesce({_INTER} / nullif((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_INTER}, 0), 0)"


@query(f"with {V.BOXES} select a.id as a_id, b.id as b_id, round({_IOU}, 6) as iou, round(1 - {_IOU} * b.score, 6) as fused from boxes a join boxes b on a.frame = b.frame and a.id < b.id")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    near = G.iou([F.col(c) for c in _A], [F.col(c) for c in _B])
    return _sides(spark, d).select("a_id", "b_id", F.round(near, 6).alias("iou"), F.round(G.fused_distance(1 - near, F.col("b_score")), 6).alias("fused"))


@query(f"with {V.BOXES} select b.id from boxes b where not exists (select 1 from boxes a where a.frame = b.frame and a.id < b.id and 1 - {_IOU} < 0.15)")
def dedupe_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes without an older twin in their frame."""
    twins = _sides(spark, d).where(1 - G.iou([F.col(c) for c in _A], [F.col(c) for c in _B]) < 0.15).select(F.col("b_id").alias("id"))
    return V.boxes(spark, d).select("id").join(twins, "id", "left_anti")


_SHARE = f"({_INTER}) / nullif((a.x2 - a.x1) * (a.y2 - a.y1), 0)"
_HELD = f"""{V.BOXES}, objects as (select *, id as object_id from boxes where id % 3 = 0), people as (select *, id as person_id from boxes where id % 3 <> 0), pairs as (
  select a.object_id, b.person_id, round({_SHARE}, 1) as share, sqrt(((a.x1 + a.x2 - b.x1 - b.x2) / 2) ** 2 + ((a.y1 + a.y2 - b.y1 - b.y2) / 2) ** 2) as apart
  from objects a join people b on a.frame = b.frame where {_SHARE} >= 0.4
), best as (select *, row_number() over (partition by object_id order by share desc, apart, person_id) as k from pairs),
held as (select o.object_id, o.frame, 'L' || (o.label % 5) as label, person_id from objects o left join (select * from best where k = 1) using (object_id))"""


def _held(spark: SparkSession, d: str) -> DataFrame:
    b = V.boxes(spark, d)
    objects = b.where("id % 3 = 0").withColumnRenamed("id", "object_id").withColumn("label", F.concat(F.lit("L"), F.col("label") % 5))
    return O.holders(objects, b.where("id % 3 <> 0").withColumnRenamed("id", "person_id"), ["frame"])


@query(f"with {_HELD} select object_id, person_id from held")
def holder_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _held(spark, d).select("object_id", "person_id")


def _carried(spark: SparkSession, d: str) -> DataFrame:
    """Line items as held objects: the supplier holds, the ship flag and status label."""
    li = V.table(spark, d, "lineitem")
    holder = F.when(F.col("l_quantity") > 10, F.col("l_suppkey"))
    return li.select(F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 2).cast("string")).alias("label"), holder.alias("person_id"))


_CARRIED = "objects as (select l_returnflag || l_linestatus || (l_linenumber % 2) as label, case when l_quantity > 10 then l_suppkey end as person_id from lineitem)"


@query(f"with {_CARRIED} select person_id, label, count(*) as n from objects where person_id is not null group by all")
def held_items(spark: SparkSession, d: str) -> DataFrame:
    return O.held_items(_carried(spark, d))


@query(f"with {_CARRIED} select label, count(*) as n, count(person_id) as held from objects group by label")
def items_by_label(spark: SparkSession, d: str) -> DataFrame:
    return O.by_label(_carried(spark, d))


@query(f"with {_CARRIED} select person_id, count(*) as samples from objects where person_id is not null group by person_id having count(*) >= 3")
def carriers(spark: SparkSession, d: str) -> DataFrame:
    return O.carriers(_carried(spark, d))


@query(f"""with {_CARRIED}, n as (select person_id, label, count(*) as n from objects where person_id is not null group by all)
select person_id, label, n, cast(row_number() over (partition by person_id order by n desc, label) as integer) as rank from n qualify rank <= 2""")
def top2_labels(spark: SparkSession, d: str) -> DataFrame:
    return O.top_labels(O.held_items(_carried(spark, d)))


@query(f"""with {_CARRIED}, n as (select person_id, label, count(*) as n from objects where person_id is not null group by all)
select person_id, string_agg(label || '=' || n, ';' order by n desc, label) as items from n group by person_id""")
def item_tallies(spark: SparkSession, d: str) -> DataFrame:
    t = O.items_of(O.held_items(_carried(spark, d)))
    return t.select("person_id", F.array_join(F.transform(F.map_entries("items"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("items"))


@query(f"""with {_CARRIED}, mapped as (select person_id - person_id % 2 as person_id, label from objects where person_id is not null)
select person_id, label, count(*) as n from mapped group by all""")
def merged_tallies(spark: SparkSession, d: str) -> DataFrame:
    """Tallies by raw id, added up again after ids were merged."""
    from tidemark.operators.joins import relabel

    items = O.held_items(_carried(spark, d))
    merges = items.select(F.col("person_id").alias("old_id")).distinct().where("old_id % 2 = 1").withColumn("new_id", F.col("old_id") - 1)
    return relabel(items, merges, "person_id").groupBy("person_id", "label").agg(F.sum("n").alias("n"))


_PAIRS = "looks a join looks b on a.label = b.label and a.id < b.id"


def _look_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = V.looks(spark, d)
    side = lambda s: e.select("label", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "torso", "legs")])
    return side("a").join(side("b"), "label").where("a_id < b_id")


@query(f"with {V.LOOKS} select a.id as a_id, b.id as b_id, round(list_sum(list_transform(list_zip(a.torso, b.torso), lambda z: least(z[1], z[2]))), 6) as sim from {_PAIRS}")
def hist_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _look_pairs(spark, d).select("a_id", "b_id", F.round(X.intersection(F.col("a_torso"), F.col("b_torso")), 6).alias("sim"))


@query(f"""with {V.LOOKS} select a.id as a_id, b.id as b_id, round(list_sum(list_transform(list_zip(a.torso, b.torso), lambda z: least(z[1], z[2]))) * (case when b.id % 4 > 0 then 0.7 else 1.0 end)
  + (case when b.id % 4 > 0 then 0.3 * list_sum(list_transform(list_zip(a.legs, b.legs), lambda z: least(z[1], z[2]))) else 0.0 end), 6) as sim from {_PAIRS}""")
def blended_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Torso and legs together; every fourth look has no legs."""
    p = _look_pairs(spark, d)
    sim = X.similarity(F.col("a_torso"), F.col("b_torso"), F.col("a_legs"), F.when(F.col("b_id") % 4 > 0, F.col("b_legs")))
    return p.select("a_id", "b_id", F.round(sim, 6).alias("sim"))


@query(f"with {V.LOOKS}, x as (select label, unnest(torso) as v, generate_subscripts(torso, 1) - 1 as pos from looks) select label, pos, round(avg(v), 8) as v from x group by label, pos")
def mean_histogram(spark: SparkSession, d: str) -> DataFrame:
    m = X.mean_vectors(V.looks(spark, d), ["label"], "torso")
    return m.select("label", F.posexplode("mean").alias("pos", "v")).select("label", F.col("pos").cast("long").alias("pos"), F.round("v", 8).alias("v"))


@query(f"""with {V.BOXES} select frame % 5 as camera, round(regr_slope(y2 - y1, y1), 8) as slope, round(regr_intercept(y2 - y1, y1), 6) as intercept, count(*) as n
from boxes group by 1 having count(*) >= 20""")
def height_model(spark: SparkSession, d: str) -> DataFrame:
    m = O.height_model(V.boxes(spark, d).withColumn("camera", F.col("frame") % 5), ["camera"])
    return m.select("camera", F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")


@query(f"""with {V.BOXES}, det as (select *, id % 7 as track_id from boxes), per as (select f.frame, count(det.id) as k from (select frame from boxes union select -1 - frame from boxes) f left join det using (frame) group by f.frame)
select (select count(*) from det) as detections, (select round(avg(case when label % 2 = 1 then 1 else 0 end) * 100, 1) from det) as pct_estimated, (select count(distinct track_id) from det) as ids,
  (select count(*) from (select track_id from det group by 1 having count(*) >= 3)) as stable, max(k) as most, round(avg(k), 2) as mean from per""")
def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    b = V.boxes(spark, d)
    det = b.withColumns({"track_id": F.col("id") % 7, "foot_src": F.when(F.col("label") % 2 == 1, "knees").otherwise("box")})
    empty = b.select((-1 - F.col("frame")).alias("frame"))  # frames without a box count, too
    return O.run_statistics(det, b.select("frame").unionByName(empty).distinct())


@query(f"""with {V.BOXES} select frame, round(min(x1) - 0.15 * (greatest(max(x2), 180) - least(min(x1), 90)) + least(min(x1), 90) - min(x1), 6) as x1,
  round(greatest(max(x2), 180) + 0.15 * (greatest(max(x2), 180) - least(min(x1), 90)), 6) as x2 from boxes group by frame""")
def crop_areas(spark: SparkSession, d: str) -> DataFrame:
    c = O.crop_area(V.boxes(spark, d), ["frame"], (90.0, 90.0, 180.0, 190.0))
    return c.select("frame", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"))


@query(f"""with {V.BOXES}, k as (select id, x1, y1, x2, y2, label from boxes) select id,
  case label % 4 when 0 then (x1 + x2) / 2 when 3 then (x1 + x2) / 2 else (x1 + x2) / 2 + 1 end as fx,
  round(case label % 4 when 0 then y2 when 1 then greatest(y1 + 45 + 15 * (0.249 / 0.229), y2) when 2 then greatest(y1 + 20 / 0.311, y2) else y2 end, 6) as fy,
  case label % 4 when 0 then 'box' when 1 then 'knees' when 2 then 'torso' else 'position' end as src from k""")
def foot_points(spark: SparkSession, d: str) -> DataFrame:
    """Feet of boxes whose visible joints depend on the label: none, to the knees, to the hips, face only."""
    b, cx = V.boxes(spark, d), (F.col("x1") + F.col("x2")) / 2
    y = {5: 10, 6: 10, 11: 30, 12: 30, 13: 45, 14: 45}
    least = {5: 2, 6: 2, 11: 2, 12: 2, 13: 1, 14: 1}
    joint = lambda k: F.struct(
        (cx + 1).alias("x"), (F.col("y1") + float(y.get(k, 0))).alias("y"),
        F.when(F.lit(k in least) & (F.col("label") % 4 <= least.get(k, 0)), 0.9).otherwise(0.1).alias("c"))
    kps = F.when(F.col("label") % 4 == 0, F.expr("cast(array() as array<struct<x:double,y:double,c:double>>)")).otherwise(F.array(*[joint(k) for k in range(17)]))
    f = G.foot(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), kps)
    return b.withColumn("f", f).select("id", F.col("f.x").alias("fx"), F.round("f.y", 6).alias("fy"), F.col("f.src").alias("src"))


@query()
def nms(spark: SparkSession, d: str) -> DataFrame:
    """Greedy suppression by frame and class; checked against brute force in the tests."""
    from tidemark.operators.matching import nms as suppress

    return suppress(V.boxes(spark, d), ["frame"], 0.45, "label")


@query()
def calibration_fit(spark: SparkSession, d: str) -> DataFrame:
    """Fits a matrix to the points of each visitor, which one matrix made; the tests compare with it."""
    from tidemark.operators.calibration import fit_cameras

    t = V.trail(spark, d)
    x, y = G.apply_homography(_h(), F.col("x"), F.col("y"))
    return fit_cameras(t.select(F.col("vid").cast("string").alias("camera"), F.col("x").alias("ix"), F.col("y").alias("iy"), x.alias("px"), y.alias("py")))
