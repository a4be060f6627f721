"""Queries over joins, set operations, limits and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators import sequence as Q
from tidemark.plans import views as V
from tidemark.plans.registry import query
from tidemark.plans.visit_queries import GAP, ORDER, _MARKED

HOUR = V.HOUR
_SHELVES = {(r, c) for r in (2, 5) for c in range(2, 11)}
_RUNS = f"{_MARKED}, runs as (select vid, run, min(t) as t0, max(t) as t1, count(*) as n, arg_min(x, t) as x0, arg_max(x, t) as x1 from marked group by vid, run)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    r = Q.runs(V.trail(spark, d), ["vid"], "t", ORDER, GAP, F.min_by("x", "t").alias("x0"), F.max_by("x", "t").alias("x1"))
    return r.withColumnsRenamed({"t_start": "t0", "t_end": "t1"})


@query(f"""with {V.TRAIL}, probes as (select vid, event_id as probe, t + {HOUR} as t from trail where kind = 'click'), samples as (select vid, t, event_id, x from trail where kind <> 'click'),
pairs as (select p.vid, probe, p.t, s.t as near_t, s.event_id, s.x, row_number() over (partition by probe order by abs(s.t - p.t), s.t) as k from probes p left join samples s on s.vid = p.vid)
select vid, probe, t, near_t, event_id, x from pairs where k = 1""")
def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    t = V.trail(spark, d)
    probes = t.where("kind = 'click'").select("vid", F.col("event_id").alias("probe"), (F.col("t") + HOUR).alias("t"))
    return J.asof_nearest(probes, t.where("kind <> 'click'").select("vid", "t", "event_id", "x"), ["vid"], "t", ["event_id", "x"])


@query(f"""with {V.TRAIL}, probes as (select vid, event_id as probe, t + {HOUR} as t from trail where kind = 'click'), samples as (select vid, t, event_id, x from trail where kind <> 'click'),
pairs as (select p.vid, probe, s.t as near_t, s.event_id, row_number() over (partition by probe order by abs(s.t - p.t), s.t) as k from probes p left join samples s on s.vid = p.vid and abs(s.t - p.t) <= {3 * HOUR})
select vid, probe, near_t, event_id from pairs where k = 1""")
def asof_tolerance(spark: SparkSession, d: str) -> DataFrame:
    t = V.trail(spark, d)
    probes = t.where("kind = 'click'").select("vid", F.col("event_id").alias("probe"), (F.col("t") + HOUR).alias("t"))
    near = J.asof_nearest(probes, t.where("kind <> 'click'").select("vid", "t", "event_id"), ["vid"], "t", ["event_id"], 3 * HOUR)
    return near.select("vid", "probe", "near_t", "event_id")


@query(f"""with {_RUNS} select a.vid as a_vid, a.run as a_run, b.vid as b_vid, b.run as b_run, b.t0 - a.t1 as gap from runs a join runs b
on a.vid % 5 = b.vid % 5 and b.t0 - a.t1 > 0 and b.t0 - a.t1 <= {HOUR}""")
def handoff_candidates(spark: SparkSession, d: str) -> DataFrame:
    r = _runs(spark, d).withColumn("lane", F.col("vid") % 5)
    side = lambda s: r.select("lane", *[F.col(c).alias(f"{s}_{c}") for c in ("vid", "run", "t0", "t1")])
    pairs = J.gap_join(side("a"), side("b"), "a_t1", "b_t0", HOUR, ["lane"])
    return pairs.select("a_vid", "a_run", "b_vid", "b_run", (F.col("b_t0") - F.col("a_t1")).alias("gap"))


@query(f"""with {_RUNS} select a.vid as a_vid, a.run as a_run, b.vid as b_vid, b.run as b_run, least(a.t1, b.t1) - greatest(a.t0, b.t0) as overlap from runs a join runs b
on a.vid < b.vid and least(a.t1, b.t1) - greatest(a.t0, b.t0) >= {HOUR}""")
def interval_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of any two visitors that share an hour or more."""
    r = _runs(spark, d)
    side = lambda s: r.select(*[F.col(c).alias(f"{s}_{c}") for c in ("vid", "run", "t0", "t1")])
    both = J.overlap_join(side("a"), side("b"), "a_t0", "a_t1", "b_t0", "b_t1", HOUR, 24 * HOUR).where("a_vid < b_vid")
    return both.select("a_vid", "a_run", "b_vid", "b_run", (F.least("a_t1", "b_t1") - F.greatest("a_t0", "b_t0")).alias("overlap"))


_GRID = f"""{V.TRAIL}, steps as (select vid, t, x, lead(t) over w as nt, lead(x) over w as nx from trail window w as (partition by vid order by t)),
span as (select vid, min(t) as a, max(t) as b from trail group by vid), slots as (
  select vid, unnest(range(cast(ceil(a / {24 * HOUR}.0) as bigint), cast(floor(b / {24 * HOUR}.0) as bigint) + 1)) as i from span),
grid as (select g.vid, i, s.x + coalesce((nx - s.x) * (i * {24 * HOUR} - s.t) / nullif(nt - s.t, 0), 0) as x from slots g join steps s on s.vid = g.vid and s.t <= i * {24 * HOUR} and (nt is null or i * {24 * HOUR} < nt))"""


@query(f"""with {_GRID} select a.vid as a_vid, b.vid as b_vid, count(*) as steps, round(quantile_cont(abs(a.x - b.x), 0.5), 4) as d, round(avg(case when abs(a.x - b.x) <= 30 then 1 else 0 end), 6) as close
from grid a join grid b on a.i = b.i and a.vid < b.vid and a.vid % 10 = b.vid % 10 group by all""")
def pair_evidence(spark: SparkSession, d: str) -> DataFrame:
    g = Q.resample(V.trail(spark, d), ["vid"], "t", ["x"], 24 * HOUR).withColumn("lane", F.col("vid") % 10)
    return Q.pair_evidence(g, "lane", "vid", "i", "x", 30.0).withColumnsRenamed({"a": "a_vid", "b": "b_vid"})


@query(f"""with {_GRID}, p as (select vid % 20 as visitor_id, vid % 2 as cam, vid, i, x, greatest(0.02 * (vid % 7), 0.05) as w from grid)
select visitor_id, i, round(sum(w * x) / sum(w), 1) as map_x, count(distinct cam) as n_cams from p group by visitor_id, i""")
def fused_trail(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.fusion import fused_trail as fuse

    g = Q.resample(V.trail(spark, d), ["vid"], "t", ["x"], 24 * HOUR)
    p = g.select(F.lit("s").alias("scene"), (F.col("vid") % 20).alias("visitor_id"), (F.col("vid") % 2).alias("cam"), "i", "x", F.col("x").alias("y"), (0.02 * (F.col("vid") % 7)).alias("w"))
    return fuse(p).select("visitor_id", "i", "map_x", "n_cams")


@query(f"""with {V.TRAIL}, probe as (select event_id, vid, x, y from trail where event_id % 20 = 0), target as (select vid, event_id as near, x as tx, y as ty from trail),
p as (select event_id, near, sqrt((x - tx) ** 2 + (y - ty) ** 2) as dist, row_number() over (partition by event_id order by sqrt((x - tx) ** 2 + (y - ty) ** 2), near) as k from probe join target using (vid) where near <> event_id and sqrt((x - tx) ** 2 + (y - ty) ** 2) <= 40)
select probe.event_id, near, round(dist, 6) as dist from probe left join (select * from p where k = 1) p using (event_id)""")
def nearest_within(spark: SparkSession, d: str) -> DataFrame:
    t = V.trail(spark, d)
    probe = t.where("event_id % 20 = 0").select("event_id", "vid", "x", "y")
    target = t.select("vid", F.col("event_id").alias("near"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    dist = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    best = J.best_match(probe, target, ["vid"], (F.col("near") != F.col("event_id")) & (dist <= 40), ["event_id"], [dist, F.col("near")])
    return best.select("event_id", "near", F.round(dist, 6).alias("dist"))


@query("""select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)""")
def anti_unseen(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "customer").join(V.table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""select user_id, count(*) as n from events where user_id in (select user_id from events where event_type = 'purchase' and value > 100) group by user_id""")
def semi_visible(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    return e.join(e.where("event_type = 'purchase' and value > 100").select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


_CAM = "select user_id, event_id, value from events where user_id % 2 = {}"


@query(f"{_CAM.format(0)} union all {_CAM.format(1)}")
def union_cams(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").select("user_id", "event_id", "value")
    return e.where("user_id % 2 = 0").unionByName(e.where("user_id % 2 = 1"))


@query("select distinct user_id from events where event_type = 'click' intersect select distinct user_id from events where event_type = 'error' and value > 200")
def intersect_cams(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("event_type = 'error' and value > 200").select("user_id"))


@query("select user_id from events where event_type = 'view' except select user_id from events where value > 300")
def except_ids(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    return e.where("event_type = 'view'").select("user_id").subtract(e.where("value > 300").select("user_id"))


@query("""select user_id, value as v, 'a' as side from events where event_type = 'view' and value > 50
union all select user_id, min(value) as v, 'b' as side from events where event_type = 'click' and user_id not in (select user_id from events where event_type = 'view' and value > 50) group by user_id""")
def left_wins_union(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    a = e.where("event_type = 'view' and value > 50").select("user_id", F.col("value").alias("v"), F.lit("a").alias("side"))
    b = e.where("event_type = 'click'").groupBy("user_id").agg(F.min("value").alias("v")).withColumn("side", F.lit("b"))
    return a.unionByName(b.join(a.select("user_id"), "user_id", "left_anti"))


@query("select event_id, user_id, event_type from events order by event_id desc limit 200")
def latest_n(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.streaming.events import newest

    e = V.table(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id", "event_type")
    return newest(e, 200).withColumnRenamed("seq", "event_id")


@query("select event_id, user_id from events where event_id > 500 order by event_id limit 100")
def since_limit(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.streaming.events import since

    return since(V.table(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id"), 500, 100).withColumnRenamed("seq", "event_id")


@query("""select user_id, event_id, coalesce(b, user_id) as label from events left join (select distinct user_id as a, user_id - 1 as b from events where user_id % 3 = 1) on user_id = a""")
def relabelled(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    ids = e.select(F.col("user_id").alias("old_id")).distinct().where("old_id % 3 = 1").withColumn("new_id", F.col("old_id") - 1)
    return J.relabel(e.select("event_id", "user_id", F.col("user_id").alias("label")), ids, "label").select("user_id", "event_id", "label")


@query("""with m as (select cast(range as integer) as minute from range(480)) select minute, round(0.3 * (0.15 + 0.85 * greatest(exp(-0.5 * ((10.0 + minute / 60.0 - 13.0) / 1.5) ** 2), exp(-0.5 * ((10.0 + minute / 60.0 - 16.5) / 1.2) ** 2))), 8) as p,
  round(cast(least(0.12 * (1 + 0.4 * (minute % 12)), 0.6) as double), 8) as leave, greatest(1, cast(trunc((minute % 9) * 0.7) as integer)) as scaled from m""")
def arrival_curve(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions import geometry as G

    m = spark.range(480).select(F.col("id").cast("int").alias("minute"))
    return m.select(
        "minute", F.round(G.arrival_curve(F.col("minute"), 0.3, 10.0), 8).alias("p"),
        F.round(G.abandon_probability(F.lit(0.12), F.col("minute") % 12 + 1), 8).alias("leave"), G.scale_range(F.col("minute") % 9, 0.7).alias("scaled"))


@query("""with recursive grid as (select r, c from range(8) a(r), range(14) b(c) where not (r in (2, 5) and c between 2 and 10)),
walk(r, c, steps, seen) as (
  select cast(7 as bigint), cast(7 as bigint), 0, true union select g.r, g.c, w.steps + 1, true from walk w join grid g on abs(g.r - w.r) + abs(g.c - w.c) = 1 where w.steps < 40
) select r, c, min(steps) as steps from walk group by r, c""")
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """Steps from the entrance to every cell of a store with two shelves in the way."""
    from tidemark.operators.store import walking_distances

    return walking_distances(spark, _SHELVES)


@query("""with grid as (select r, c, r in (2, 5) and c between 2 and 10 as shelf from range(8) a(r), range(14) b(c))
select distinct g.r, g.c, s.r as shelf_r, s.c as shelf_c from grid g join grid s on abs(g.r - s.r) + abs(g.c - s.c) = 1 where s.shelf and not g.shelf""")
def access_cells(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators import store

    return store.access_cells(store.grid(spark, _SHELVES)).select("r", "c", "shelf_r", "shelf_c")


@query("""with docs as (select doc_id, lang, source from documents), t as (select distinct doc_id from labels), z as (select source, count(*) as n, list_sort(list(distinct lang)) as roles from docs group by source)
select source, n, array_to_string(roles, ',') as roles, (select count(*) from docs d join t using (doc_id) where d.source = z.source) as labelled from z""")
def source_catalogue(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select("doc_id", "lang", "source")
    z = docs.groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("roles"))
    own = docs.join(V.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("k"))
    return z.join(own, "source", "left").select("source", "n", "roles", F.coalesce("k", F.lit(0)).alias("labelled"))
