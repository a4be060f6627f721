"""Queries over trails made from events: runs, dwell, zones, queue, occupancy, heat and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import sequence as Q
from tidemark.operators import visits as W
from tidemark.plans import views as V
from tidemark.plans.registry import query

ORDER = ["t", "event_id"]
SEC = 1e6
P = W.Params(min_visit=24 * 3600.0, max_gap=12 * 3600.0, min_queue=600.0, edge=3600.0)
GAP = V.MAX_GAP

_MARKED = f"""{V.TRAIL}, stepped as (
  select *, t - lag(t) over (partition by vid order by t, event_id) as step, lead(t) over (partition by vid order by t, event_id) - t as ahead from trail
), marked as (
  select *, cast(sum(case when step > {GAP} then 1 else 0 end) over (partition by vid order by t, event_id) as bigint) as run,
    (case when step > {GAP} then {GAP} else coalesce(step, 0) end + case when ahead > {GAP} then {GAP} else coalesce(ahead, 0) end) / 2 as w from stepped
)"""
_VISITS = f"""{_MARKED}, all_visits as (
  select vid, min(t) as t_in, max(t) as t_out, sum(w) as tracked, count(*) as n, max(run) + 1 as runs, max(t) - min(t) as dwell from marked group by vid
), visits as (select * from all_visits where dwell >= {int(P.min_visit * SEC)})"""


def _inside(z: W.Zone) -> str:
    """Even-odd ray casting over a zone's edges, written out."""
    edges = " + ".join(
        f"(case when ({ay!r} > y) <> ({by!r} > y) and x < ({bx!r} - ({ax!r})) / ({by!r} - ({ay!r})) * (y - ({ay!r})) + ({ax!r}) then 1 else 0 end)"
        for (ax, ay), (bx, by) in zip(z.pts, [*z.pts[1:], z.pts[0]]) if ay != by
    )
    return f"({edges}) % 2 = 1"


_HITS = " union all ".join(f"select vid, event_id, t, x, y, kind, w, '{z.id}' as zone, '{z.role}' as role from marked where {_inside(z)}" for z in V.ZONES)
_QUEUE = f"""{_MARKED}, hits as ({_HITS}), in_line as (
  select *, t - lag(t) over (partition by vid order by t, event_id) as back from hits where role = 'queue'
), seg_rows as (
  select *, cast(sum(case when back > {GAP} then 1 else 0 end) over (partition by vid order by t, event_id) as bigint) as seg from in_line
), segs as (
  select vid, seg as run, min(t) as t_start, max(t) as t_end, count(*) as n, sum(w) as seconds from seg_rows group by vid, seg
  having round((max(t) - min(t)) / {SEC}, 2) >= {P.min_queue}
), counters as (
  select vid, min(t) filter (role = 'counter') as counter from (select vid, t, role from hits union all select vid, t, '' as role from marked) group by vid
), waits as (
  select vid, sum(case when counter is null or t_start < counter then least(t_end, coalesce(counter, t_end)) - t_start end) as wait, count(*) as k from segs join counters using (vid) group by vid
), queued as (
  select c.vid, k is not null as joined, counter is not null as served, k is not null and counter is null as abandoned, coalesce(wait / {SEC}, 0.0) as wait
  from counters c left join waits using (vid)
)"""


def _trail(spark: SparkSession, d: str) -> DataFrame:
    return V.trail(spark, d)


@query(f"with {_MARKED} select vid, run, min(t) as t_start, max(t) as t_end, count(*) as n, round(sum(x), 4) as total from marked group by vid, run")
def visits_basic(spark: SparkSession, d: str) -> DataFrame:
    return Q.runs(_trail(spark, d), ["vid"], "t", ORDER, GAP, F.round(F.sum("x"), 4).alias("total"))


@query(f"with {_VISITS} select vid, t_in, t_out, round(tracked, 2) as tracked, n, runs, dwell from visits")
def visit_dwell(spark: SparkSession, d: str) -> DataFrame:
    return W.visits(_trail(spark, d), ORDER, P, SEC).withColumns({"runs": F.col("runs").cast("long"), "tracked": F.round("tracked", 2)})


@query(f"with {_VISITS} select count(*) as seen, count(*) filter (dwell < {int(P.min_visit * SEC)}) as dropped from all_visits")
def dropped_short(spark: SparkSession, d: str) -> DataFrame:
    t = _trail(spark, d)
    kept = Q.long_enough(t, ["vid"], "t", int(P.min_visit * SEC)).agg(F.count("*").alias("kept"))
    return t.agg(F.count_distinct("vid").alias("seen")).crossJoin(kept).select("seen", (F.col("seen") - F.col("kept")).alias("dropped"))


@query(f"with {V.TRAIL} select vid, min(t) as first_t, max(t) as last_t, round((max(t) - min(t)) / 1e6, 3) as duration, count(*) as points from trail group by vid")
def track_summary(spark: SparkSession, d: str) -> DataFrame:
    return _trail(spark, d).groupBy("vid").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.round((F.max("t") - F.min("t")) / 1e6, 3).alias("duration"), F.count("*").alias("points"))


@query(f"with {_MARKED} select vid, event_id, w from marked")
def sample_weights(spark: SparkSession, d: str) -> DataFrame:
    return Q.weights(_trail(spark, d), ["vid"], "t", ORDER, GAP).select("vid", "event_id", "w")


@query(f"with {_MARKED}, hits as ({_HITS}) select event_id, zone, role from hits")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return W.zone_points(_trail(spark, d), V.ZONES).select("event_id", "zone", "role")


_ZONE_S = f"{_VISITS}, hits as ({_HITS}), zone_s as (select vid, zone, sum(w) / 1e6 as seconds from hits group by vid, zone)"


@query(f"with {_ZONE_S} select vid, zone, round(seconds, 3) as seconds from zone_s")
def zone_seconds(spark: SparkSession, d: str) -> DataFrame:
    return W.zone_seconds(_trail(spark, d), ORDER, V.ZONES, P, SEC).withColumn("seconds", F.round("seconds", 3))


@query(f"""with {_ZONE_S}, dim as (select unnest(['door', 'line', 'till', 'nook']) as zone)
select zone, count(vid) as visitors, coalesce(round(sum(seconds), 2), 0.0) as total, round(sum(seconds) / nullif(count(vid), 0), 2) as mean,
  round(count(vid) / (select count(*) from all_visits), 4) as share from dim left join (select * from zone_s where seconds > 0) using (zone) group by zone""")
def zone_rollup(spark: SparkSession, d: str) -> DataFrame:
    t = _trail(spark, d)
    return W.zone_rollup(W.zone_seconds(t, ORDER, V.ZONES, P, SEC), t.select("vid").distinct(), V.ZONES)


@query(f"with {_QUEUE} select vid, run, t_start, t_end, n, round(seconds, 2) as seconds from segs")
def queue_segments(spark: SparkSession, d: str) -> DataFrame:
    return W.queue_segments(_trail(spark, d), ORDER, V.ZONES, P, SEC).withColumn("seconds", F.round("seconds", 2))


@query(f"with {_QUEUE} select vid, joined, served, abandoned, round(wait, 3) as wait from queued")
def queue_wait(spark: SparkSession, d: str) -> DataFrame:
    return W.queue_waits(_trail(spark, d), ORDER, V.ZONES, P, SEC).withColumn("wait", F.round("wait", 3))


@query(f"""with {_QUEUE} select count(*) filter (joined) as joined, round(count(*) filter (joined) / count(*), 4) as share, count(*) filter (served) as served,
  count(*) filter (abandoned) as abandoned, round(avg(wait) filter (wait > 0), 2) as mean_wait, round(quantile_cont(wait, 0.5) filter (wait > 0), 2) as median_wait,
  round(sum(wait), 1) as total_wait from queued""")
def queue_rollup(spark: SparkSession, d: str) -> DataFrame:
    q = W.queue_waits(_trail(spark, d), ORDER, V.ZONES, P, SEC)
    pos = F.when(F.col("wait") > 0, F.col("wait"))
    return q.agg(
        F.count_if("joined").alias("joined"), F.round(F.count_if("joined") / F.count("*"), 4).alias("share"), F.count_if("served").alias("served"),
        F.count_if("abandoned").alias("abandoned"), F.round(F.avg(pos), 2).alias("mean_wait"), F.round(F.percentile(pos, 0.5), 2).alias("median_wait"), F.round(F.sum("wait"), 1).alias("total_wait"))


_LO, _HI, _STEP = 1704067200000000, 1706659200000000, V.HOUR
_CURVE = f"""{_MARKED}, spans as (select vid, run, min(t) as a, max(t) as b from marked group by vid, run), clipped as (
  select greatest(0, cast(trunc((a - {_LO}) / {_STEP}) as bigint)) as i0, least({(_HI - _LO) // _STEP}, cast(ceil((b - {_LO}) / {_STEP}) as bigint)) as i1 from spans
), curve as (
  select i, count(j) as n from (select unnest(range(0, {(_HI - _LO) // _STEP + 1})) as i) g left join (select unnest(range(i0, i1 + 1)) as j from clipped) on i = j group by i
)"""


def _curve(spark: SparkSession, d: str) -> DataFrame:
    spans = Q.runs(_trail(spark, d), ["vid"], "t", ORDER, GAP)
    return Q.occupancy(spans, "t_start", "t_end", _LO, _HI, _STEP)


@query(f"with {_CURVE} select i, n from curve")
def occupancy_curve(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d)


@query(f"with {_CURVE} select min(i) as i, n from curve where n = (select max(n) from curve) group by n")
def peak_concurrency(spark: SparkSession, d: str) -> DataFrame:
    return W.peak(_curve(spark, d))


@query(f"""with {_VISITS}, runs as (select kind_of, t_end - t_start as span from (select vid % 3 as kind_of, run, min(t) as t_start, max(t) as t_end from marked group by vid, run))
select kind_of, count(*) as n, round(avg(span / 1e6), 2) as mean, round(quantile_cont(span / 1e6, 0.5), 2) as median, round(quantile_cont(span / 1e6, 0.9), 2) as p90,
  round(max(span / 1e6), 2) as max, round(min(span / 1e6), 2) as min from runs group by kind_of""")
def dwell_spread(spark: SparkSession, d: str) -> DataFrame:
    r = Q.runs(_trail(spark, d), ["vid"], "t", ORDER, GAP)
    return W.spread(r.select((F.col("vid") % 3).alias("kind_of"), ((F.col("t_end") - F.col("t_start")) / 1e6).alias("span")), "span", "kind_of")


_BOUNDS = f"bounds as (select min(t) as w0, max(t) as w1, greatest(max(t) - min(t), 1e-6) as win from trail)"
_CENSORED = f"{_VISITS}, {_BOUNDS}, censored as (select v.*, t_in <= w0 + {int(P.edge * SEC)} as truncated_in, t_out >= w1 - {int(P.edge * SEC)} as truncated_out from visits v, bounds)"


def _censored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = _trail(spark, d)
    b = W.window_bounds(t)
    return W.censoring(W.visits(t, ORDER, P, SEC), b, int(P.edge * SEC)), b


@query(f"with {_CENSORED} select vid, truncated_in, truncated_out from censored")
def censor_flags(spark: SparkSession, d: str) -> DataFrame:
    return _censored(spark, d)[0].select("vid", "truncated_in", "truncated_out")


@query(f"""with {_CENSORED} select count(*) as visitors, count(*) filter (not truncated_in) as arrivals, count(*) filter (not truncated_in and not truncated_out) as complete,
  round(sum(tracked) / 1e6, 2) as person_seconds, round(count(*) filter (not truncated_in) / (any_value(win) / 1e6 / 3600.0), 2) as per_hour,
  round(sum(tracked) / 1e6 / (any_value(win) / 1e6), 4) as avg_concurrent from censored, bounds""")
def visit_totals(spark: SparkSession, d: str) -> DataFrame:
    c, b = _censored(spark, d)
    return W.totals(c, b, SEC)


@query(f"""with {_MARKED}, first as (select vid, min(t) as t0 from trail group by vid)
select vid, bool_or(t - t0 <= {6 * V.HOUR} and ({_inside(V.ZONES[0])})) as via_entrance from trail join first using (vid) group by vid""")
def entered_via_entrance(spark: SparkSession, d: str) -> DataFrame:
    return W.entered_via(_trail(spark, d), V.ZONES, 6 * V.HOUR)


@query(f"with {_MARKED} select cast(floor(x / 20) as bigint) as bx, cast(floor(y / 20) as bigint) as by, round(sum(w) / 1e6, 2) as seconds from marked group by all")
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    return W.heat(_trail(spark, d), ORDER, 20.0, GAP).select("bx", "by", F.round(F.col("weight") / 1e6, 2).alias("seconds"))


@query(f"""with {_MARKED}, cells as (select cast(floor(x / 20) as bigint) as bx, cast(floor(y / 20) as bigint) as by, sum(w) as weight from marked group by all),
top as (select quantile_cont(weight, 0.92) as q from cells where weight > 0)
select bx, cells."by" as cell_y, round(least(sqrt(weight / nullif(q, 0)), 1.0), 6) as colour from cells, top""")
def heat_colours(spark: SparkSession, d: str) -> DataFrame:
    return W.heat_scale(W.heat(_trail(spark, d), ORDER, 20.0, GAP)).select("bx", F.col("by").alias("cell_y"), F.round("colour", 6).alias("colour"))


_STAYS = f"""{_MARKED}, zoned as (select vid, t, event_id, case {' '.join(f"when {_inside(z)} then '{z.id}'" for z in V.ZONES)} end as zone from trail),
changes as (select *, lag(zone) over (partition by vid order by t, event_id) as was from zoned where zone is not null), stays as (select * from changes where was is null or was <> zone)"""


@query(f"""with {_STAYS}, steps as (select vid, zone as a, lead(zone) over (partition by vid order by t, event_id) as b from stays)
select a, b, count(*) as moves, count(distinct vid) as visitors from steps where b is not null group by a, b""")
def zone_moves(spark: SparkSession, d: str) -> DataFrame:
    return W.zone_moves(W.zone_stays(_trail(spark, d), ORDER, V.ZONES), ORDER)


@query(f"""with {_STAYS}, ranked as (select vid, zone, t, event_id, row_number() over (partition by vid order by t, event_id) as k from stays),
per as (select vid, string_agg(zone, '>' order by k) as route from ranked where k <= 6 group by vid) select route, count(*) as n from per group by route""")
def common_routes(spark: SparkSession, d: str) -> DataFrame:
    stays = W.zone_stays(_trail(spark, d), ORDER, V.ZONES)
    return W.routes(stays.withColumn("o", F.struct("t", "event_id")), "o")


@query(f"""with {V.TRAIL}, around as (select vid, event_id, list_sort(list(x) over (partition by vid order by t, event_id rows between 2 preceding and 2 following)) as s from trail)
select vid, event_id, s[len(s) // 2 + 1] as med from around""")
def rolling_median(spark: SparkSession, d: str) -> DataFrame:
    return Q.rolling_median(_trail(spark, d), ["vid"], ORDER, "x", 2).select("vid", "event_id", "med")


@query(f"""with {V.TRAIL}, around as (select vid, event_id, list_sort(list(x) over (partition by vid order by t, event_id rows between 2 preceding and current row)) as s from trail)
select vid, event_id, s[len(s) // 2 + 1] as med from around""")
def causal_median(spark: SparkSession, d: str) -> DataFrame:
    return Q.rolling_median(_trail(spark, d), ["vid"], ORDER, "x", 2, causal=True).select("vid", "event_id", "med")


@query(f"""with {V.TRAIL}, gaps as (select *, coalesce(t - lag(t) over (partition by vid order by t, event_id) > {6 * V.HOUR}, false) as new from trail),
parts as (select *, sum(cast(new as integer)) over (partition by vid order by t, event_id rows unbounded preceding) as part from gaps),
around as (select vid, event_id, list_sort(list(x) over (partition by vid, part order by t, event_id rows between 2 preceding and current row)) as s from parts)
select vid, event_id, s[len(s) // 2 + 1] as med from around""")
def causal_median_forgetting(spark: SparkSession, d: str) -> DataFrame:
    return Q.causal_median(_trail(spark, d), ["vid"], "t", ["event_id"], "x", 2, 6 * V.HOUR).select("vid", "event_id", "med")


@query(f"""with recursive {V.TRAIL}, numbered as (select *, row_number() over (partition by vid order by t, event_id) as k from trail), walk as (
  select vid, k, event_id, x as sx, y as sy from numbered where k = 1
  union all
  select n.vid, n.k, n.event_id,
    w.sx + (n.x - w.sx) * (case when sqrt((n.x - w.sx) ** 2 + (n.y - w.sy) ** 2) <= 25 then 0.0 else (sqrt((n.x - w.sx) ** 2 + (n.y - w.sy) ** 2) - 25) / sqrt((n.x - w.sx) ** 2 + (n.y - w.sy) ** 2) end),
    w.sy + (n.y - w.sy) * (case when sqrt((n.x - w.sx) ** 2 + (n.y - w.sy) ** 2) <= 25 then 0.0 else (sqrt((n.x - w.sx) ** 2 + (n.y - w.sy) ** 2) - 25) / sqrt((n.x - w.sx) ** 2 + (n.y - w.sy) ** 2) end)
  from walk w join numbered n on n.vid = w.vid and n.k = w.k + 1
) select vid, event_id, round(sx, 4) as sx, round(sy, 4) as sy from walk""")
def leaky_deadband(spark: SparkSession, d: str) -> DataFrame:
    t = _trail(spark, d).select("vid", "event_id", "t", "x", "y").withColumn("band", F.lit(25.0))
    return Q.dead_band(t, ["vid"], "t", "x", "y", "band").select("vid", "event_id", F.round("sx", 4).alias("sx"), F.round("sy", 4).alias("sy"))


@query(f"""with recursive {V.TRAIL}, numbered as (
  select *, row_number() over (partition by vid order by t, event_id) as k, count(*) over (partition by vid) as n,
    greatest({24 * V.HOUR}, (max(t) over (partition by vid) - min(t) over (partition by vid)) / 400) as wide from trail
), walk as (
  select vid, k, n, event_id, t, true as kept, t as last from numbered where k = 1
  union all
  select m.vid, m.k, m.n, m.event_id, m.t, m.t - w.last >= m.wide, case when m.t - w.last >= m.wide then m.t else w.last end from walk w join numbered m on m.vid = w.vid and m.k = w.k + 1
) select vid, event_id, t from walk where kept or k = n""")
def trail_thin(spark: SparkSession, d: str) -> DataFrame:
    return Q.thin(_trail(spark, d), ["vid"], "t", ["event_id"], 24 * V.HOUR).select("vid", "event_id", "t")


@query(f"with {V.TRAIL}, one as (select *, row_number() over (partition by vid, t // {V.HOUR} order by t, event_id) as k from trail) select vid, event_id from one where k = 1")
def first_of_instant(spark: SparkSession, d: str) -> DataFrame:
    t = _trail(spark, d).withColumn("slot", F.floor(F.col("t") / V.HOUR))
    return Q.first_of_instant(t, ["vid"], "slot", ORDER).select("vid", "event_id")


@query(f"""with {V.TRAIL}, last as (select vid, max(t) as t1 from trail group by vid), tail as (select * from trail join last using (vid) where t1 - t <= {48 * V.HOUR}),
g as (select vid, max(t1) as t1, min(t) as ta, arg_min(x, t) as xa, arg_min(y, t) as ya, arg_max(x, t) as x1, arg_max(y, t) as y1 from tail group by vid)
select vid, t1, x1, y1, round(coalesce((x1 - xa) / nullif((t1 - ta) / 3.6e9, 0), 0), 6) as vx, round(coalesce((y1 - ya) / nullif((t1 - ta) / 3.6e9, 0), 0), 6) as vy from g""")
def tail_velocity(spark: SparkSession, d: str) -> DataFrame:
    v = Q.tail_velocity(_trail(spark, d), ["vid"], "t", "x", "y", 48 * V.HOUR)
    return v.select("vid", "t1", "x1", "y1", F.round(F.col("vx") * 3.6e9, 6).alias("vx"), F.round(F.col("vy") * 3.6e9, 6).alias("vy"))


@query(f"""with {V.TRAIL}, steps as (select vid, t, x, y, lead(t) over w as nt, lead(x) over w as nx, lead(y) over w as ny from trail window w as (partition by vid order by t)),
span as (select vid, min(t) as a, max(t) as b from trail group by vid), grid as (
  select vid, unnest(range(cast(ceil(a / {6 * V.HOUR}.0) as bigint), cast(floor(b / {6 * V.HOUR}.0) as bigint) + 1)) as i from span)
select g.vid, i, round(s.x + coalesce((nx - s.x) * (i * {6 * V.HOUR} - s.t) / nullif(nt - s.t, 0), 0), 4) as x, round(s.y + coalesce((ny - s.y) * (i * {6 * V.HOUR} - s.t) / nullif(nt - s.t, 0), 0), 4) as y
from grid g join steps s on s.vid = g.vid and s.t <= i * {6 * V.HOUR} and (nt is null or i * {6 * V.HOUR} < nt)""")
def grid_resample(spark: SparkSession, d: str) -> DataFrame:
    return Q.resample(_trail(spark, d), ["vid"], "t", ["x", "y"], 6 * V.HOUR).select("vid", "i", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"with {V.TRAIL}, o as (select vid, t, lead(t) over w as n, row_number() over w as k from trail window w as (partition by vid order by t)) select vid, n - t as interval from o where k = 1")
def first_interval(spark: SparkSession, d: str) -> DataFrame:
    return Q.nth_gap(_trail(spark, d), ["vid"], "t")


@query()
def visit_brief(spark: SparkSession, d: str) -> DataFrame:
    """The text brief of the visit statistics (its figures are checked by visit_totals and zone_rollup)."""
    return W.brief("events", visit_totals(spark, d), zone_rollup(spark, d))


@query()
def visit_document(spark: SparkSession, d: str) -> DataFrame:
    """The JSON document of the visit statistics."""
    return W.document(visit_totals(spark, d), zone_rollup(spark, d), visit_dwell(spark, d))
