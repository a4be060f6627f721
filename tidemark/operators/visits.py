"""Visits from trails: dwell, zones, queue, censoring, occupancy, spreads, heat, moves and routes.

A trail is long: (vid, t, x, y) and a tie-breaker. ``t`` may be seconds or integer microseconds;
``unit`` says how many of it make a second.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geometry import in_polygon
from tidemark.operators import sequence


@dataclass(frozen=True)
class Zone:
    """A named polygon; role is '', entrance, queue or counter."""

    id: str
    pts: tuple[tuple[float, float], ...]
    role: str = ""

    def box(self) -> tuple[float, float, float, float]:
        xs, ys = [p[0] for p in self.pts], [p[1] for p in self.pts]
        return min(xs), min(ys), max(xs), max(ys)

    def holds(self, x: Column, y: Column) -> Column:
        """Point in polygon, behind a cheap test of the bounding box."""
        a, b, c, d = self.box()
        return x.between(a, c) & y.between(b, d) & in_polygon(x, y, self.pts)


@dataclass(frozen=True)
class Params:
    """Defaults of the visit statistics, in seconds."""

    min_visit: float = 1.0
    max_gap: float = 2.0
    min_queue: float = 2.0
    edge: float = 0.5
    grid: float = 0.5
    trail_step: float = 0.5
    entrance: float = 2.0

    @staticmethod
    def of(**given) -> Params:
        """Defaults overlaid by what is given; names may end in _s, and values that are no numbers are ignored."""
        out = {}
        for k, v in given.items():
            k = k.removesuffix("_s")
            try:
                if k in Params.__dataclass_fields__:
                    out[k] = float(v)
            except (TypeError, ValueError):
                continue
        return Params(**out)


def zone_points(trail: DataFrame, zones: list[Zone]) -> DataFrame:
    """(trail columns, zone, role) for each zone a point lies in: zones are plan constants, so this is no join."""
    x, y = F.col("x"), F.col("y")
    hits = F.filter(F.array(*[F.when(z.holds(x, y), F.struct(F.lit(z.id).alias("zone"), F.lit(z.role).alias("role"))) for z in zones]), lambda z: z.isNotNull())
    return trail.withColumn("__z", F.explode(hits)).select(*trail.columns, "__z.zone", "__z.role")


def in_role(zones: list[Zone], role: str) -> Column:
    """Whether (x, y) lies in any zone of a role."""
    out = F.lit(False)
    for z in zones:
        if z.role == role:
            out = out | z.holds(F.col("x"), F.col("y"))
    return out


def visits(trail: DataFrame, order: list[str], params: Params = Params(), unit: float = 1.0) -> DataFrame:
    """One row a visitor seen for ``min_visit`` or longer: t_in, t_out, dwell, tracked time, samples, runs."""
    gap = params.max_gap * unit
    weighted = sequence.weights(sequence.mark_runs(trail, ["vid"], "t", order, gap), ["vid"], "t", order, gap)
    g = weighted.groupBy("vid").agg(
        F.min("t").alias("t_in"), F.max("t").alias("t_out"), F.sum("w").alias("tracked"), F.count("*").alias("n"), (F.max("run") + 1).alias("runs")
    )
    return g.where(F.col("t_out") - F.col("t_in") >= params.min_visit * unit).withColumn("dwell", F.col("t_out") - F.col("t_in"))


def zone_seconds(trail: DataFrame, order: list[str], zones: list[Zone], params: Params = Params(), unit: float = 1.0) -> DataFrame:
    """(vid, zone, seconds): weights of the samples that lie in each zone."""
    weighted = sequence.weights(trail, ["vid"], "t", order, params.max_gap * unit)
    return zone_points(weighted, zones).groupBy("vid", "zone").agg((F.sum("w") / unit).alias("seconds"))


def zone_rollup(seconds: DataFrame, visitors: DataFrame, zones: list[Zone]) -> DataFrame:
    """(zone, visitors, total, mean, share) with a row for each zone, visited or not."""
    spark = seconds.sparkSession
    dim = spark.createDataFrame([(z.id,) for z in zones], "zone string")
    g = seconds.where("seconds > 0").groupBy("zone").agg(F.count("*").alias("visitors"), F.sum("seconds").alias("total"))
    n = visitors.agg(F.count("*").alias("all"))
    return dim.join(g, "zone", "left").crossJoin(F.broadcast(n)).select(  # one row
        "zone", F.coalesce("visitors", F.lit(0)).alias("visitors"), F.coalesce(F.round("total", 2), F.lit(0.0)).alias("total"),
        F.round(F.col("total") / F.col("visitors"), 2).alias("mean"), F.round(F.coalesce("visitors", F.lit(0)) / F.col("all"), 4).alias("share"),
    )


def queue_segments(trail: DataFrame, order: list[str], zones: list[Zone], params: Params = Params(), unit: float = 1.0) -> DataFrame:
    """(vid, run, t_start, t_end, n, seconds) of stays in queue zones that span ``min_queue`` or more."""
    gap = params.max_gap * unit
    weighted = sequence.weights(trail, ["vid"], "t", order, gap)
    segs = sequence.segments(weighted, ["vid"], "t", order, in_role(zones, "queue"), gap)
    return segs.where(F.round((F.col("t_end") - F.col("t_start")) / unit, 2) >= params.min_queue)


def queue_waits(trail: DataFrame, order: list[str], zones: list[Zone], params: Params = Params(), unit: float = 1.0) -> DataFrame:
    """(vid, joined, served, abandoned, wait): waiting ends at the first counter hit, or with the segment."""
    first = trail.groupBy("vid").agg(F.min(F.when(in_role(zones, "counter"), F.col("t"))).alias("counter"))
    segs = queue_segments(trail, order, zones, params, unit)
    before = F.col("counter").isNull() | (F.col("t_start") < F.col("counter"))
    waited = F.when(before, F.least("t_end", F.coalesce("counter", "t_end")) - F.col("t_start"))
    g = segs.join(first, "vid").groupBy("vid").agg(F.sum(waited).alias("wait"))
    out = first.join(g.withColumn("__j", F.lit(True)), "vid", "left")
    joined = F.coalesce("__j", F.lit(False))
    return out.select(
        "vid", joined.alias("joined"), F.col("counter").isNotNull().alias("served"), (joined & F.col("counter").isNull()).alias("abandoned"),
        F.coalesce(F.col("wait") / unit, F.lit(0.0)).alias("wait"),
    )


def window_bounds(trail: DataFrame, known_end=None) -> DataFrame:
    """One row (w0, w1, window): first and last instant, the end carried on to a known duration."""
    b = trail.agg(F.min("t").alias("w0"), F.max("t").alias("w1"))
    if known_end is not None:
        b = b.withColumn("w1", F.greatest("w1", F.lit(known_end)))
    return b.withColumn("window", F.greatest(F.col("w1") - F.col("w0"), F.lit(1e-6)))


def censoring(visited: DataFrame, bounds: DataFrame, edge) -> DataFrame:
    """Add truncated_in and truncated_out: the visit touches the window's border."""
    return visited.crossJoin(F.broadcast(bounds)).withColumns({  # one row
        "truncated_in": F.col("t_in") <= F.col("w0") + edge, "truncated_out": F.col("t_out") >= F.col("w1") - edge
    }).drop("w0", "w1", "window")


def entered_via(trail: DataFrame, zones: list[Zone], within) -> DataFrame:
    """(vid, via_entrance): a sample of the first ``within`` lies in an entrance zone."""
    first = F.min("t").over(Window.partitionBy("vid"))
    early = trail.withColumn("__t", F.col("t") - first <= within)
    return early.groupBy("vid").agg(F.bool_or(F.col("__t") & in_role(zones, "entrance")).alias("via_entrance"))


def spread(df: DataFrame, value: str, *keys: str, digits: int = 2) -> DataFrame:
    """n, mean, median, p90, max and min of a column; nulls where there is none."""
    v = F.col(value).cast("double")
    aggs = {"mean": F.avg(v), "median": F.percentile(v, 0.5), "p90": F.percentile(v, 0.9), "max": F.max(v), "min": F.min(v)}
    return df.groupBy(*keys).agg(F.count(v).alias("n"), *[F.round(a, digits).alias(k) for k, a in aggs.items()])


def totals(visited: DataFrame, bounds: DataFrame, unit: float = 1.0) -> DataFrame:
    """One row: visitors, arrivals, per hour, complete ones, person-seconds and mean concurrency."""
    g = visited.agg(
        F.count("*").alias("visitors"), F.count_if(~F.col("truncated_in")).alias("arrivals"),
        F.count_if(~F.col("truncated_in") & ~F.col("truncated_out")).alias("complete"), (F.sum("tracked") / unit).alias("person_seconds"),
    )
    hours = F.col("window") / unit / 3600.0
    return g.crossJoin(bounds).select(  # one row each
        "visitors", "arrivals", "complete", F.round("person_seconds", 2).alias("person_seconds"),
        F.round(F.col("arrivals") / hours, 2).alias("per_hour"), F.round(F.col("person_seconds") / (F.col("window") / unit), 4).alias("avg_concurrent"),
    )


def peak(curve: DataFrame) -> DataFrame:
    """(i, n) of the first fullest grid step."""
    return curve.groupBy().agg(F.min_by("i", F.struct(-F.col("n"), F.col("i"))).alias("i"), F.max("n").alias("n"))


def heat(trail: DataFrame, order: list[str], bin_size: float, max_gap) -> DataFrame:
    """(bx, by, seconds): time spent in each square of the floor."""
    w = sequence.weights(trail, ["vid"], "t", order, max_gap)
    return w.groupBy(F.floor(F.col("x") / bin_size).alias("bx"), F.floor(F.col("y") / bin_size).alias("by")).agg(F.sum("w").alias("weight"))


def heat_scale(cells: DataFrame, value: str = "weight") -> DataFrame:
    """Add a colour from 0 to 1: root of the share of the 92nd percentile of occupied cells."""
    top = cells.where(F.col(value) > 0).agg(F.percentile(value, 0.92).alias("__top"))
    return cells.crossJoin(F.broadcast(top)).withColumn("colour", F.least(F.sqrt(F.col(value) / F.nullif("__top", F.lit(0))), F.lit(1.0))).drop("__top")


def zone_stays(trail: DataFrame, order: list[str], zones: list[Zone]) -> DataFrame:
    """(vid, t, zone): the first sample of each stay, one after another; a point takes the first zone that holds it."""
    first = F.coalesce(*[F.when(z.holds(F.col("x"), F.col("y")), z.id) for z in zones])
    inside = trail.withColumn("zone", first).where("zone is not null")
    w = Window.partitionBy("vid").orderBy(*order)
    return inside.withColumn("__p", F.lag("zone").over(w)).where("__p is null or __p <> zone").drop("__p")


def zone_moves(stays: DataFrame, order: list[str]) -> DataFrame:
    """(a, b, moves, visitors) of steps from one zone to the next."""
    w = Window.partitionBy("vid").orderBy(*order)
    steps = stays.select("vid", F.col("zone").alias("a"), F.lead("zone").over(w).alias("b")).where("b is not null")
    per = steps.groupBy("a", "b", "vid").agg(F.count("*").alias("m"))
    return per.groupBy("a", "b").agg(F.sum("m").alias("moves"), F.count("*").alias("visitors"))


def routes(stays: DataFrame, order: str, first: int = 6) -> DataFrame:
    """(route, n): how many visitors went through the zones in this order; routes show ``first`` stays."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct(order, "zone"))), lambda s: s["zone"])
    return stays.groupBy("vid").agg(F.array_join(F.slice(steps, 1, first), ">").alias("route")).groupBy("route").agg(F.count("*").alias("n"))


def brief(name: str, one: DataFrame, zones: DataFrame) -> DataFrame:
    """A short text for a reader: totals, then a line a zone; one row (text)."""
    lines = zones.groupBy().agg(F.array_join(F.array_sort(F.collect_list(
        F.format_string("%s: %d visitors, %.2f s", "zone", "visitors", "total"))), "\n").alias("z"))
    head = F.format_string(name + ": %d visitors, %d arrivals, %.2f person-seconds", "visitors", "arrivals", "person_seconds")
    return one.crossJoin(lines).select(F.concat(head, F.lit("\n"), "z").alias("text"))  # one row each


def document(one: DataFrame, zones: DataFrame, visited: DataFrame) -> DataFrame:
    """The whole result as one JSON document (json); visits should be limited or paged before at scale."""
    z = zones.groupBy().agg(F.array_sort(F.collect_list(F.struct(*zones.columns))).alias("zones"))
    v = visited.groupBy().agg(F.array_sort(F.collect_list(F.struct(*visited.columns))).alias("visits"))
    return one.select(F.struct(*one.columns).alias("totals")).crossJoin(z).crossJoin(v).select(F.to_json(F.struct("totals", "zones", "visits")).alias("json"))
