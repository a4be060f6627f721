"""The event log: what a camera could see of it, one row a visit, funnel and conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import WEEK, found, minutes, weekday

# Actions a camera cannot see, those it sees under another name, and details it cannot read.
UNSEEN = ("HEADING", "IN_FITTING")
SEEN_AS = {
    "NO_PICK": "BROWSING", "PICKED_ITEM": "BROWSING", "PUT_BACK_SHELF": "BROWSING",
    "CHECKOUT_CALLED": "REACHED_COUNTER", "PURCHASED": "CHECKOUT_COMPLETED",
}
BLANKED = ("MOVING", "PAUSED", "AT_CHECKOUT", "ARRIVED_FITTING_AREA", "LEFT_FITTING", "CHECKOUT_CALLED", "PURCHASED")
STAGES = ("purchased", "at_counter", "queued", "abandoned_queue", "used_fitting", "gave_up_fitting", "approached_fitting", "browsed", "entered_only")


def video_log(log: DataFrame) -> DataFrame:
    """Drop unseen actions, rename and redact the rest; other columns pass."""
    action, details = F.col("action"), F.coalesce("details", F.lit(""))
    part = lambda p, f: F.coalesce(F.format_string(f, found(details, p)), F.lit(""))
    keep = lambda p, f: F.when(found(details, p).isNotNull(), part(p, f))
    who = F.concat_ws(" ", keep(r"gender=(\w+)", "gender~%s"), keep(r"age=(\w+)", "age~%s"))
    position, waited = (F.coalesce(keep(*x), F.lit("")) for x in ((r"position #(\d+)", "position #%s"), (r"waited (\d+) ticks", "waited %s ticks")))
    seen = (
        F.when(action.isin(*BLANKED), F.lit("")).when(action == "ENTERED", who)
        .when(action.isin("JOINED_QUEUE", "ABANDONED_QUEUE"), position).when(action == "ENTERED_FITTING", waited).otherwise(details)
    )
    names = F.create_map(*[F.lit(x) for kv in SEEN_AS.items() for x in kv])
    return log.where(~action.isin(*UNSEEN)).withColumns({"details": seen, "action": F.coalesce(F.try_element_at(names, action), action)})


def shopper_summary(video: DataFrame) -> DataFrame:
    """One row per (day, shopper_id) of a video log with a row order in seq; all in one aggregation."""
    is_ = lambda *a: F.col("action").isin(*a)
    last = lambda v, cond: F.max_by(v, F.when(cond, F.col("seq")))
    seen = lambda a: F.coalesce(F.bool_or(is_(a)), F.lit(False))
    entered, place, wait = is_("ENTERED"), found(F.col("details"), r"position #(\d+)"), found(F.col("details"), r"waited (\d+) ticks")
    section = is_("ARRIVED_SECTION") & (F.coalesce("details", F.lit("")) != "")
    joined, used = is_("JOINED_QUEUE") & place.isNotNull(), is_("ENTERED_FITTING") & wait.isNotNull()
    visit = F.array_sort(F.collect_list(F.when(section, F.struct("seq", F.col("details").alias("v")))))
    g = video.groupBy("day", "shopper_id").agg(
        last(found(F.col("details"), r"gender~(\w+)"), entered).alias("gender"), last(found(F.col("details"), r"age~(\w+)"), entered).alias("age_group"),
        last(F.col("timestamp"), entered).alias("entry_time"), last(F.col("timestamp"), is_("EXITED")).alias("exit_time"),
        F.array_distinct(F.transform(visit, lambda x: x["v"])).alias("sections"),
        F.count_if(is_("BROWSING")).alias("browsing_min"), seen("ARRIVED_FITTING_AREA").alias("approached_fitting"),
        seen("ENTERED_FITTING").alias("used_fitting_room"), last(wait.cast("int"), used).alias("fitting_wait_min"), seen("GAVE_UP_FITTING").alias("gave_up_fitting"),
        seen("JOINED_QUEUE").alias("joined_queue"), F.min_by(place.cast("int"), F.when(joined, F.col("seq"))).alias("initial_queue_position"),
        F.count_if(is_("IN_QUEUE")).alias("queue_wait_min"), seen("ABANDONED_QUEUE").alias("abandoned_queue"),
        seen("REACHED_COUNTER").alias("reached_counter"), seen("CHECKOUT_COMPLETED").alias("purchased"),
    )
    return g.select(
        "day", "shopper_id", "gender", "age_group", "entry_time", "exit_time",
        (minutes(F.col("exit_time")) - minutes(F.col("entry_time"))).alias("dwell_min"),
        F.array_join("sections", ";").alias("sections_visited"), F.size("sections").alias("n_sections"), F.col("browsing_min").cast("int").alias("browsing_min"),
        "approached_fitting", "used_fitting_room", "fitting_wait_min", "gave_up_fitting", "joined_queue", "initial_queue_position",
        F.col("queue_wait_min").cast("int").alias("queue_wait_min"), "abandoned_queue", "reached_counter", "purchased", funnel_stage().alias("funnel_stage"),
    )


def funnel_stage() -> Column:
    """How far a visit came; the order of the tests is part of the meaning."""
    tests = ("purchased", "reached_counter", "joined_queue", "abandoned_queue", "used_fitting_room", "gave_up_fitting", "approached_fitting")
    stage = F.when(F.col(tests[0]), STAGES[0])
    for t, s in zip(tests[1:], STAGES[1:]):
        stage = stage.when(F.col(t), s)
    return stage.when(F.size("sections") > 0, "browsed").otherwise("entered_only")


def summary_order(summary: DataFrame) -> DataFrame:
    return summary.orderBy(weekday(F.col("day")), F.col("shopper_id").cast("int"))


def funnel(summary: DataFrame) -> DataFrame:
    """(funnel_stage, n, pct)."""
    n = summary.groupBy("funnel_stage").agg(F.count("*").alias("n"))
    return n.select("funnel_stage", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2).alias("pct"))


def conversion(summary: DataFrame, *dims: str) -> DataFrame:
    """Visitors, purchases and conversion by every grouping of day and ``dims`` (a cube when given)."""
    g = summary.cube("day", *dims) if dims else summary.groupBy("day")
    out = g.agg(F.count("*").alias("visitors"), F.count_if("purchased").alias("purchases"))
    return out.withColumn("conversion", F.round(F.col("purchases") * 100.0 / F.col("visitors"), 2))


def week_conversion(summary: DataFrame) -> DataFrame:
    """``conversion`` by day for all seven days, in order; days without visits have nulls."""
    spark = summary.sparkSession
    days = spark.createDataFrame(list(enumerate(WEEK)), "place int, day string")
    return days.join(conversion(summary), "day", "left").orderBy("place").drop("place")


def action_histogram(log: DataFrame) -> DataFrame:
    return log.groupBy("action").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "action")


def journey(log: DataFrame, marker: str) -> DataFrame:
    """All rows of the first visit whose ENTERED details hold ``marker``, in order."""
    first = log.where((F.col("action") == "ENTERED") & F.col("details").contains(marker)).orderBy("seq").limit(1).select("day", "shopper_id")
    return log.join(F.broadcast(first), ["day", "shopper_id"]).orderBy("seq")  # one row
