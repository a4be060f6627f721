"""Queries over the visit log made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import eventlog as L
from tidemark.plans import views as V
from tidemark.plans.registry import query

_FLAGS = ("approached_fitting", "used_fitting_room", "gave_up_fitting", "joined_queue", "abandoned_queue", "reached_counter", "purchased")


@query(f"with {V.VIDEO_LOG} select * from video_log")
def video_log(spark: SparkSession, d: str) -> DataFrame:
    return L.video_log(V.raw_log(spark, d))


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return L.shopper_summary(video_log(spark, d))


@query(f"with {V.SUMMARY} select * from summary")
def shopper_summary(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d)


@query(f"with {V.SUMMARY} select funnel_stage, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 2) as pct from summary group by 1")
def funnel_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.funnel(_summary(spark, d))


@query(f"""with {V.SUMMARY} select day, count(*) as visitors, count(*) filter (purchased) as purchases,
  round(count(*) filter (purchased) * 100.0 / count(*), 2) as conversion from summary group by day""")
def day_conversion(spark: SparkSession, d: str) -> DataFrame:
    return L.conversion(_summary(spark, d))


@query(f"""with {V.SUMMARY}, named as (select * replace (dayname(cast(day as date)) as day) from summary), days as (
  select unnest(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']) as day
) select day, count(shopper_id) as visitors, count(*) filter (purchased) as purchases,
  round(count(*) filter (purchased) * 100.0 / count(shopper_id), 2) as conversion from days left join named using (day) group by day""")
def week_conversion(spark: SparkSession, d: str) -> DataFrame:
    return L.week_conversion(_summary(spark, d).withColumn("day", F.date_format(F.to_date("day"), "EEEE")))


@query(f"""with {V.SUMMARY} select day, gender, age_group, count(*) as visitors, count(*) filter (purchased) as purchases,
  round(count(*) filter (purchased) * 100.0 / count(*), 2) as conversion from summary group by cube (day, gender, age_group)""")
def day_conversion_cube(spark: SparkSession, d: str) -> DataFrame:
    return L.conversion(_summary(spark, d), "gender", "age_group")


@query(f"with {V.RAW_LOG} select action, count(*) as n from raw_log group by action")
def action_histogram(spark: SparkSession, d: str) -> DataFrame:
    return L.action_histogram(V.raw_log(spark, d))


@query(f"""with {V.RAW_LOG}, first as (select day, shopper_id from raw_log where action = 'ENTERED' and contains(details, 'age=senior') order by seq limit 1)
select raw_log.* from raw_log join first using (day, shopper_id)""")
def journey(spark: SparkSession, d: str) -> DataFrame:
    return L.journey(V.raw_log(spark, d), "age=senior").select("day", "seq", "timestamp", "shopper_id", "action", "row", "col", "details")


@query("""select event_id, epoch_us(ts) // 60000000 % 100000 as minute, lpad(cast((epoch_us(ts) // 60000000 % 2880) // 60 as varchar), 2, '0') || ':'
  || lpad(cast((epoch_us(ts) // 60000000 % 2880) % 60 as varchar), 2, '0') as clock, epoch_us(ts) // 60000000 % 2880 as back,
  chr(cast(97 + event_id % 8 as integer)) as row_label, cast(14 - event_id % 14 as integer) as col_label, regexp_replace(event_type || ' / ' || user_id, '[^A-Za-z0-9._-]+', '_', 'g') as safe
from events""")
def clock_and_labels(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    m = F.floor(V.micros(F.col("ts")) / F.lit(60_000_000)).cast("long")
    clock = T.clock(m % 2880)
    row, col = T.cell_label((F.col("event_id") % 8).cast("int"), (F.col("event_id") % 14).cast("int"))
    return e.select(
        "event_id", (m % 100000).alias("minute"), clock.alias("clock"), T.minutes(clock).cast("long").alias("back"), row.alias("row_label"), col.alias("col_label"),
        T.safe_name(F.concat(F.col("event_type"), F.lit(" / "), F.col("user_id"))).alias("safe"))


@query(f"""with {V.SUMMARY} select day, shopper_id, row_number() over (order by
  coalesce(nullif(list_position(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'], dayname(cast(day as date))), 0) - 1, 99), shopper_id, day) as place
from summary qualify place <= 50""")
def summary_order(spark: SparkSession, d: str) -> DataFrame:
    s = _summary(spark, d).withColumn("w", T.weekday(F.date_format(F.to_date("day"), "EEEE")))
    top = s.orderBy("w", "shopper_id", "day").limit(50)  # the report shows fifty
    from pyspark.sql import Window

    return top.select("day", "shopper_id", F.row_number().over(Window.orderBy("w", "shopper_id", "day")).cast("long").alias("place"))


@query(f"""with {V.RAW_LOG} select day, count(*) as rows, count(distinct shopper_id) as shoppers, count(distinct shopper_id) filter (action = 'PURCHASED') as purchasers from raw_log group by day""")
def closing_stats(spark: SparkSession, d: str) -> DataFrame:
    return V.raw_log(spark, d).groupBy("day").agg(
        F.count("*").alias("rows"), F.count_distinct("shopper_id").alias("shoppers"),
        F.count_distinct(F.when(F.col("action") == "PURCHASED", F.col("shopper_id"))).alias("purchasers"))


@query()
def simulated_week(spark: SparkSession, d: str) -> DataFrame:
    """A simulated week's summary; random by seed, so no SQL says the same."""
    from tidemark.operators.simulation import simulate

    days = [(day, 40 + k, 0.20 + 0.02 * k) for k, day in enumerate(T.WEEK)]
    return L.summary_order(L.shopper_summary(L.video_log(simulate(spark, days))))


@query("""select user_id, event_type, value, count(*) over w as n, round(avg(value) over w, 6) as mean from events
  window w as (partition by user_id, event_type)""")
def union_of_days(spark: SparkSession, d: str) -> DataFrame:
    """Day logs taken apart and put together again by a union of all."""
    from functools import reduce

    from pyspark.sql import Window

    e = V.table(spark, d, "events")
    days = [e.where(F.dayofweek("ts") == k) for k in range(1, 8)]
    w = Window.partitionBy("user_id", "event_type")
    return reduce(DataFrame.unionByName, days).select("user_id", "event_type", "value", F.count("*").over(w).alias("n"), F.round(F.avg("value").over(w), 6).alias("mean"))
