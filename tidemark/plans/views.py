"""How the engine's inputs are made from the driver's tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.visits import Zone

HOUR = 3_600_000_000  # microseconds
MAX_GAP = 12 * HOUR

ZONES = [
    Zone("door", ((-1.0, -1.0), (5.0, -1.0), (5.0, 101.0), (-1.0, 101.0)), "entrance"),
    Zone("line", ((5.0, -1.0), (20.0, -1.0), (20.0, 101.0), (5.0, 101.0)), "queue"),
    Zone("till", ((100.0, -1.0), (1000.0, -1.0), (1000.0, 101.0), (100.0, 101.0)), "counter"),
    Zone("nook", ((20.0, 10.0), (60.0, 10.0), (60.0, 90.0), (40.0, 50.0), (20.0, 90.0)), ""),
]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def micros(ts) -> object:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def trail(spark: SparkSession, d: str) -> DataFrame:
    """(vid, event_id, t, x, y, kind) from events; t in microseconds."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("vid"), "event_id", micros(F.col("ts")).alias("t"), F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"), F.col("event_type").alias("kind"),
    )


TRAIL = """trail as (
  select user_id as vid, event_id, epoch_us(ts) as t, value as x, cast(json_extract_string(props, '$.k') as double) as y, event_type as kind from events
)"""


def raw_log(spark: SparkSession, d: str) -> DataFrame:
    """A visit log (day, seq, timestamp, shopper_id, action, row, col, details) from events."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").select("*", k.alias("k"))
    t, k = F.col("event_type"), F.col("k")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), k % n + 1)
    action = (
        F.when(t == "signup", "ENTERED").when(t == "view", pick(4, "BROWSING", "NO_PICK", "MOVING", "HEADING"))
        .when(t == "click", pick(3, "ARRIVED_SECTION", "ARRIVED_FITTING_AREA", "ENTERED_FITTING"))
        .when(t == "error", pick(4, "JOINED_QUEUE", "ABANDONED_QUEUE", "IN_QUEUE", "GAVE_UP_FITTING")).otherwise(pick(3, "PURCHASED", "EXITED", "CHECKOUT_CALLED"))
    )
    a = F.col("action")
    details = (
        F.when(a == "ENTERED", F.concat(F.lit("profile=p gender="), pick(2, "female", "male"), F.lit(" age="), pick(3, "young", "adult", "senior"), F.lit(" plan=[A]")))
        .when(a == "ENTERED_FITTING", F.concat(F.lit("2 item(s) to try on, waited "), k % 5, F.lit(" ticks")))
        .when(a == "JOINED_QUEUE", F.concat(F.lit("position #"), k % 6 + 1, F.lit(", 2 item(s)")))
        .when(a == "ABANDONED_QUEUE", F.concat(F.lit("position #"), k % 6 + 1, F.lit(", left 1 item(s)")))
        .when(a == "ARRIVED_FITTING_AREA", "1 item(s)").when(a == "PURCHASED", "1 item(s): S1").when(a.isin("EXITED", "CHECKOUT_CALLED"), "")
        .otherwise(F.concat(F.lit("S"), k % 7))
    )
    return e.withColumn("action", action).select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("seq"), F.date_format("ts", "HH:mm").alias("timestamp"),
        F.col("user_id").alias("shopper_id"), "action", F.lit("a").alias("row"), (k % 14 + 1).alias("col"), details.alias("details"),
    )


RAW_LOG = """keyed as (
  select *, cast(json_extract_string(props, '$.k') as integer) as k from events
), acted as (
  select *, case event_type when 'signup' then 'ENTERED'
    when 'view' then ['BROWSING', 'NO_PICK', 'MOVING', 'HEADING'][k % 4 + 1]
    when 'click' then ['ARRIVED_SECTION', 'ARRIVED_FITTING_AREA', 'ENTERED_FITTING'][k % 3 + 1]
    when 'error' then ['JOINED_QUEUE', 'ABANDONED_QUEUE', 'IN_QUEUE', 'GAVE_UP_FITTING'][k % 4 + 1]
    else ['PURCHASED', 'EXITED', 'CHECKOUT_CALLED'][k % 3 + 1] end as action from keyed
), raw_log as (
  select strftime(ts, '%Y-%m-%d') as day, event_id as seq, strftime(ts, '%H:%M') as "timestamp", user_id as shopper_id, action, 'a' as "row", k % 14 + 1 as col,
    case action when 'ENTERED' then 'profile=p gender=' || ['female', 'male'][k % 2 + 1] || ' age=' || ['young', 'adult', 'senior'][k % 3 + 1] || ' plan=[A]'
      when 'ENTERED_FITTING' then '2 item(s) to try on, waited ' || (k % 5) || ' ticks'
      when 'JOINED_QUEUE' then 'position #' || (k % 6 + 1) || ', 2 item(s)'
      when 'ABANDONED_QUEUE' then 'position #' || (k % 6 + 1) || ', left 1 item(s)'
      when 'ARRIVED_FITTING_AREA' then '1 item(s)' when 'PURCHASED' then '1 item(s): S1' when 'EXITED' then '' when 'CHECKOUT_CALLED' then ''
      else 'S' || (k % 7) end as details from acted
)"""

VIDEO_LOG = f"""{RAW_LOG}, video_log as (
  select day, seq, "timestamp", shopper_id,
    case when action in ('NO_PICK', 'PICKED_ITEM', 'PUT_BACK_SHELF') then 'BROWSING' when action = 'CHECKOUT_CALLED' then 'REACHED_COUNTER'
      when action = 'PURCHASED' then 'CHECKOUT_COMPLETED' else action end as action, "row", col,
    case when action in ('MOVING', 'PAUSED', 'AT_CHECKOUT', 'ARRIVED_FITTING_AREA', 'LEFT_FITTING', 'CHECKOUT_CALLED', 'PURCHASED') then ''
      when action = 'ENTERED' then replace(replace(regexp_extract(details, 'gender=\\w+ age=\\w+'), 'gender=', 'gender~'), 'age=', 'age~')
      when action in ('JOINED_QUEUE', 'ABANDONED_QUEUE') then regexp_extract(details, 'position #[0-9]+')
      when action = 'ENTERED_FITTING' then regexp_extract(details, 'waited [0-9]+ ticks') else details end as details
  from raw_log where action not in ('HEADING', 'IN_FITTING')
)"""

SUMMARY = f"""{VIDEO_LOG}, sections as (
  select day, shopper_id, string_agg(details, ';' order by seq) as sections_visited, count(*) as n_sections from (
    select day, shopper_id, details, min(seq) as seq from video_log where action = 'ARRIVED_SECTION' and details <> '' group by all
  ) group by all
), folded as (
  select day, shopper_id,
    arg_max(nullif(regexp_extract(details, 'gender~(\\w+)', 1), ''), seq) filter (action = 'ENTERED') as gender,
    arg_max(nullif(regexp_extract(details, 'age~(\\w+)', 1), ''), seq) filter (action = 'ENTERED') as age_group,
    arg_max("timestamp", seq) filter (action = 'ENTERED') as entry_time, arg_max("timestamp", seq) filter (action = 'EXITED') as exit_time,
    count(*) filter (action = 'BROWSING') as browsing_min, count(*) filter (action = 'IN_QUEUE') as queue_wait_min,
    bool_or(action = 'ARRIVED_FITTING_AREA') as approached_fitting, bool_or(action = 'ENTERED_FITTING') as used_fitting_room,
    arg_max(cast(nullif(regexp_extract(details, 'waited ([0-9]+) ticks', 1), '') as integer), seq) filter (action = 'ENTERED_FITTING') as fitting_wait_min,
    bool_or(action = 'GAVE_UP_FITTING') as gave_up_fitting, bool_or(action = 'JOINED_QUEUE') as joined_queue,
    arg_min(cast(nullif(regexp_extract(details, 'position #([0-9]+)', 1), '') as integer), seq) filter (action = 'JOINED_QUEUE') as initial_queue_position,
    bool_or(action = 'ABANDONED_QUEUE') as abandoned_queue, bool_or(action = 'REACHED_COUNTER') as reached_counter, bool_or(action = 'CHECKOUT_COMPLETED') as purchased
  from video_log group by day, shopper_id
), summary as (
  select day, shopper_id, gender, age_group, entry_time, exit_time,
    cast(split_part(exit_time, ':', 1) as integer) * 60 + cast(split_part(exit_time, ':', 2) as integer)
      - cast(split_part(entry_time, ':', 1) as integer) * 60 - cast(split_part(entry_time, ':', 2) as integer) as dwell_min,
    coalesce(sections_visited, '') as sections_visited, cast(coalesce(n_sections, 0) as integer) as n_sections, cast(browsing_min as integer) as browsing_min,
    approached_fitting, used_fitting_room, fitting_wait_min, gave_up_fitting, joined_queue, initial_queue_position, cast(queue_wait_min as integer) as queue_wait_min,
    abandoned_queue, reached_counter, purchased,
    case when purchased then 'purchased' when reached_counter then 'at_counter' when joined_queue then 'queued' when abandoned_queue then 'abandoned_queue'
      when used_fitting_room then 'used_fitting' when gave_up_fitting then 'gave_up_fitting' when approached_fitting then 'approached_fitting'
      when n_sections > 0 then 'browsed' else 'entered_only' end as funnel_stage
  from folded left join sections using (day, shopper_id)
)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """(frame, id, x1, y1, x2, y2, score, label) from embeddings: ten boxes a frame."""
    e = F.col("embedding")
    v = lambda k: e[k].cast("double")
    x, y = (v(0) + 1) * 100, (v(1) + 1) * 100
    return table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 10).alias("frame"), F.col("vec_id").alias("id"), x.alias("x1"), y.alias("y1"),
        (x + 40 + v(2) * 20).alias("x2"), (y + 60 + v(3) * 20).alias("y2"), F.round(F.least(F.abs(v(4)) * 4, F.lit(1.0)), 6).alias("score"), "label",
    )


BOXES = """boxes as (
  select vec_id // 10 as frame, vec_id as id, x as x1, y as y1, x + 40 + cast(embedding[3] as double) * 20 as x2, y + 60 + cast(embedding[4] as double) * 20 as y2,
    round(least(abs(cast(embedding[5] as double)) * 4, 1.0), 6) as score, label
  from (select *, (cast(embedding[1] as double) + 1) * 100 as x, (cast(embedding[2] as double) + 1) * 100 as y from embeddings)
)"""


def looks(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, torso, legs): halves of the absolute embedding, each of unit mass."""
    from tidemark.functions.vectors import unit_mass

    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), "label", unit_mass(F.slice(e, 1, 32)).alias("torso"), unit_mass(F.slice(e, 33, 32)).alias("legs"))


LOOKS = """looks as (
  select vec_id as id, label,
    list_transform(embedding[1:32], lambda x: abs(cast(x as double)) / list_sum(list_transform(embedding[1:32], lambda z: abs(cast(z as double))))) as torso,
    list_transform(embedding[33:64], lambda x: abs(cast(x as double)) / list_sum(list_transform(embedding[33:64], lambda z: abs(cast(z as double))))) as legs
  from embeddings
)"""
