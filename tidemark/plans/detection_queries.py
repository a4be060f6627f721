"""Queries over rows of detections and the simulator's visitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import detections as D
from tidemark.operators import objects as O
from tidemark.operators import simulation as S
from tidemark.plans import views as V
from tidemark.plans.registry import query
from tidemark.streaming import events as E

_CLASSES = ["person", "handbag", "suitcase", "cell phone", "bottle"]
_NAMED = "named as (select *, ['person', 'handbag', 'suitcase', 'cell phone', 'bottle'][label % 5 + 1] as class from boxes)"


def _named(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in _CLASSES])
    return V.boxes(spark, d).withColumn("class", F.get(names, (F.col("label") % 5).cast("int")))


@query(f"""with {V.BOXES} select id, round(score, 3) as score, round(x1, 1) as x1, round(y1, 1) as y1, round(x2, 1) as x2, round(y2, 1) as y2,
  round(x1 + (x2 - x1) / 2, 1) as cx, round(y1 + (y2 - y1) / 2, 1) as cy, round(x2 - x1, 1) as w, round(y2 - y1, 1) as h from boxes""")
def box_rows(spark: SparkSession, d: str) -> DataFrame:
    return D.box_rows(V.boxes(spark, d)).select("id", "score", "x1", "y1", "x2", "y2", "cx", "cy", "w", "h")


@query(f"with {V.BOXES}, {_NAMED} select frame, id, class, score from named where class in ('cell phone', 'handbag') and score >= 0.3")
def wanted_objects(spark: SparkSession, d: str) -> DataFrame:
    return D.of_classes(_named(spark, d), ["Phone", "purse", "unicorn"], _CLASSES, 0.3, "class").select("frame", "id", "class", "score")


@query(f"with {V.BOXES} select frame, id from boxes where frame >= 3 and (frame - 3) % 4 = 0")
def strided_frames(spark: SparkSession, d: str) -> DataFrame:
    return D.every(V.boxes(spark, d), D.auto_stride(F.lit(25.0)), 3).select("frame", "id")


@query(f"with {V.BOXES} select frame, id from boxes where frame >= 12 and frame < 32")
def sliced_frames(spark: SparkSession, d: str) -> DataFrame:
    return D.time_slice(V.boxes(spark, d), 0.5, 0.8, 25.0).select("frame", "id")


_HELD = f"{V.BOXES}, {_NAMED}, people as (select frame, id from named where class = 'person' and score >= 0.2), objects as (select frame, id, score, case when id % 3 <> 0 then frame * 10 + id % 7 end as person_id from named where class <> 'person')"


@query(f"with {_HELD} select o.frame, o.id, person_id from objects o where score >= 0.25 and (person_id is null or exists (select 1 from people p where p.frame = o.frame and p.id = person_id))")
def shown_objects(spark: SparkSession, d: str) -> DataFrame:
    n = _named(spark, d)
    people = n.where("class = 'person' and score >= 0.2").select("frame", "id")
    holder = F.when(F.col("id") % 3 != 0, F.col("frame") * 10 + F.col("id") % 7)
    objects = n.where("class <> 'person'").select("frame", "id", "score", holder.alias("person_id"))
    return D.visible_objects(objects, people, 0.25).select("frame", "id", "person_id")


@query(f"with {_HELD}, f as (select distinct frame as t from boxes) select f.t, o.id from f left join (select * from objects where score >= 0.5) o on o.frame = f.t")
def objects_of_frames(spark: SparkSession, d: str) -> DataFrame:
    n = _named(spark, d)
    objects = n.where("class <> 'person' and score >= 0.5").select(F.col("frame").alias("t"), "id")
    return D.frame_objects(n.select(F.col("frame").alias("t")).distinct(), objects)


@query(f"""with {V.TRAIL} select vid, event_id, count(*) over w as n, round(min(x) over w, 6) as x_min, round(max(x) over w, 6) as x_max from trail
window w as (partition by vid order by t range between {6 * V.HOUR} preceding and current row)""")
def trailing_window(spark: SparkSession, d: str) -> DataFrame:
    t = D.trailing(V.trail(spark, d), ["vid"], "t", 6 * V.HOUR, ("n", F.count("*")), ("x_min", F.min("x")), ("x_max", F.max("x")))
    return t.select("vid", "event_id", "n", F.round("x_min", 6).alias("x_min"), F.round("x_max", 6).alias("x_max"))


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc nulls last, o_orderkey limit 100")
def job_list(spark: SparkSession, d: str) -> DataFrame:
    """Orders as jobs: the hundred started last."""
    return D.newest_first(V.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").limit(100)


_PLAIN = " union all ".join(
    f"select '{n}' as profile, {p['speed'][0]} as s0, {p['speed'][1]} as s1, {p['browse'][0]} as b0, {p['browse'][1]} as b1, {p['checkout'][0]} as c0, {p['checkout'][1]} as c1, "
    f"{p['n_sections'][0]} as n0, {p['n_sections'][1]} as n1, {p['pick']}::double as pick, {p['put_back']}::double as put_back, {p['fitting']}::double as fitting, {p['abandon']}::double as abandon, {p['pause']}::double as pause"
    for n, p in S.PROFILES.items()
)


@query(f"""with p as ({_PLAIN}), g as (select unnest(['female', 'male']) as gender), a as (select unnest(['young', 'adult', 'senior']) as age),
x as (select *, case gender when 'female' then 1.25 else 0.8 end as fg, case age when 'senior' then 1.2 else 1.0 end as fa from p, g, a)
select profile, gender, age,
  case age when 'young' then least(3, s0 + 1) when 'senior' then greatest(1, s0 - 1) else s0 end as speed_low, case age when 'young' then least(3, s1 + 1) when 'senior' then greatest(1, s1 - 1) else s1 end as speed_high,
  greatest(1, floor(round(greatest(1, floor(round(b0 * fg, 6))) * fa, 6)))::int as browse_low, greatest(1, floor(round(greatest(1, floor(round(b1 * fg, 6))) * fa, 6)))::int as browse_high,
  greatest(1, floor(round(c0 * case age when 'senior' then 1.4 else 1.0 end, 6)))::int as checkout_low, greatest(1, floor(round(c1 * case age when 'senior' then 1.4 else 1.0 end, 6)))::int as checkout_high,
  case gender when 'male' then greatest(1, n0 - 1) else n0 end as sections_low, case gender when 'male' then greatest(1, n1 - 1) else least(12, n1 + 1) end as sections_high,
  round(least(1, case gender when 'female' then pick * 1.15 else pick end), 6) as pick,
  round(least(1, least(1, case gender when 'male' then put_back * 1.25 else put_back end) * case age when 'young' then 1.2 else 1.0 end), 6) as put_back,
  round(least(1, case gender when 'female' then fitting * 1.3 else fitting * 0.5 end), 6) as fitting,
  round(case age when 'senior' then abandon * 0.5 else abandon end, 6) as abandon, round(case age when 'young' then least(0.5, pause * 2) else pause end, 6) as pause from x""")
def visitor_parameters(spark: SparkSession, d: str) -> DataFrame:
    """What each kind of visitor is simulated with: profile by gender and age."""
    rows = []
    for name, gender, age in ((n, g, a) for n in S.PROFILES for g in S.GENDERS for a in S.AGES):
        p = S.modified(S.PROFILES[name], gender, age)
        ranges = [x for k in ("speed", "browse", "checkout", "n_sections") for x in p[k]]
        rows.append((name, gender, age, *ranges, *[round(float(p[k]), 6) for k in ("pick", "put_back", "fitting", "abandon", "pause")]))
    ends = ", ".join(f"{k}_{e} int" for k in ("speed", "browse", "checkout", "sections") for e in ("low", "high"))
    return spark.createDataFrame(rows, f"profile string, gender string, age string, {ends}, pick double, put_back double, fitting double, abandon double, pause double")


@query(f"""with {_HELD}, d as (select frame, count(*) as people, count_if(id % 2 = 1) as estimated, round(avg(score), 4) as mean_conf from people_of group by frame),
  h as (select frame, count(*) as held from objects where person_id is not null group by frame)
select frame, coalesce(people, 0) as people, coalesce(estimated, 0) as estimated, mean_conf, coalesce(held, 0) as held from d full join h using (frame)""".replace("objects as (", "people_of as (select * from named where class = 'person'), objects as (", 1))
def frame_panel(spark: SparkSession, d: str) -> DataFrame:
    n = _named(spark, d)
    people = n.where("class = 'person'").withColumn("foot_src", F.when(F.col("id") % 2 == 1, "knees").otherwise("box"))
    holder = F.when(F.col("id") % 3 != 0, F.col("frame") * 10 + F.col("id") % 7)
    return O.frame_panel(people, n.where("class <> 'person'").withColumn("person_id", holder), "score")


@query(f"""with {V.BOXES}, {_NAMED}, samples as (select frame as t, class as label, case when id % 3 <> 0 then id % 40 end as person_id from named where class <> 'person')
select case when person_id % 4 = 1 then person_id - 1 else person_id end as person_id, label, count(*) as n, min(t) as first_t, max(t) as last_t
from samples where person_id is not null group by all""")
def late_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects sampled under live ids, of which every fourth was merged into the one before it."""
    held = _named(spark, d).where("class <> 'person'").withColumn("person_id", F.when(F.col("id") % 3 != 0, F.col("id") % 40))
    samples = held.select(F.col("frame").alias("t"), F.col("class").alias("label"), "person_id")
    finals = samples.select(F.col("person_id").alias("old_id")).distinct().where("old_id % 4 = 1").withColumn("new_id", F.col("old_id") - 1)
    return O.attribute_late(samples, finals)


@query("""with b as (select event_id, event_type, ts, time_bucket(interval '1 hour', ts) as hour from events),
  n as (select event_type, hour, max(ts) as newest, count(*) as seen from b group by all)
select event_id, event_type, seen, seen - count(*) over (partition by event_type, hour) as shed from b join n using (event_type, hour) where ts = newest""")
def shed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Each hour stands for a batch that has to keep up."""
    e = V.table(spark, d, "events").select("event_id", "event_type", "ts", F.date_trunc("hour", "ts").alias("hour"))
    return E.latest_only(e, ["event_type", "hour"], "ts").select("event_id", "event_type", "seen", "shed")
