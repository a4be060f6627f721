"""Ordered operators over one series a key: runs, weights, segments, thinning, smoothing, resampling.

All take a long table and keep it long; windows are partitioned by the key, so a series must fit a
task's sort, which spills, but never has to be one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = list[str]

#: How many series of a lane are compared with as many others by one task, and how many steps of pairs at once.
SERIES_A_BLOCK, STEPS_AT_ONCE = 1000, 500_000


def _w(keys: Cols, order: Cols):
    return Window.partitionBy(*keys).orderBy(*order)


def mark_runs(df: DataFrame, keys: Cols, t: str, order: Cols, max_gap, run: str = "run") -> DataFrame:
    """Add a run number from 0: a new run begins where the step from the row before exceeds ``max_gap``."""
    w = _w(keys, order)
    step = F.col(t) - F.lag(t).over(w)
    return df.withColumn(run, F.sum(F.when(step > max_gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def runs(df: DataFrame, keys: Cols, t: str, order: Cols, max_gap, *aggs: Column) -> DataFrame:
    """One row a run: t_start, t_end, n and ``aggs``."""
    marked = mark_runs(df, keys, t, order, max_gap)
    return marked.groupBy(*keys, "run").agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.count("*").alias("n"), *aggs)


def weights(df: DataFrame, keys: Cols, t: str, order: Cols, max_gap, out: str = "w") -> DataFrame:
    """Add what each sample stands for: half of either neighbour's gap, each gap capped; 0 for one alone."""
    w = _w(keys, order)
    half = lambda gap: F.when(gap > max_gap, F.lit(max_gap)).otherwise(F.coalesce(gap, F.lit(0)))
    return df.withColumn(out, (half(F.col(t) - F.lag(t).over(w)) + half(F.lead(t).over(w) - F.col(t))) / 2)


def segments(df: DataFrame, keys: Cols, t: str, order: Cols, flag: Column, max_gap, weight: str = "w", *aggs: Column) -> DataFrame:
    """Runs over the flagged rows alone, with their summed weight: t_start, t_end, n, seconds."""
    return runs(df.where(flag), keys, t, order, max_gap, F.sum(weight).alias("seconds"), *aggs)


def first_of_instant(df: DataFrame, keys: Cols, t: str, order: Cols) -> DataFrame:
    """Of rows of one key and instant the first by ``order``."""
    w = Window.partitionBy(*keys, t).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def long_enough(df: DataFrame, keys: Cols, t: str, least) -> DataFrame:
    """Keys whose samples span ``least`` or more."""
    return df.groupBy(*keys).agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count("*").alias("n")).where(F.col("t1") - F.col("t0") >= least)


def thin(df: DataFrame, keys: Cols, t: str, cols: Cols, step, most: int = 400) -> DataFrame:
    """Keep a key's first row, then each at least a step after the last kept one, and its last row.

    The step grows so that about ``most`` rows are left. One fold over the key's sorted array.
    """
    row = F.struct(t, *cols)
    series = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("s"))
    kind = df.select(row.alias("s")).schema["s"].dataType.simpleString()
    wide = F.greatest(F.lit(step), (F.element_at("s", -1)[t] - F.col("s")[0][t]) / most)

    def keep(acc: Column, x: Column) -> Column:
        ok = acc["last"].isNull() | (x[t] - acc["last"] >= wide)
        return F.struct(F.when(ok, x[t]).otherwise(acc["last"]).alias("last"), F.when(ok, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(None).cast(df.schema[t].dataType).alias("last"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
    kept = F.aggregate("s", start, keep)["out"]
    last = F.element_at("s", -1)
    closed = F.when(F.element_at(kept, -1) == last, kept).otherwise(F.concat(kept, F.array(last)))
    return series.select(*keys, F.explode(closed).alias("r")).select(*keys, "r.*")


def rolling_median(df: DataFrame, keys: Cols, order: Cols, value: str, half: int, out: str = "med", causal: bool = False) -> DataFrame:
    """Upper median of the rows around (``half`` on either side, or that many before and this one)."""
    w = _w(keys, order).rowsBetween(-half, 0 if causal else half)
    around = F.array_sort(F.collect_list(value).over(w))
    return df.withColumn(out, F.get(around, F.floor(F.size(around) / 2).cast("int")))


def causal_median(df: DataFrame, keys: Cols, t: str, tie: Cols, value: str, back: int, forget: float, out: str = "med") -> DataFrame:
    """Upper median of each row and up to ``back`` rows before it; a key silent for longer than ``forget`` starts anew."""
    order = [t, *tie]
    silent = F.coalesce((F.col(t) - F.lag(t).over(_w(keys, order)) > forget).cast("int"), F.lit(0))
    part = F.sum("__new").over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    parts = df.withColumn("__new", silent).withColumn("__part", part)
    return rolling_median(parts, [*keys, "__part"], order, value, back, out, causal=True).drop("__new", "__part")


def smoothing_window(seconds: float, fps: float) -> int:
    """Frames of the smoothing window, odd; 0 when it would be under 3."""
    n = int(round(seconds * fps)) | 1
    return n if n >= 3 else 0


def dead_band(df: DataFrame, keys: Cols, t: str, x: str, y: str, band: str, array_rows: int | None = None) -> DataFrame:
    """Leaky dead-band: the point stays while the target is within ``band``, else it is drawn to the band's rim.

    Adds sx, sy. A recurrence, so it runs in Arrow batches of whole keys.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t, kind="stable")
        px, py, pb = (pdf[c].to_numpy(float) for c in (x, y, band))
        sx, sy = px.copy(), py.copy()
        for k in range(1, len(px)):
            dx, dy = px[k] - sx[k - 1], py[k] - sy[k - 1]
            d = math.hypot(dx, dy)
            share = 0.0 if d <= pb[k] else (d - pb[k]) / d
            sx[k], sy[k] = sx[k - 1] + dx * share, sy[k - 1] + dy * share
        return pdf.assign(sx=sx, sy=sy)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", sx double, sy double"
    return df.groupBy(*keys).applyInPandas(fold, schema)


def tail_velocity(df: DataFrame, keys: Cols, t: str, x: str, y: str, window) -> DataFrame:
    """Velocity over the last ``window`` of each key: (t1, x1, y1, vx, vy); 0 where the tail is one instant."""
    last = df.groupBy(*keys).agg(F.max(t).alias("t1"))
    tail = df.join(last, keys).where(F.col("t1") - F.col(t) <= window)
    g = tail.groupBy(*keys).agg(
        F.max("t1").alias("t1"), F.min(t).alias("ta"), F.min_by(x, t).alias("xa"), F.min_by(y, t).alias("ya"), F.max_by(x, t).alias("x1"), F.max_by(y, t).alias("y1")
    )
    span = F.nullif(F.col("t1") - F.col("ta"), F.lit(0))
    speed = lambda a, b: F.coalesce((F.col(b) - F.col(a)) / span, F.lit(0.0))
    return g.select(*keys, "t1", "x1", "y1", speed("xa", "x1").alias("vx"), speed("ya", "y1").alias("vy"))


def resample(df: DataFrame, keys: Cols, t: str, values: Cols, step) -> DataFrame:
    """Linear interpolation at whole multiples of ``step`` inside each key's span: (keys, i, values).

    Each pair of neighbouring samples makes the grid points between them, so no join is needed.
    """
    w = _w(keys, [t])
    nxt = {c: F.lead(c).over(w) for c in [t, *values]}
    pairs = df.select(*keys, t, *values, *[v.alias(f"__n_{c}") for c, v in nxt.items()], F.lag(t).over(w).alias("__b"))
    t1 = F.coalesce(F.col(f"__n_{t}"), F.col(t))
    lo = F.ceil(F.col(t) / step).cast("long")
    hi = F.floor(t1 / step).cast("long")
    # a point on a sample belongs to the pair that begins there; the last sample is a pair of its own
    hi = F.when(F.col(f"__n_{t}").isNotNull() & (hi * step == t1), hi - 1).otherwise(hi)
    grid = pairs.where(hi >= lo).withColumn("i", F.explode(F.sequence(lo, hi)))
    share = (F.col("i") * step - F.col(t)) / F.nullif(F.col(f"__n_{t}") - F.col(t), F.lit(0))
    lerp = lambda c: (F.col(c) + F.coalesce((F.col(f"__n_{c}") - F.col(c)) * share, F.lit(0.0))).alias(c)
    return grid.select(*keys, "i", *[lerp(c) for c in values])


def pair_evidence(df: DataFrame, lane: str, key: str, i: str, x: str, within: float, digits: tuple[int, int] = (4, 6)) -> DataFrame:
    """(a, b, steps, d, close) of any two series of a lane that share grid steps, a < b: how many steps, the median
    difference and the share within ``within``, rounded half up to ``digits``. A step without a value counts as shared only.

    Series, not steps, are dealt out: a row each, once for every block of its lane. A task holds two blocks and
    compares whole series, so no pair of steps is ever a row, and no pair is shuffled.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    series = df.groupBy(lane, key).agg(F.array_sort(F.collect_list(F.struct(F.col(i).alias("i"), F.col(x).alias("x")))).alias("s"))
    sizes = series.groupBy(lane).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / SERIES_A_BLOCK)).cast("int").alias("blocks"))
    placed = series.join(sizes, lane).withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    dealt = placed.select(lane, key, F.col("s.i").alias("i"), F.col("s.x").alias("x"), "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        t = t.take(pc.sort_indices(t, [("own", "ascending"), (key, "ascending")])).combine_chunks()
        ids, own, lists = t[key].to_numpy(), t["own"].to_numpy(), t["i"].combine_chunks()
        steps, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(t)), np.diff(lists.offsets.to_numpy()))
        grid, there = np.full((len(t), len(steps)), np.nan), np.zeros((len(t), len(steps)), np.float32)
        grid[row, place] = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        there[row, place] = 1.0
        one = t["lo"][0].as_py() == t["hi"][0].as_py()
        first = 0 if one else int(np.searchsorted(own, own[0], "right"))  # where the second block begins
        for k in range(0, len(t) if one else first, each := max(1, STEPS_AT_ONCE // max(1, len(t) * len(steps)))):
            stop = min(k + each, len(t) if one else first)
            begin = k if one else first
            n = np.rint(there[k:stop] @ there[begin:].T).astype(np.int64)
            if one:
                n = np.triu(n, 1)
            a, b = np.nonzero(n)
            n, a, b = n[a, b], a + k, b + begin
            apart = np.abs(grid[a] - grid[b])
            seen = (~np.isnan(apart)).sum(axis=1)
            close = (apart <= within).sum(axis=1) / np.maximum(seen, 1)
            apart.sort(axis=1)  # what is missing goes last
            every = np.arange(len(a))
            d = 0.5 * apart[every, np.maximum(seen - 1, 0) // 2] + 0.5 * apart[every, np.minimum(seen // 2, len(steps) - 1)]
            none = seen == 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b])), pa.array(n),
                 pa.array(half_up(d, digits[0]), mask=none), pa.array(half_up(close, digits[1]), mask=none)], names=["a", "b", "steps", "d", "close"])

    return dealt.groupBy(lane, "lo", "hi").applyInArrow(compare, f"a {kinds[key]}, b {kinds[key]}, steps long, d double, close double")


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark rounds: half up, by the shortest decimals of each number. Not for negative ones."""
    scaled = x * 10.0**digits
    out = np.floor(scaled + 0.5) / 10.0**digits
    for k in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6 + 1e-15 * scaled):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def occupancy(intervals: DataFrame, start: str, end: str, lo, hi, step) -> DataFrame:
    """(i, n): on each grid step from ``lo`` to ``hi`` how many intervals touch it, empty steps too."""
    n = max(1, int((hi - lo) / step) + 1)
    a = F.greatest(F.lit(0), ((F.col(start) - lo) / step).cast("long"))
    b = F.least(F.lit(n - 1), F.ceil((F.col(end) - lo) / step).cast("long"))
    spark = intervals.sparkSession
    # starts add one and the step after the end takes it away: two rows an interval, however long it is
    turns = intervals.where(b >= a).select(F.explode(F.array(F.struct(a.alias("i"), F.lit(1).alias("d")), F.struct((b + 1).alias("i"), F.lit(-1).alias("d")))).alias("s"))
    turns = turns.groupBy(F.col("s.i").alias("i")).agg(F.sum("s.d").alias("d"))
    grid = spark.range(n).withColumnRenamed("id", "i").join(turns, "i", "left")
    return grid.select("i", F.coalesce(F.sum("d").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("n"))


def sample_instants(t0: Column, t1: Column, n: int, pad: float) -> Column:
    """t0 - pad, n instants spread evenly from t0 to t1, and t1 + pad."""
    inner = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: t0 + (t1 - t0) * k / max(1, n - 1))
    return F.concat(F.array(t0 - pad), inner, F.array(t1 + pad))


def nth_gap(df: DataFrame, keys: Cols, t: str) -> DataFrame:
    """Step between a key's first two instants."""
    w = _w(keys, [t])
    return df.select(*keys, t, F.lead(t).over(w).alias("__n"), F.row_number().over(w).alias("__k")).where("__k = 1").select(*keys, (F.col("__n") - F.col(t)).alias("interval"))
