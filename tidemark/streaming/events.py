"""Streams of events and rows: sources, sessions, windows, throttling, logs and polling.

Spark drops what is later than the watermark; the readers here take rate limits, so nothing is shed unless ``latest_only`` is asked to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_trigger: int = 10) -> DataFrame:
    """An unbounded table over a growing folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def event_time(df: DataFrame, t: str, late: str) -> DataFrame:
    """``t`` as a zoned timestamp with a watermark; watermarks need one."""
    return df.withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, late)


def sessions(df: DataFrame, keys: list[str], t: str, gap: str, *aggs) -> DataFrame:
    """Presences: rows of a key no further apart than ``gap`` (a gap of exactly that joins)."""
    g = df.groupBy(*keys, F.session_window(t, gap).alias("s")).agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.count("*").alias("n"), *aggs)
    return g.drop("s")


def counts(df: DataFrame, t: str, width: str, slide: str | None = None, *keys: str) -> DataFrame:
    """Rows by tumbling or sliding window."""
    w = F.window(t, width, slide) if slide else F.window(t, width)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("w_start"), *keys, "n")


def distinct_events(df: DataFrame, *keys: str) -> DataFrame:
    """One row a key within the watermark."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def throttle(df: DataFrame, key: str, t: str, interval: float) -> DataFrame:
    """Rows of a key at least ``interval`` apart, the first one kept; works on streams and tables."""

    def pick(rows: pd.DataFrame, last: float) -> tuple[pd.DataFrame, float]:
        rows, keep = rows.sort_values(t, kind="stable"), []
        for x in rows[t]:
            ok = x >= last + interval
            keep.append(ok)
            last = x if ok else last
        return rows[keep], last

    if not df.isStreaming:
        return df.groupBy(key).applyInPandas(lambda rows: pick(rows, float("-inf"))[0], df.schema)

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = [b for b in batches if len(b)]
        if own:
            rows, last = pick(pd.concat(own), state.get[0] if state.exists else float("-inf"))
            state.update((float(last),))
            yield rows

    return df.groupBy(key).applyInPandasWithState(run, df.schema, "last double", "append", GroupStateTimeout.NoTimeout)


def latest_only(batch: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Load shedding: of each key the rows of its newest instant, with the rows seen; ``shed`` of them are passed over.

    For a batch of a stream that has to keep up; a lossless reader leaves it out. Rows without ``t`` are shed.
    """
    newest = batch.groupBy(*keys).agg(F.max(t).alias(t), F.count("*").alias("__seen"))
    kept = batch.groupBy(*keys, t).agg(F.count("*").alias("__kept"))
    told = newest.join(kept, [*keys, t]).select(*keys, t, F.col("__seen").alias("seen"), (F.col("__seen") - F.col("__kept")).alias("shed"))
    return batch.join(told, [*keys, t])


def append_log(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only JSONL log, exactly once."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def fan_out(df: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Give every batch to each sink; the batch is computed once."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def since(events: DataFrame, seq: int, n: int) -> DataFrame:
    """The first ``n`` events after ``seq``."""
    return events.where(F.col("seq") > seq).orderBy("seq").limit(n)


def newest(events: DataFrame, n: int = 2000) -> DataFrame:
    """The last ``n`` events: the ring a poller sees."""
    return events.orderBy(F.desc("seq")).limit(n)


def achieved_rate(frames: DataFrame, t: str, now: float, window: float = 10.0) -> DataFrame:
    """(fps) over the last seconds, null with fewer than two frames."""
    g = frames.where((F.col(t) > now - window) & (F.col(t) <= now)).agg(F.count("*").alias("n"), F.min(t).alias("a"), F.max(t).alias("b"))
    return g.select(F.when(F.col("n") >= 2, (F.col("n") - 1) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0))).alias("fps"))


def in_view(rows: DataFrame, now: float, within: float = 3.0) -> DataFrame:
    """(visitor, first, last, visible_s) of visitors seen lately."""
    g = rows.groupBy("visitor").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    return g.where(F.lit(now) - F.col("last") < within).withColumn("visible_s", F.lit(now) - F.col("first"))


class Heartbeat(StreamingQueryListener):
    """Calls back with rows, rate and batch time of every progress report."""

    def __init__(self, tell: Callable[[dict], None]) -> None:
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell({"state": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"state": "running", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rate": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        self.tell({"state": "idle", "id": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        self.tell({"state": "ended", "id": str(event.id)})
