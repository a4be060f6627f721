import pickle

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.streaming import events as E
from tidemark.streaming import online as N

SCHEMA = "camera string, t double, raw_id long, x double, y double, h double, look array<double>"


def finish(writer):
    q = writer.trigger(availableNow=True).start()
    if not q.awaitTermination(60):
        q.stop()
        raise TimeoutError


def detections():
    rng, rows = np.random.default_rng(11), []
    for cam in ("a", "b"):
        for person in range(4):
            raw, t = person * 10, person * 3.0
            look = [1.0 if k == person else 0.0 for k in range(4)]
            for _ in range(3):
                for _ in range(10):
                    rows.append((cam, round(t, 3), raw, 50.0 * person + t, 100.0, 120.0, look))
                    t += 0.25
                t += float(rng.uniform(0.8, 3.0))
                raw += 1
    return rows


def test_stitching_finds_who_came_back():
    rows = pd.DataFrame([r for r in detections() if r[0] == "a"], columns=["camera", "t", "raw_id", "x", "y", "h", "look"])
    out = N.stitch_rows(rows, N.OnlineStitcher(), flush=True)
    merges = {e[2]: e[3] for e in out if e[0] == "merge"}
    assert merges == {p * 10 + k: p * 10 for p in range(4) for k in (1, 2)}
    assert len([e for e in out if e[0] == "row"]) == len(rows)


def test_an_end_is_worked_out_once(monkeypatch):
    """200 people leave, others come and go: what an end tells is not asked again for each newcomer."""
    calls, own = [], N.Track.end
    monkeypatch.setattr(N.Track, "end", lambda self: calls.append(1) or own(self))
    rows = [("a", 0.001 * k, k, 1000.0 * k, 0.0, 120.0, [1.0]) for k in range(200)]
    rows += [("a", 1.0 + 0.03 * k, 1000 + k, -1e6 - 1000.0 * k, 0.0, 120.0, [1.0]) for k in range(200)]
    out = N.stitch_rows(pd.DataFrame(rows, columns=["camera", "t", "raw_id", "x", "y", "h", "look"]), N.OnlineStitcher(), flush=True)
    assert len(out) == 400 and len(calls) <= 400


def test_who_comes_and_goes_alike_is_compared_once(monkeypatch):
    """Ends and newcomers in a hundred copies and one more place: a few costs, and each newcomer takes the first end left."""
    sizes, own = [], N.OpenEnds.costs

    def costs(*a):
        out = own(*a)
        sizes.extend(map(np.size, out))
        return out

    monkeypatch.setattr(N.OpenEnds, "costs", costs)
    rows = [("a", 0.0, k, 0.0 if k % 4 else 9.0, 0.0, 120.0, [1.0]) for k in range(100)]
    rows += [("a", 1.0, 1000 + k, 1.0, 0.0, 120.0, [1.0]) for k in range(100)]
    out = N.stitch_rows(pd.DataFrame(rows, columns=["camera", "t", "raw_id", "x", "y", "h", "look"]), N.OnlineStitcher(), flush=True)
    order = [k for k in range(100) if k % 4] + list(range(0, 100, 4))
    assert [e[2:4] for e in out if e[0] == "merge"] == [(1000 + k, end) for k, end in enumerate(order)]
    assert max(sizes) <= 100


def test_a_state_read_back_goes_on_alike():
    rows = pd.DataFrame([r for r in detections() if r[0] == "a"], columns=["camera", "t", "raw_id", "x", "y", "h", "look"]).sort_values("t", kind="stable")
    s, out = N.OnlineStitcher(), []
    for _, own in rows.groupby("t"):
        s = pickle.loads(pickle.dumps(s))
        out += N.stitch_rows(own, s)
    assert out == N.stitch_rows(rows, N.OnlineStitcher()) and len(out) > 50


def test_stream_and_batch_agree(spark, tmp_path):
    rows = sorted(detections(), key=lambda r: r[1])
    whole = spark.createDataFrame(rows, SCHEMA)
    for k in range(0, len(rows), 60):  # files in time order, one a trigger
        spark.createDataFrame(rows[k : k + 60], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = E.read_files(spark, str(tmp_path / "in"), whole.schema, files_per_trigger=1)
    out = N.stitch_stream(stream, idle_ms=None).writeStream.format("memory").queryName("stitched")
    finish(out.option("checkpointLocation", str(tmp_path / "state")))
    key = ["camera", "kind", "t", "raw_id", "visitor"]
    got = spark.table("stitched").select(*key)
    want = N.stitch_batch(whole).select(*key)
    assert got.exceptAll(want).count() == 0 and got.count() > 0.8 * want.count()  # the rest is held for the flush


def test_throttle_in_stream_and_table(spark, tmp_path):
    rows = [("a", float(k)) for k in range(10)] + [("b", 3.0)]
    df = spark.createDataFrame(rows, "key string, t double")
    want = {("a", 0.0), ("a", 4.0), ("a", 8.0), ("b", 3.0)}
    assert {tuple(r) for r in E.throttle(df, "key", "t", 4.0).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    finish(E.throttle(E.read_files(spark, str(tmp_path / "in"), df.schema), "key", "t", 4.0).writeStream.format("memory").queryName("thin"))
    assert {tuple(r) for r in spark.table("thin").collect()} == want


def test_a_gap_of_exactly_the_session_joins(spark):
    df = spark.createDataFrame([(1, 0), (1, 10), (1, 21)], "u int, s long").select("u", F.timestamp_seconds("s").alias("ts"))
    assert sorted(r.n for r in E.sessions(df, ["u"], "ts", "10 seconds").collect()) == [1, 2]


def test_rate_view_and_polling(spark):
    f = spark.createDataFrame([(k / 5, k % 2, k) for k in range(101)], "t double, visitor int, seq int")
    assert round(E.achieved_rate(f, "t", 20.0).collect()[0].fps, 6) == 5.0
    assert E.achieved_rate(f.limit(1), "t", 0.0).collect()[0].fps is None
    assert [r.seq for r in E.since(f, 10, 3).collect()] == [11, 12, 13] and E.newest(f, 5).count() == 5
    assert E.in_view(f.where("t < 1 or visitor = 1"), 20.0).count() == 1


def test_log_and_fan_out(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, type string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = E.read_files(spark, str(tmp_path / "in"), df.schema)
    q = E.append_log(stream, str(tmp_path / "log"), str(tmp_path / "s1"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    seen = []
    q = E.fan_out(stream, str(tmp_path / "s2"), lambda b, k: seen.append(b.count()), lambda b, k: seen.append(-b.count()))
    q.processAllAvailable()
    q.stop()
    assert seen == [2, -2]
