import random

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.operators import joins as J
from tests.test_queries import DATA


def test_overlaps_of_many_equal_intervals_are_all_pairs(spark):
    rng = random.Random(5)
    spans = [(rng.randrange(2), s := rng.randrange(60), s + rng.choice([0, 1, 2, 3, 9, 40])) for _ in range(40)] + [(0, 7, 12)] * (J.PACK + 20)
    a = [(g, s, e, k) for k, (g, s, e) in enumerate(spans[:45])] + [(0, 7, 12, 44), (None, 7, 12, 98), (0, None, 12, 99)]
    b = [(g, s, e, k) for k, (g, s, e) in enumerate(spans)] + [(0, 12, 7, 98), (None, 7, 12, 99)]
    side = lambda rows, x: spark.createDataFrame(rows, f"g int, {x}0 long, {x}1 long, {x} int")
    got = J.overlap_join(side(a, "a"), side(b, "b"), "a0", "a1", "b0", "b1", 2, 5, ["g"])
    assert got.columns == ["g", "a0", "a1", "a", "b0", "b1", "b"]
    want = [(*x, *y[1:]) for x in a for y in b if None not in (*x, *y) and x[0] == y[0] and min(x[2], y[2]) - max(x[1], y[1]) >= 2]
    assert len(want) > 1000 and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_overlap_pairs_of_copies_take_few_bytes_and_lose_none(spark, tmp_path):
    con, d = duckdb.connect(), tmp_path / "copies"
    d.mkdir()
    con.execute(f"""copy (select event_id + k * 1000 as event_id, ts, user_id + k * 15 as user_id, event_type, value, props
        from '{DATA}/events.parquet', (select unnest(range(60)) as k)) to '{d}/events.parquet'""")
    entry.queries()["interval_overlap_pairs"](spark, str(d)).write.parquet(str(tmp_path / "out"))
    con.execute(f"create view events as select * from '{d}/events.parquet'")
    con.execute(f"create view got as select * from '{tmp_path}/out/*.parquet'")
    whole = "select count(*), sum(hash(a_vid, a_run, b_vid, b_run, overlap)::hugeint) from ({})"
    found = con.sql(whole.format("from got")).fetchall()
    assert found == con.sql(whole.format(entry.oracle_sql()["interval_overlap_pairs"])).fetchall()
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert found[0][0] > 300_000 and size < 0.8 * found[0][0], size / found[0][0]


def test_overlap_pairs_of_any_two_visitors(spark, tmp_path):
    """Not only of visitors whose ids leave the same remainder."""
    con = duckdb.connect()
    con.execute(f"""copy (select u * 10 + h as event_id, timestamp '2024-01-01' + to_hours(u * 2 + h * 4) as ts, u as user_id, 'view' as event_type, 1.0 as value, '{{"k": 1}}' as props
        from (select unnest(range(6)) as u), (select unnest(range(2)) as h)) to '{tmp_path}/events.parquet'""")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = [(a, 0, a + 1, 0, 2 * 3_600_000_000) for a in range(5)]
    assert sorted(map(tuple, entry.queries()["interval_overlap_pairs"](spark, str(tmp_path)).collect())) == want
    assert sorted(con.sql(entry.oracle_sql()["interval_overlap_pairs"]).fetchall()) == want
