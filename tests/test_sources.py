import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators.calibration import accuracy, errors, fit_cameras, landmark_pairs
from tidemark.sources import files as S


def test_tracks_of_an_old_file_get_defaults(spark, tmp_path):
    (tmp_path / "v_tracks.csv").write_text("frame,time_s,track_id,conf,x1,person\n1,0.5,7,0.9,10.0,\n2,0.6,,bad,11.0,\n")
    got = S.read_tracks(spark, str(tmp_path / "v_tracks.csv")).orderBy("frame").collect()
    assert (got[0].raw_id, got[0].foot_src, got[0].keypoints) == (7, "box", None) and got[1].conf is None and len(got[0]) == 17


def test_log_order_and_empty_details(spark, tmp_path):
    (tmp_path / "log.csv").write_text("timestamp,shopper_id,action,row,col,details\n10:00,1,ENTERED,a,1,\n10:01,1,EXITED,b,2,x\n")
    got = S.read_log(spark, str(tmp_path / "log.csv")).orderBy("seq").collect()
    assert [(r.action, r.details, r.day) for r in got] == [("ENTERED", "", None), ("EXITED", "x", None)]


def test_held_objects_only(spark, tmp_path):
    (tmp_path / "o.csv").write_text("frame,label,person_id\n1,bag,3\n2,bag,\n")
    assert [r.person_id for r in S.read_held(spark, str(tmp_path / "o.csv")).collect()] == [3]


def test_zones_default_and_are_checked(spark, tmp_path):
    doc = {"map": "m", "zones": [{"id": "a", "role": "queue", "pts": [[0, 0], [1, 0], [1, 1]]}, {"id": "b", "name": "B", "role": "odd", "pts": [[0, 0], [1, 0]]}]}
    (tmp_path / "z.json").write_text(json.dumps(doc, indent=1))
    got = S.check_zones(S.read_zones(spark, str(tmp_path / "z.json"))).orderBy("id").collect()
    assert [(r.name, r.role, r.problem) for r in got] == [("a", "queue", None), ("B", "", "fewer than three points")]


def test_scene_cameras_are_fitted_from_landmarks(spark, tmp_path):
    marks = [{"map": [2.0 * x + 1, 3.0 * y], "cams": {"c1": [x, y]} | ({"c2": [y, x]} if k < 3 else {})} for k, (x, y) in enumerate([(0, 0), (10, 0), (10, 10), (0, 10), (4, 6)])]
    (tmp_path / "s.json").write_text(json.dumps({"name": "s", "map": "m", "cameras": [{"video": "c1", "offset_s": 0}], "landmarks": marks}))
    scene = S.read_scene(spark, str(tmp_path / "s.json"))
    pairs = landmark_pairs(scene)
    fitted = fit_cameras(pairs)
    assert {r.camera: r.problem is None for r in fitted.collect()} == {"c1": True, "c2": False}
    assert accuracy(errors(pairs, fitted)).collect()[0].worst == pytest.approx(0, abs=0.01)
    assert S.check_scene(scene).collect()[0].problem == "fewer than two cameras"


def test_fixtures_have_a_box(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"fixtures": [{"id": "a", "name": "A", "kind": "rail", "pts": [[5, 1], [9, 2], [7, 8]]}]}))
    assert tuple(S.read_fixtures(spark, str(tmp_path / "f.json")).collect()[0].bbox) == (5.0, 1.0, 9.0, 8.0)


def test_newest_best_file(spark, tmp_path):
    (tmp_path / "v_1_tracks.csv").write_text("a")
    (tmp_path / "v_2_tracks.csv").write_text("abc")
    assert S.newest_best(spark, str(tmp_path / "v_*_tracks.csv")).endswith("v_2_tracks.csv")


def test_written_logs_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("Monday", "10:00", 1, "ENTERED", "a", 1, ""), ("Monday", "10:01", 1, "EXITED", "a", 1, "ü, x")], "day string, timestamp string, shopper_id int, action string, row string, col int, details string")
    S.write_csv(rows.coalesce(1), str(tmp_path / "out"))
    assert [tuple(r) for r in S.read_log(spark, str(tmp_path / "out")).orderBy("seq").drop("seq").collect()] == [tuple(r) for r in rows.collect()]


def test_catalogues(spark):
    v = spark.createDataFrame([("a",), ("b",), ("c",)], "video string")
    t = spark.createDataFrame([("b",), ("c",)], "video string")
    c = spark.createDataFrame([("c", "m")], "video string, map string")
    z = spark.createDataFrame([("m", "queue"), ("m", "")], "map string, role string")
    assert [r.video for r in S.list_videos(v, t, c).collect()] == ["c", "b", "a"]
    assert [(r.video, r.n_zones, r.roles) for r in S.list_sources(v, t, c, z).collect()] == [("c", 2, ["queue"])]
    assert S.list_maps(spark.createDataFrame([("a.PNG",), ("b.txt",)], "name string")).count() == 1
    sc = spark.createDataFrame([("s",)], "name string").withColumns({"cameras": F.expr("array(named_struct('video', 'c'), named_struct('video', 'x'))"), "landmarks": F.expr("array(1, 2)")})
    assert [tuple(r) for r in S.list_scenes(sc, c).collect()] == [("s", 2, 2, 1)]


def test_lines_and_rows_of_a_summary(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,note\n1,"two\nlines"\n2,b\n')
    assert S.read_lines(spark, str(tmp_path / "s.csv")).count() == 4 and S.row_count(spark, str(tmp_path / "s.csv")) == 2


def test_ids_are_rewritten_beside_the_input(spark, tmp_path):
    tracks = spark.createDataFrame([(1, 0.5), (2, 0.6)], "track_id int, conf double")
    objects = spark.createDataFrame([("bag", 2), ("bag", None)], "label string, person_id int")
    S.rewrite_ids(tracks, objects, spark.createDataFrame([(2, 1)], "old_id int, new_id int"), str(tmp_path / "out"))
    read = lambda x: spark.read.option("header", True).csv(str(tmp_path / "out" / x))
    assert {r.track_id for r in read("tracks").collect()} == {"1"} and {r.person_id for r in read("objects").collect()} == {"1", None}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        S.rewrite_ids(tracks, objects, spark.createDataFrame([(2, 1)], "old_id int, new_id int"), str(tmp_path / "out"))


def test_a_cached_table_is_made_once_a_file(spark, tmp_path):
    file, made = tmp_path / "v.mp4", []
    build = lambda: made.append(1) or spark.range(len(made))
    file.write_text("a")
    first = S.cached(spark, str(file), str(tmp_path / "cache"), build).count()
    again = S.cached(spark, str(file), str(tmp_path / "cache"), build).count()
    file.write_text("ab")
    assert (first, again, S.cached(spark, str(file), str(tmp_path / "cache"), build).count(), len(made)) == (1, 1, 2, 2)
