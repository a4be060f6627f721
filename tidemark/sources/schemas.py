"""Schemas of the engine's inputs, as DDL; text files are never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EVENT_LOG = ("day string, timestamp string, shopper_id int, action string, row string, col int, details string")
TRACKS = ("frame int, time_s double, track_id int, raw_id int, conf double, x1 double, y1 double, x2 double, y2 double, cx double, cy double, "
    "foot_x double, foot_y double, foot_src string, w double, h double, keypoints string")
OBJECTS = ("frame int, time_s double, label string, conf double, x1 double, y1 double, x2 double, y2 double, cx double, cy double, w double, h double, person_id int")
FUSED = ("time_s double, visitor_id int, map_x double, map_y double, n_cams int, cams string")
ACTIONS = ("track_id int, fixture string, t_start double, t_end double, duration_s double, contact string, took_item string, actions string, summary string, confidence string")
ACTION_STEPS = "array<struct<t: double, action: string, item: string>>"
ZONES = ("map string, map_size array<int>, zones array<struct<id: string, name: string, color: string, role: string, pts: array<array<double>>, visible: boolean>>, saved_at string")
CALIBRATION = ("video_id string, map string, map_size array<int>, video_size array<int>, scene string, points array<struct<img: array<double>, map: array<double>>>, "
    "H array<array<double>>, errors_px array<double>, rms_px double, max_px double")
SCENE = ("name string, map string, map_size array<int>, cameras array<struct<video: string, offset_s: double>>, video_sizes map<string, array<int>>, "
    "landmarks array<struct<map: array<double>, cams: map<string, array<double>>>>, saved_at string")
FIXTURES = ("note string, fixtures array<struct<id: string, name: string, kind: string, pts: array<array<double>>>>")
LIVE_EVENT = ("type string, seq long, t double, ts double, frame long, rows array<struct<raw_id: int, track_id: int, time_s: double, foot_x: double, foot_y: double, conf: double>>, "
    "`from` int, `to` int, visitor int, gap_s double, dist_px double, allowed_px double, sim double, cost double, state string")
ROLES = ("entrance", "queue", "counter")


def with_defaults(df: DataFrame, schema: str, **defaults) -> DataFrame:
    """``df`` with all columns of ``schema``: missing ones are null or their default, types are cast softly."""
    cols = []
    for f in StructType.fromDDL(schema):
        c = F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        cols.append((F.coalesce(c, F.lit(defaults[f.name])) if f.name in defaults else c).alias(f.name))
    return df.select(*cols)
