"""Reading and writing the engine's files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.joins import relabel
from tidemark.sources import schemas as S


def read_csv(spark: SparkSession, path: str, schema: str, drop_short: bool = False) -> DataFrame:
    """A CSV with a header, by column name; columns that the file lacks are null, empty text stays empty.

    ``drop_short`` leaves out rows with fewer fields than the header.
    """
    raw = spark.read.option("header", True).option("mode", "DROPMALFORMED" if drop_short else "PERMISSIVE").option("emptyValue", "").option("nullValue", "\u0000").csv(path)
    return S.with_defaults(raw, schema)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): a file's lines as they are, for a summary that is passed on as text."""
    return spark.read.text(path)


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of CSV files with a header each: fields with line breaks count once."""
    return spark.read.option("header", True).option("multiLine", True).csv(path).count()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The event log with ``seq``, the rows' order: by file and place within it."""
    raw = spark.read.option("header", True).option("emptyValue", "").option("nullValue", "\u0000").csv(path)
    placed = raw.withColumn("seq", F.monotonically_increasing_id())
    out = S.with_defaults(placed, S.EVENT_LOG + ", seq bigint", details="")
    return out


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Tracks; an old file without raw_id or foot_src gets the track's id and box."""
    t = read_csv(spark, path, S.TRACKS)
    return t.withColumns({"raw_id": F.coalesce("raw_id", "track_id"), "foot_src": F.coalesce(F.nullif("foot_src", F.lit("")), F.lit("box"))})


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.OBJECTS)


def read_held(spark: SparkSession, path: str) -> DataFrame:
    """Only objects that have a holder."""
    return read_objects(spark, path).where("person_id is not null")


def read_fused(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.FUSED).withColumn("cams", F.transform(F.split("cams", ";"), lambda x: x.try_cast("int")))


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.ACTIONS).withColumn("steps", F.from_json("actions", S.ACTION_STEPS))


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """One row a zone; a name defaults to the id and an unknown role to ''."""
    z = _document(spark, path, S.ZONES).select("map", F.explode("zones").alias("z")).select("map", "z.*")
    role = F.when(F.col("role").isin(*S.ROLES), F.col("role")).otherwise("")
    return z.withColumns({"name": F.coalesce(F.nullif("name", F.lit("")), "id"), "role": role})


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    return _document(spark, path, S.CALIBRATION)


def read_scene(spark: SparkSession, path: str) -> DataFrame:
    return _document(spark, path, S.SCENE)


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """One row a fixture with the box around it."""
    from tidemark.functions.geometry import bounding_box

    f = _document(spark, path, S.FIXTURES).select(F.explode("fixtures").alias("f")).select("f.*")
    return f.withColumn("bbox", bounding_box(F.col("pts")))


def newest_best(spark: SparkSession, pattern: str) -> str | None:
    """Of the files of a glob the largest, the newest on ties."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length", "modificationTime")
    best = files.orderBy(F.desc("length"), F.desc("modificationTime"), "path").limit(1).collect()
    return best[0].path if best else None


def check_zones(zones: DataFrame) -> DataFrame:
    """Zones with ``problem``: null where the shape and role are sound."""
    numbers = F.forall("pts", lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull())
    problem = (
        F.when(F.coalesce(F.size("pts"), F.lit(0)) < 3, "fewer than three points").when(~numbers, "a point is not two numbers")
        .when(~F.coalesce("role", F.lit("")).isin("", *S.ROLES), "unknown role"))
    return zones.withColumn("problem", problem)


def check_scene(scene: DataFrame) -> DataFrame:
    """Scenes with ``problem``: they need a name, a map and two cameras or more."""
    problem = (
        F.when(F.coalesce("name", F.lit("")) == "", "no name").when(F.coalesce("map", F.lit("")) == "", "no map")
        .when(F.coalesce(F.size("cameras"), F.lit(0)) < 2, "fewer than two cameras"))
    return scene.withColumn("problem", problem)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header; never over the input."""
    df.write.option("header", True).option("emptyValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_text(df: DataFrame, path: str) -> None:
    """A one-column frame as text, e.g. a JSON document or a brief."""
    df.write.text(path)


def rewrite_ids(tracks: DataFrame, objects: DataFrame, mapping: DataFrame, path: str) -> None:
    """Tracks and their objects under new ids (old_id, new_id), as CSV in new folders below ``path``; never over the input."""
    write_csv(relabel(tracks, mapping, "track_id"), f"{path}/tracks")
    write_csv(relabel(objects, mapping, "person_id"), f"{path}/objects")


def cached(spark: SparkSession, source: str, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes of the file ``source``, as a table kept in ``folder`` by the file's name, size and time.

    A changed file has another key, so an old table is never taken for it. A table counts once its
    write has ended; what a broken write left is written anew.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(source)
    found = at.getFileSystem(conf).getFileStatus(at)
    stem = at.getName().rsplit(".", 1)[0]
    path = f"{folder.rstrip('/')}/{stem}-{found.getLen()}-{found.getModificationTime()}"
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# -- catalogues ------------------------------------------------------------


def list_videos(videos: DataFrame, tracks: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Videos with has_tracks and has_calibration, analysed and calibrated ones first."""
    has = lambda d, n: d.select("video").distinct().withColumn(n, F.lit(True))
    out = videos.join(has(tracks, "has_tracks"), "video", "left").join(has(calibrations, "has_calibration"), "video", "left").na.fill(False)
    return out.orderBy(~F.col("has_tracks"), ~F.col("has_calibration"), "video")


def list_sources(videos: DataFrame, tracks: DataFrame, calibrations: DataFrame, zones: DataFrame) -> DataFrame:
    """Videos that can be analysed: calibrated and tracked, with their zones' number and roles."""
    z = zones.groupBy("map").agg(F.count("*").alias("n_zones"), F.array_sort(F.collect_set(F.nullif("role", F.lit("")))).alias("roles"))
    own = videos.join(tracks, "video", "left_semi").join(calibrations.select("video", "map"), "video")
    return own.join(z, "map", "left").select("video", "map", F.coalesce("n_zones", F.lit(0)).alias("n_zones"), F.coalesce("roles", F.expr("array()")).alias("roles")).orderBy("video")


def list_scenes(scenes: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Scenes with the number of landmarks and of calibrated cameras."""
    cams = scenes.select("name", F.explode("cameras.video").alias("video")).join(calibrations, "video", "left_semi").groupBy("name").agg(F.count("*").alias("calibrated"))
    return scenes.join(cams, "name", "left").select("name", F.size("cameras").alias("cameras"), F.coalesce(F.size("landmarks"), F.lit(0)).alias("landmarks"), F.coalesce("calibrated", F.lit(0)).alias("calibrated")).orderBy("name")


def list_maps(files: DataFrame) -> DataFrame:
    """Names of image files."""
    return files.where(F.lower(F.regexp_extract("name", r"\.[^.]+$", 0)).isin(".png", ".jpg", ".jpeg", ".webp", ".svg")).orderBy("name")
