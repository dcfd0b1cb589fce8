"""Run folders: what a run left behind, read and written. A folder holds tracks.json, observations.csv, events.jsonl and more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the artifacts; what a file lacks is null, what it has beside them is left out.
TRACKS = "run_id string, camera_id string, local_track_id string, status string, final_class string, first_frame long, last_frame long, first_timestamp_seconds double, last_timestamp_seconds double, observation_count long"
OBSERVATIONS = "run_id string, camera_id string, local_track_id string, frame_number long, timestamp_seconds double, x1 double, y1 double, x2 double, y2 double, confidence double, raw_class_name string"
EVENTS = "run_id string, camera_id string, frame_number long, event string"
_RUN = r"run_([^/]+)/[^/]+$"


def _files(spark: SparkSession, path: str) -> list:
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    return list(pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or [])


def run_folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the run folders below root, the newest name first; one short name a run."""
    return sorted((s.getPath().getName() for s in _files(spark, f"{root}/run_*") if s.isDirectory()), reverse=True)


def selected(spark: SparkSession, root: str, which: str = "all") -> list[str]:
    """Run folders by `all`, `latest` or a name; an unknown name is an error."""
    runs = run_folders(spark, root)
    if which == "all":
        return runs
    if which == "latest":
        return runs[:1]
    if which not in runs:
        raise ValueError(f"there is no run {which}")
    return [which]


def _paths(spark: SparkSession, root: str, runs: list[str], name: str) -> list[str]:
    """Paths of an artifact in those runs that have it."""
    return [f"{root}/{r}/{name}" for r in runs if _files(spark, f"{root}/{r}/{name}")]


def _named(df: DataFrame) -> DataFrame:
    """run_id from the folder where the file does not say."""
    return df.withColumn("run_id", F.coalesce("run_id", F.regexp_extract(F.input_file_name(), _RUN, 1)))


def read_tracks(spark: SparkSession, root: str, which: str = "all") -> DataFrame:
    """tracks.json, an array of objects, of the runs; a run without the file has no tracks, broken files give rows of nulls."""
    paths = _paths(spark, root, selected(spark, root, which), "tracks.json")
    return _named(spark.read.schema(TRACKS).option("multiLine", True).json(paths)) if paths else spark.createDataFrame([], TRACKS)


def read_observations(spark: SparkSession, root: str, which: str = "all") -> DataFrame:
    """observations.csv of the runs by its header; every column is read as the artifact's type, bad values are null."""
    paths = _paths(spark, root, selected(spark, root, which), "observations.csv")
    if not paths:
        return spark.createDataFrame([], OBSERVATIONS)
    raw = spark.read.option("header", True).csv(paths)
    fields = spark.createDataFrame([], OBSERVATIONS).schema.fields
    return _named(raw.select(*(F.expr(f"try_cast({f.name} as {f.dataType.simpleString()})").alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields)))


def read_events(spark: SparkSession, root: str, which: str = "all") -> DataFrame:
    """events.jsonl of the runs, an object a line."""
    paths = _paths(spark, root, selected(spark, root, which), "events.jsonl")
    return _named(spark.read.schema(EVENTS).json(paths)) if paths else spark.createDataFrame([], EVENTS)


def write_run(df: DataFrame, folder: str, kind: str) -> None:
    """df as folders of JSON lines or CSV parts, one for each run_id, replacing those runs alone."""
    out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
    out.option("header", True).csv(folder) if kind == "csv" else out.json(folder)
