"""Observation tables derived from the star-schema test tables; FIXTURES.md describes them.

The SQL texts state the same tables for other engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CAMERA = "concat('CAM_00', cast(cast(floor(n_nationkey / 5) as int) + 1 as varchar(10)))"
_CLASS = """case when o_orderkey % 17 = 0 then 'UNKNOWN' when o_orderpriority = '1-URGENT' then 'CAR'
  when o_orderpriority = '2-HIGH' then 'MOTORCYCLE' when o_orderpriority = '3-MEDIUM' then 'TRUCK'
  when o_orderpriority = '4-NOT SPECIFIED' then 'BUS' else '3WHEELER' end"""
_COLOUR = """case c_mktsegment when 'AUTOMOBILE' then 'BLACK' when 'BUILDING' then 'WHITE' when 'FURNITURE' then 'RED'
  when 'HOUSEHOLD' then 'SILVER' else 'UNKNOWN' end"""
_PLATE = """case when o_orderkey % 4 = 0 then null else concat(
  case o_orderkey % 3 when 0 then 'HR' when 1 then 'DL' else 'MP' end, cast(10 + o_custkey % 90 as varchar(4)),
  chr(cast(65 + o_custkey % 26 as int)), cast(1000 + o_orderkey % 9000 as varchar(8))) end"""
#: name -> expression, in SQL that Spark and others share
VEHICLE_COLUMNS = {
    "run_id": "concat('RUN_', cast(n_regionkey as varchar(10)))",
    "camera_id": CAMERA,
    "vehicle_id": f"concat({CAMERA}, ':TRACK_', cast(o_orderkey as varchar(20)))",
    "vehicle_class": _CLASS,
    "colour": _COLOUR,
    "first_seen_seconds": "cast(o_orderkey % 600 as double)",
    "last_seen_seconds": "case when o_orderkey % 97 = 0 then null else cast(o_orderkey % 600 + 1 + o_orderkey % 30 as double) end",
    "status": "case when o_orderstatus = 'P' then 'DISCARDED' else 'COMPLETED' end",
    "plate_text": _PLATE,
    "plate_detected": "(o_orderkey % 4 <> 0 or o_orderkey % 8 = 0)",
    "track_no": "o_orderkey",
    "owner": "o_custkey",
}
VEHICLES = "select " + ", ".join(f"{e} as {n}" for n, e in VEHICLE_COLUMNS.items()) + " from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey"

_ORDER = "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
OBSERVATION_COLUMNS = {
    "x1": "cast(l_partkey as double)",
    "y1": "cast(l_suppkey as double)",
    "x2": "l_partkey + l_quantity",
    "y2": "l_suppkey + 20 + l_quantity / 2",
    "confidence": "1.0 - l_discount * 5",
    "raw_class_name": "case when l_returnflag = 'R' then 'motorcycle' when l_returnflag = 'A' then 'car' else 'truck' end",
    "line_status": "l_linestatus",
    "weight": "l_discount * 10",
}
OBSERVATIONS = (
    "select run_id, camera_id, vehicle_id as local_track_id, track_no, status, cast(track_no % 600 + rn as bigint) as frame_number, (track_no % 600 + rn) / 2.0e0 as timestamp_seconds, "
    + ", ".join(OBSERVATION_COLUMNS)
    + " from (select l_orderkey, row_number() over (partition by l_orderkey order by "
    + _ORDER
    + ") as rn, "
    + ", ".join(f"{e} as {n}" for n, e in OBSERVATION_COLUMNS.items())
    + f" from lineitem) li join ({VEHICLES}) ve on l_orderkey = track_no"
)


def vehicle_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vehicle: ids, class, colour, times, status and plate. 25 nations are broadcast, whatever the scale."""
    joined = (
        read(spark, sf_dir, "orders")
        .join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(F.broadcast(read(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    )
    return joined.selectExpr(*(f"{e} as {n}" for n, e in VEHICLE_COLUMNS.items()))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per track and frame: box, confidence and raw class."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", ")))
    lines = read(spark, sf_dir, "lineitem").withColumn("rn", place).selectExpr("l_orderkey", "rn", *(f"{e} as {n}" for n, e in OBSERVATION_COLUMNS.items()))
    tracks = vehicle_records(spark, sf_dir).select("run_id", "camera_id", "vehicle_id", "track_no", "status")
    frame = F.col("track_no") % 600 + F.col("rn")
    return lines.join(tracks, F.col("l_orderkey") == F.col("track_no")).select(
        "run_id", "camera_id", F.col("vehicle_id").alias("local_track_id"), "track_no", "status", frame.cast("long").alias("frame_number"), (frame / 2.0).alias("timestamp_seconds"), *OBSERVATION_COLUMNS
    )


#: events as a stream of detections: a user is a tracker's id, five cameras, a frame for each distinct time of a camera.
DETECTIONS = """select concat('CAM_00', cast(user_id % 5 + 1 as varchar(2))) as camera_id, user_id as native_id, event_id, ts,
  dense_rank() over (partition by user_id % 5 order by ts) as frame_number, event_type as raw_class_name, value / 500 as confidence from events"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("camera", F.col("user_id") % 5)
    return events.select(
        F.concat(F.lit("CAM_00"), (F.col("camera") + 1).cast("string")).alias("camera_id"), F.col("user_id").alias("native_id"), "event_id", "ts",
        F.dense_rank().over(Window.partitionBy("camera").orderBy("ts")).cast("long").alias("frame_number"), F.col("event_type").alias("raw_class_name"), (F.col("value") / 500).alias("confidence"),
    )
