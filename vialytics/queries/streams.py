"""Queries that run a stream over all its input and return what its sink holds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.testdata import read
from ..streaming import stateful
from .registry import query


def _stream(spark, sf_dir, name):
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "*.parquet").load(path if "." not in path.rsplit("/", 1)[-1] else path + "*")


def _run(stream, mode):
    """All input at once into a memory table; what the driver gets is the small result."""
    name = f"out_{uuid.uuid4().hex}"
    started = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    started.awaitTermination()
    return stream.sparkSession.table(name)


@query("select date_trunc('day', ts) as start, event_type, count(*) as n from events group by 1, 2")
def stream_tumbling_counts(spark, sf_dir):
    out = _run(stateful.tumbling_counts(_stream(spark, sf_dir, "events"), "ts", "1 day", "7 days", "event_type"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("select event_type, count(*) as n, max(ts) as ts, arg_max(user_id, ts) as user_id from events group by 1")
def stream_latest_state(spark, sf_dir):
    return _run(stateful.latest_state(_stream(spark, sf_dir, "events"), "event_type", "ts", "user_id"), "complete")


@query("select event_type, date_trunc('day', ts) as start, count(*) as n, sum(value) as total from events group by 1, 2")
def batch_tumbling_sums(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return events.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
