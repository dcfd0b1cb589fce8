"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written to the session's checkpoint folder and read back; only a local session that names none gets a temporary folder."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vialytics-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/vialytics-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # Spark deletes a shuffle once its plan is collected: what led to this table is of no more use
    return spark.read.schema(df.schema).parquet(path)
