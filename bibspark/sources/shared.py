"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's checkpoint folder. Where neither is set, a session on one
    machine gets a folder of its own; on a cluster executors would not share one: an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif re.fullmatch(r"local(\[[^-]*\])?", context.master):
            folder = "file:///tmp/checkpoints/bibspark"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what several results need is computed once, and
    outlives any executor."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
