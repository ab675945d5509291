"""The shared folder for what a job writes and reads again, and reliable lineage cuts in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir. A folder of our own only on a local master, where all tasks
    share it; on a cluster a missing setting is an error."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="crosslight-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    folder(df.sparkSession)
    return df.checkpoint(True)
