"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoints(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, set for checkpoints; where it is unset, a temporary one in local mode,
    and an error on a cluster."""
    conf = spark.sparkContext.getConf()
    have = spark.sparkContext.getCheckpointDir()
    named = conf.get("spark.checkpoint.dir", None)
    if not named and not have and not conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not have:
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="sluice-"))
    return (named or spark.sparkContext.getCheckpointDir()).rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A name for a new folder there; it is deleted when the session's JVM ends."""
    path = f"{checkpoints(spark)}/sluice-{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
