"""Folders that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def root_of(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where that setting is absent and all runs in one process (tests) a local folder is made, once a session."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="readloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir."""
    return f"{root_of(spark)}/readloom/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all that operators have stored below spark.checkpoint.dir; call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root_of(spark)}/readloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
