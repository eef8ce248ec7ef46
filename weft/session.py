"""Folders of a session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def current() -> SparkSession:
    """The running session, from any of the driver's threads."""
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set, which only a local master can use."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        found = tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
