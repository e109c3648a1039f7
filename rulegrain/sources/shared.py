"""The folder that driver and executors share, and files in it or elsewhere."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

DEFAULT_SHARED = "/tmp/checkpoints/rulegrain"


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names, or the context's checkpoint folder; a default of our own only in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = context.get() if context.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = DEFAULT_SHARED
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(path: str):
    """(file system, path in it) of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
