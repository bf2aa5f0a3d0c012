"""Cutting lineage so that a lost executor costs one stage, not the whole job."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``; only where it is unset, a local one (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="glintframe-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, for files that tasks write themselves; it must be on a file system that all executors mount."""
    ensure_checkpoint_dir(spark)
    base = urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    if base.scheme not in ("", "file"):
        raise ValueError("index files need a mounted folder in spark.checkpoint.dir")
    return f"{base.path}/{uuid.uuid4().hex}"
