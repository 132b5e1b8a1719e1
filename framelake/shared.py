"""Folders for tables between the steps of a job: in the session's shared folder, as executors can be lost and do not see each other's disks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder that all executors see: in the session's shared one, or on this machine where the session is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return f"{shared.rstrip('/')}/catalog-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="framelake-")
    atexit.register(shutil.rmtree, made, True)
    return f"file://{made}/run"


def kept(rows: DataFrame) -> DataFrame:
    """The rows from a table written in such a folder: computed once, with all that depends on the order of a task's rows."""
    where = folder(rows.sparkSession)
    rows.write.parquet(where)
    return rows.sparkSession.read.schema(rows.schema).parquet(where)
