"""Tables that are materialised in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, for tables and files that all executors read."""
    return f"{_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder of ``spark.checkpoint.dir`` and forget its lineage.

    Only where that is unset and the master is local (tests) a temporary folder is made.
    """
    _checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def _checkpoints(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        sc.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="locusloom-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()).rstrip("/")
