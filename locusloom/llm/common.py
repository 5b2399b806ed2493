"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and the master is local (tests) a
    temporary folder is made. The checkpoint directory of the context is set along with it.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="locusloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def own_columns(names: list[str]) -> list[Column]:
    """Columns of these names, whatever characters they hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns: those given, with as many underscores before them as tell them from ``df``'s own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows, else leave the join to a shuffle.

    ``df`` should be materialised (see :func:`cut`), as its rows are counted.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
