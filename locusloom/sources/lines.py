"""Lines of text files with their numbers, read in parallel.

A line knows the split that it was read in; splits are counted and added up, a row for each, and numbers within a split
come from one window over it. So no task sees more than a split, and files of any size are read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusloom.functions.tables import cut

#: What tells a split, and a line's place in it.
SPLIT, AT = ("_file", "_block"), "_at"


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _file, _block, _at) of all lines that aren't blank; order by these is the files' order."""
    lines = spark.read.text(path)
    meta = lines.metadataColumn("_metadata")
    lines = lines.select("value", meta["file_path"].alias("_file"), meta["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias(AT))
    return cut(lines.where(F.length(F.trim("value")) > 0))


def within() -> Window:
    return Window.partitionBy(*SPLIT).orderBy(AT)


def with_running(lines: DataFrame, **sums: Column) -> DataFrame:
    """Add running sums, including each line's own, over all lines in order."""
    totals = lines.groupBy(*SPLIT).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    offsets = totals.select(*SPLIT, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    out = lines.join(F.broadcast(offsets), list(SPLIT))
    return out.select("*", *[(F.sum(c).over(within()) + F.col(f"_o_{n}")).alias(n) for n, c in sums.items()]).drop(*[f"_o_{n}" for n in sums])
