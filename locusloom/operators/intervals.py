"""Points in intervals by an equi-join on bins, and the filters built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 1 << 16
#: Binned rows that are broadcast at most: about 170 bytes each once they are hashed, and a plan may hold several such tables in the driver at once.
BROADCAST_BINS = 200_000


def binned(intervals: DataFrame, start: str, end: str, bin_size: int = BIN) -> DataFrame:
    """``intervals`` (closed) once for each bin that they touch, in ``_bin``."""
    return intervals.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size))))


def join_points(points: DataFrame, intervals: DataFrame, on: Sequence[tuple[str, str]], pos: Column, start: str, end: str, how: str = "inner", bin_size: int = BIN) -> DataFrame:
    """Points with the intervals that hold them; ``on`` pairs column names of points and intervals.

    The binned intervals are broadcast if they are few, else both sides are shuffled by bin.
    """
    bins = binned(intervals, start, end, bin_size)
    if bins.limit(BROADCAST_BINS + 1).count() <= BROADCAST_BINS:
        bins = F.broadcast(bins)
    keyed = points.withColumn("_pos", pos).withColumn("_pbin", F.floor(F.col("_pos") / bin_size))
    cond = (F.col("_pbin") == F.col("_bin")) & F.col("_pos").between(F.col(start), F.col(end))
    for a, b in on:
        cond &= F.col(a) == F.col(b)
    return keyed.join(bins, cond, how).drop("_pos", "_pbin", "_bin")


def in_regions(rows: DataFrame, regions: DataFrame, exclude: bool = False, overlap: int = 1) -> DataFrame:
    """Rows in regions (r_chrom, r_start, r_end), or with ``exclude`` the others.

    ``overlap`` 0: the position lies in a region; 1: any base of ref does; 2: any base that differs does.
    """
    how = "left_anti" if exclude else "left_semi"
    if overlap == 0:
        return join_points(rows, regions, [("chrom", "r_chrom")], F.col("pos"), "r_start", "r_end", how)
    first = F.col("pos") if overlap == 1 else F.when((F.length("ref") > 1) | (F.length("alt") > 1), F.col("pos") + 1).otherwise(F.col("pos"))
    # A record spans little: it is looked up at each bin that it touches.
    last = F.greatest(F.col("pos") + F.length("ref") - 1, first)
    spans = rows.withColumn("_first", first).withColumn("_last", last)
    own = ["_first", "_last"]
    touched = spans.select("chrom", *own, F.explode(F.sequence(F.floor(F.col("_first") / BIN), F.floor(F.col("_last") / BIN))).alias("_pbin")).distinct()
    bins = binned(regions, "r_start", "r_end")
    hits = touched.join(bins, (F.col("chrom") == F.col("r_chrom")) & (F.col("_pbin") == F.col("_bin")) & (F.col("_first") <= F.col("r_end")) & (F.col("_last") >= F.col("r_start")), "left_semi").select("chrom", *own).distinct()
    return spans.join(hits, ["chrom", *own], how).select(*rows.columns)
