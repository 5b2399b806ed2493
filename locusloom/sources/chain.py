"""Chain files as tables of chains and gap-free blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusloom.functions.tables import cut
from locusloom.sources.lines import split_lines, with_running

CHAINS = "chain_ind int, score long, t_chrom string, t_size long, t_start long, t_end long, q_chrom string, q_size long, q_strand int, q_start long, q_end long, id long"


def read_chains(spark: SparkSession, path: str, max_gap: int = 1, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chains, blocks). A chain's lines are those from its header on; the file is read in splits.

    With ``strict`` a file that isn't sound is an error: a header without its fields, a target that isn't on the forward strand, a
    last line with gaps or another one without, numbers that aren't, or blocks that don't add up to what the header tells.
    """
    lines = with_running(split_lines(spark, path).where(~F.startswith("value", F.lit("#"))), _chains=F.startswith("value", F.lit("chain")).cast("long"), line=F.lit(1))
    fields = F.split(F.trim("value"), r"\s+")
    head = F.startswith("value", F.lit("chain"))
    lines = cut(lines.select((F.col("_chains") - 1).alias("chain_ind"), (F.col("line") - 1).alias("line"), head.alias("_head"), fields.alias("_f")))
    get = lambda i: F.get("_f", F.lit(i))
    number = lambda i: get(i).try_cast("long")
    chains = lines.where("_head").select(
        F.col("chain_ind").cast("int").alias("chain_ind"), number(1).alias("score"), get(2).alias("t_chrom"), number(3).alias("t_size"), number(5).alias("t_start"), number(6).alias("t_end"),
        get(7).alias("q_chrom"), number(8).alias("q_size"), (get(9) == "-").cast("int").alias("q_strand"), number(10).alias("q_start"), number(11).alias("q_end"), F.coalesce(number(12), F.lit(0)).alias("id"),
    )
    data = lines.where("not _head").select("chain_ind", "line", number(0).alias("size"), F.coalesce(number(1), F.lit(0)).alias("dt"), F.coalesce(number(2), F.lit(0)).alias("dq"))
    if strict:
        _check(path, lines, chains, data)
    return chains, merge_blocks(data, max_gap)


def _check(path: str, lines: DataFrame, chains: DataFrame, data: DataFrame) -> None:
    n, get = F.size("_f"), lambda i: F.get("_f", F.lit(i))
    whole = lambda i: get(i).rlike("^[0-9]+$")
    bad_head = ~n.isin(12, 13) | (get(4) != "+") | ~get(9).isin("+", "-")
    for i in (3, 5, 6, 8, 10, 11):
        bad_head |= ~whole(i)
    bad_data = ~((n == 1) & whole(0) | (n == 3) & whole(0) & whole(1) & whole(2)) | (F.col("chain_ind") < 0)
    bad = lines.where(F.coalesce(F.when(F.col("_head"), bad_head).otherwise(bad_data), F.lit(True))).select("line", F.array_join("_f", " ").alias("text")).orderBy("line").first()
    if bad:
        raise ValueError(f"{path}: line {bad[0]} isn't one of a chain file: {bad[1][:200]}")
    last = lines.where("not _head").groupBy("chain_ind").agg(F.max_by(n, "line").alias("_last"), F.count_if(n == 1).alias("_ends"))
    sums = data.groupBy("chain_ind").agg(F.sum(F.col("size") + F.col("dt")).alias("t"), F.sum(F.col("size") + F.col("dq")).alias("q"))
    told = chains.join(sums, "chain_ind", "left").join(last, "chain_ind", "left")
    sound = (F.col("t") == F.col("t_end") - F.col("t_start")) & (F.col("q") == F.col("q_end") - F.col("q_start")) & (F.col("_last") == 1) & (F.col("_ends") == 1)
    sound &= (F.col("t_end") <= F.col("t_size")) & (F.col("q_end") <= F.col("q_size"))
    wrong = told.where(~F.coalesce(sound, F.lit(False))).orderBy("chain_ind").first()
    if wrong:
        raise ValueError(f"{path}: the blocks of chain {wrong['chain_ind']} ({wrong['t_chrom']} to {wrong['q_chrom']}) don't make up what its header tells")


def merge_blocks(data: DataFrame, max_gap: int = 1) -> DataFrame:
    """Blocks (chain_ind, block_ind, t_start, q_start, size and the gaps around) of lines (chain_ind, line, size, dt, dq).

    Starts count from the chain's. Blocks that equal gaps of at most ``max_gap`` part are one. Gaps at a chain's ends are -1.
    """
    order = Window.partitionBy("chain_ind").orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    at = data.withColumn("t_start", F.coalesce(F.sum(F.col("size") + F.col("dt")).over(before), F.lit(0))).withColumn("q_start", F.coalesce(F.sum(F.col("size") + F.col("dq")).over(before), F.lit(0)))
    joins = F.coalesce((F.lag("dt").over(order) == F.lag("dq").over(order)) & (F.lag("dt").over(order) <= max_gap), F.lit(False))
    at = at.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order))
    merged = at.groupBy("chain_ind", "_island").agg(F.min("line").alias("line"), F.min("t_start").alias("t_start"), F.min("q_start").alias("q_start"), F.max(F.col("t_start") + F.col("size")).alias("_end"))
    merged = merged.withColumn("size", F.col("_end") - F.col("t_start"))
    return with_gaps(merged.withColumn("block_ind", F.col("line")).drop("line", "_island", "_end"))


def with_gaps(blocks: DataFrame) -> DataFrame:
    """Add the gaps to the blocks before and after in the chain."""
    order = Window.partitionBy("chain_ind").orderBy("t_start", "block_ind")
    end = lambda c: F.lag(F.col(f"{c}_start") + F.col("size")).over(order)
    for c in ("t", "q"):
        blocks = blocks.withColumn(f"{c}_start_gap", F.coalesce(F.col(f"{c}_start") - end(c), F.lit(-1))).withColumn(f"{c}_end_gap", F.coalesce(F.lead(f"{c}_start").over(order) - F.col(f"{c}_start") - F.col("size"), F.lit(-1)))
    return blocks


def first_chains(chains: DataFrame) -> DataFrame:
    """Of chains with the same id the first; id 0 names none."""
    first = Window.partitionBy("id").orderBy("chain_ind")
    return chains.withColumn("_n", F.row_number().over(first)).where("_n = 1 or id = 0").drop("_n")


def placed_blocks(chains: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks with what a lookup needs: b_chrom, 0-based b_start and b_end (inclusive), and the target's."""
    both = blocks.join(F.broadcast(first_chains(chains).withColumnsRenamed({"t_start": "ct", "q_start": "cq"})), "chain_ind")
    return both.select(
        "chain_ind", "block_ind", F.col("t_chrom").alias("b_chrom"), (F.col("ct") + F.col("t_start")).alias("b_start"), (F.col("ct") + F.col("t_start") + F.col("size") - 1).alias("b_end"),
        (F.col("cq") + F.col("q_start")).alias("b_q"), "q_chrom", "q_size", "q_strand", "t_start_gap", "t_end_gap", "q_start_gap", "q_end_gap", "t_size",
    )
