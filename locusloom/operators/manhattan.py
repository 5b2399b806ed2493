"""Rows of a Manhattan plot: filters, transformed heights, cumulative positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusloom.functions.stats import binomial_lp, compress_lp

#: Kinds of coding consequences.
CODING = ("missense", "inframe", "protein_altering", "transcript_amplification", "exon_loss", "disruptive", "start_lost", "stop_lost", "stop_gained", "frameshift", "splice_acceptor", "splice_donor", "transcript_ablation")


def contig_name(chrom: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(chrom, "^chrM", "MT"), "^chr", "")


def contig_order(chrom: Column) -> Column:
    name = contig_name(chrom)
    return F.when(name == "X", 23).when(name == "Y", 24).when(name == "MT", 26).otherwise(name.try_cast("int"))


def contig_lengths(cytobands: DataFrame) -> DataFrame:
    """(chrom, length) of cytobands (chrom, start, end)."""
    return cytobands.groupBy(contig_name(F.col("chrom")).alias("chrom")).agg(F.max("end").alias("length"))


def is_coding(consequence: Column) -> Column:
    return consequence.rlike("|".join(CODING))


def plot_rows(
    rows: DataFrame, lengths: DataFrame, min_af: float = 0.0, min_lp: float = 2.0, above: float = 10.0, spacing: int = 20, region: tuple[str, int, int] | None = None,
    phenotype: str | int | None = None, allelic: bool = False,
) -> DataFrame:
    """``rows`` to plot with height, x (cumulative base position) and coding, if there is a consequence.

    ``lengths`` has a row for each contig; ``spacing`` megabases part contigs. ``phenotype`` is the study that is plotted, of all rows
    if null. With ``allelic`` lp is that of the binomial test of the counts as0 and as1, rows without counts go, and frequencies aren't looked at.
    """
    kept = rows if phenotype is None else rows.where(F.col("study") == phenotype)
    if allelic:
        kept = kept.where(F.col("as0") + F.col("as1") > 0).withColumn("lp", binomial_lp(F.col("as0"), F.col("as1")))
    kept = kept.where(F.col("lp") >= min_lp)
    if min_af > 0 and not allelic and "af" in rows.columns:
        kept = kept.where((F.col("af") > min_af) & (F.col("af") < 1 - min_af))
    if region:
        kept = kept.where((F.col("chrom") == region[0]) & F.col("pos").between(*region[1:]))
    order = Window.orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)  # over contigs
    starts = lengths.withColumn("_order", contig_order(F.col("chrom"))).withColumn("_start", F.coalesce(F.sum(F.col("length") + spacing * 1_000_000).over(order), F.lit(0)))
    out = kept.withColumn("_name", contig_name(F.col("chrom"))).join(F.broadcast(starts.select(F.col("chrom").alias("_name"), "_start")), "_name")
    out = out.withColumn("height", compress_lp(F.col("lp"), above)).withColumn("x", F.col("_start") + F.col("pos"))
    if "consequence" in rows.columns:
        out = out.withColumn("coding", is_coding(F.col("consequence")))
    return out.drop("_name", "_start")
