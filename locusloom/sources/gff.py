"""Gene models of GFF3 files, as a table of exons and coding segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COLUMNS = "chrom string, origin string, kind string, start long, end long, score string, strand string, phase string, attributes string"


def _attribute(name: str) -> Column:
    """An attribute's value, without the kind before its colon."""
    text = F.regexp_extract("attributes", rf"(?:^|;)\s*{name}=([^;]*)", 1)
    return F.when(text != "", F.regexp_replace(text, "^(gene|transcript|CDS|exon):", ""))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """(transcript, gene, biotype, chrom, strand, kind, start, end, phase) of all exons and coding segments.

    ``kind`` is exon or CDS; ends are closed and count from 1. A part of several transcripts is a row for each. A gene without a
    name has its identifier. Parts whose transcript or gene has no line of its own keep null for what it would tell; comments, blank
    lines and all other features are passed over.
    """
    lines = spark.read.csv(path, sep="\t", schema=_COLUMNS, comment="#", quote="", mode="PERMISSIVE").where(F.col("start") <= F.col("end"))
    parts = lines.where(F.col("kind").isin("exon", "CDS")).withColumn("transcript", F.explode(F.split(_attribute("Parent"), ",")))
    parts = parts.withColumn("transcript", F.regexp_replace("transcript", "^transcript:", ""))
    own = lines.where(~F.col("kind").isin("exon", "CDS")).select(_attribute("ID").alias("_id"), _attribute("Parent").alias("_parent"), _attribute("Name").alias("_name"), _attribute("biotype").alias("_biotype"))
    own = own.where(F.col("_id").isNotNull()).groupBy("_id").agg(F.min("_parent").alias("_parent"), F.min("_name").alias("_name"), F.min("_biotype").alias("_biotype"))
    genes = own.select(F.col("_id").alias("_gene"), F.col("_name").alias("_gene_name"))
    known = own.join(genes, own["_parent"] == genes["_gene"], "left").select(F.col("_id").alias("transcript"), F.coalesce("_gene_name", "_parent").alias("gene"), F.col("_biotype").alias("biotype"))
    out = parts.join(known, "transcript", "left")
    return out.select("transcript", "gene", "biotype", "chrom", "strand", "kind", "start", "end", F.coalesce(F.col("phase").try_cast("int"), F.lit(0)).alias("phase"))
