"""Composing tables: alleles split and joined, studies as columns, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.operators.intervals import in_regions


def split_alleles(rows: DataFrame, per_alt: Sequence[str] = ()) -> DataFrame:
    """A row for each alternative of the array alt; columns of ``per_alt`` hold a value for each alternative."""
    out = rows.select(*[c for c in rows.columns if c not in ("alt", *per_alt)], F.posexplode("alt").alias("_i", "alt"), *per_alt)
    for c in per_alt:
        out = out.withColumn(c, F.get(c, F.col("_i")))
    return out.drop("_i")


def join_alleles(rows: DataFrame, per_alt: Sequence[str] = (), key: Sequence[str] = ("chrom", "pos", "ref")) -> DataFrame:
    """A row for each place and ref, with its alternatives and their values as arrays in order of alt."""
    held = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("alt", *per_alt))).alias("_x"))
    return held.select(*key, *[F.col(f"_x.{c}").alias(c) for c in ("alt", *per_alt)])


def wide(rows: DataFrame, studies: Sequence[str], fields: Sequence[str], key: Sequence[str] = ("chrom", "pos", "ref", "alt")) -> DataFrame:
    """Fields of each study as columns {study}_{field}."""
    return rows.groupBy(*key).pivot("study", list(studies)).agg(*[F.first(f).alias(f) for f in fields])


def stack(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; columns that a part lacks are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def in_order(rows: DataFrame, contigs: Sequence[str]) -> DataFrame:
    """Rows sorted by contig (in the order given), pos, ref and alt."""
    return rows.orderBy(F.array_position(F.lit(list(contigs)), F.col("chrom")), "pos", "ref", "alt")


def write_in_order(rows: DataFrame, path: str) -> None:
    """Parquet in a folder for each contig, sorted by place within each file, so that a region reads few row groups."""
    placed = rows.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos", "ref", "alt")
    placed.write.partitionBy("chrom").parquet(path)


#: Where the index of a table lies: readers of the table pass over names that begin with an underscore.
INDEX = "_index"


def write_indexed(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Parquet files of ranges of (chrom, pos), and an index of the places that each file's rows of a contig take.

    ``files`` sets how many; a row takes the bases of ref.
    """
    keys = ("chrom", "pos")
    placed = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    placed.sortWithinPartitions(*keys, "ref", "alt").write.parquet(path)
    spark = rows.sparkSession
    written = spark.read.parquet(path)
    name = F.element_at(F.split(written.metadataColumn("_metadata")["file_path"], "/"), -1)
    last = F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1
    index = written.groupBy(name.alias("file"), "chrom").agg(F.min("pos").alias("first"), F.max(last).alias("last"), F.count("*").alias("n"))
    index.coalesce(1).write.parquet(f"{path}/{INDEX}")  # a row for each file and contig


def read_regions(spark: SparkSession, path: str, regions: DataFrame, overlap: int = 1) -> DataFrame:
    """Rows in regions (r_chrom, r_start, r_end) of what :func:`write_indexed` wrote, from those files alone that a region touches."""
    index = spark.read.parquet(f"{path}/{INDEX}")
    touched = index.join(regions, (F.col("chrom") == F.col("r_chrom")) & (F.col("first") <= F.col("r_end")) & (F.col("last") >= F.col("r_start")), "left_semi")
    names = [r[0] for r in touched.select("file").distinct().collect()]  # names of files
    if not names:
        return spark.read.parquet(path).limit(0)
    return in_regions(spark.read.schema(spark.read.parquet(path).schema).parquet(*[f"{path}/{n}" for n in sorted(names)]), regions, overlap=overlap)


def annotate_ids(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with the id that ``names`` (chrom, pos, ref, alt, id) has for them, their own if none."""
    known = names.select("chrom", "pos", "ref", "alt", F.col("id").alias("_id"))
    return rows.join(known, ["chrom", "pos", "ref", "alt"], "left").withColumn("id", F.coalesce("_id", "id")).drop("_id")


def exchange_format(rows: DataFrame) -> DataFrame:
    """Columns of the exchange format: p from lp, the frequency of alt, numbered sex chromosomes, NA for what is missing."""
    bare = F.regexp_replace("chrom", "^chr", "")
    number = F.when(bare == "X", "23").when(bare == "Y", "24").when(bare.isin("M", "MT"), "25").otherwise(bare)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("NA"))
    af = F.col("af") if "af" in rows.columns else F.lit(None)
    return rows.select(
        number.alias("chromosome"),
        F.col("pos").alias("base_pair_location"),
        F.col("alt").alias("effect_allele"),
        F.col("ref").alias("other_allele"),
        text(F.col("es")).alias("beta"),
        text(F.col("se")).alias("standard_error"),
        text(af).alias("effect_allele_frequency"),
        text(F.pow(F.lit(10.0), -F.col("lp"))).alias("p_value"),
    )


def precision_edges(ldgm: DataFrame) -> DataFrame:
    """(ld_block, i, j, w) of the upper triangle, diagonal included."""
    pairs = ldgm.select("ld_block", F.col("ld_node").alias("i"), F.explode(F.arrays_zip("ld_neighbors", "ld_weights")).alias("_x")).select("ld_block", "i", F.col("_x.ld_neighbors").alias("j"), F.col("_x.ld_weights").alias("w"))
    return pairs.unionByName(ldgm.select("ld_block", F.col("ld_node").alias("i"), F.col("ld_node").alias("j"), F.col("ld_diagonal").alias("w"))).distinct()
