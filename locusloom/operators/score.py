"""Polygenic scores: sums of effect times dosage for each sample, score and p-value threshold."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusloom.functions.dosage import PRIORITY, dosages
from locusloom.functions.stats import threshold_lp

#: Markers up to this number are broadcast; beyond, the join shuffles variants before their samples are exploded.
BROADCAST_MARKERS = 2_000_000


def first_markers(markers: DataFrame, by_id: bool = False, order: str = "line") -> DataFrame:
    """Of markers with the same prs and place (or id) the first one."""
    key = ["prs", "id"] if by_id else ["prs", "chrom", "pos"]
    first = Window.partitionBy(*key).orderBy(order)
    return markers.where(F.col("a1") != "").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def choose_field(columns: Sequence[str]) -> str:
    """The genotype field to use where none is named."""
    have = {c.upper().rstrip("_") for c in columns}
    have |= {"AP"} if {"AP1", "AP2"} <= have else set()
    return next(f for f in PRIORITY if f in have)


def matched(genotypes: DataFrame, markers: DataFrame, by_id: bool = False, exact: bool = False) -> DataFrame:
    """Genotype rows with the markers whose effect allele they have, before any sample is looked at.

    ``exact`` pairs records of the same place, ref and alt, which the markers must have, and takes alt for the effect
    allele. Markers without an effect count for nothing.
    """
    key = ["id"] if by_id else ["chrom", "pos"]
    effect = F.upper("alt") if exact else F.upper("a1")
    own = [F.upper("ref").alias("_ref")] if exact else []
    small = markers.where(F.col("es").isNotNull() & ~F.isnan("es")).select("prs", *key, effect.alias("_a1"), "es", "lp", *own)
    if small.limit(BROADCAST_MARKERS + 1).count() <= BROADCAST_MARKERS:
        small = F.broadcast(small)
    alleles = F.transform("alleles", F.upper)
    found = genotypes.join(small, key).withColumn("_allele", (F.array_position(alleles, F.col("_a1")) - 1).cast("int"))
    if exact:
        found = found.where(alleles == F.array("_ref", "_a1")).drop("_ref")
    return found.where("_allele >= 0")


def score(
    genotypes: DataFrame,
    markers: DataFrame,
    use: str | None = None,
    thresholds: Sequence[float] = (),
    by_id: bool = False,
    counts: bool = False,
    association: bool = False,
) -> DataFrame:
    """(sample, prs, thr, score[, n]): markers have prs, chrom and pos or id, a1, es, lp and line.

    A missing genotype or effect adds nothing. A threshold keeps markers unless their lp is below its -log10; a missing
    lp passes. Without thresholds thr is null. Markers of ``association`` tables have ref and alt instead of a1 and line: they
    pair with records of the same alleles, and with thresholds a missing lp doesn't pass.
    """
    if association:
        known = markers.where(F.col("lp").isNotNull() & ~F.isnan("lp")) if thresholds else markers
        rows = matched(genotypes, known, by_id, exact=True)
    else:
        rows = matched(genotypes, first_markers(markers, by_id), by_id)
    use = use or choose_field(genotypes.schema["samples"].dataType.elementType.fieldNames())
    each = rows.select("prs", "_allele", "es", "lp", F.size("alleles").alias("_n"), F.explode("samples").alias("_s"))
    each = each.withColumn("_d", F.get(dosages(use, F.col("_s"), F.col("_n")), F.col("_allele"))).where(F.col("_d").isNotNull())
    return sums(each.select(F.col("_s.sample").alias("sample"), "prs", "es", "lp", F.col("_d").alias("dosage")), thresholds, counts)


def sums(each: DataFrame, thresholds: Sequence[float] = (), counts: bool = False) -> DataFrame:
    """Scores of rows (sample, prs, es, lp, dosage)."""
    if thresholds:
        passing = F.array_compact(F.array(*[F.when(~F.coalesce(F.col("lp") < threshold_lp(t), F.lit(False)), F.lit(float(t))) for t in thresholds]))
        each = each.withColumn("thr", F.explode(passing))
    else:
        each = each.withColumn("thr", F.lit(None).cast("double"))
    aggs = [F.sum(F.col("es") * F.col("dosage")).alias("score")] + ([F.count("*").alias("n")] if counts else [])
    return each.groupBy("sample", "prs", "thr").agg(*aggs)


def _suffix(thr: float | None) -> str:
    return "" if thr is None else "_p%.6g" % thr


def matrix_names(names: Sequence[str], thresholds: Sequence[float | None] = (None,), counts: bool = False) -> list[str]:
    """The columns of a matrix: for each score and threshold its sum, and how many markers it counts."""
    return [f"{p}{c}{_suffix(t)}" for p in names for t in thresholds for c in (("", "_CNT") if counts else ("",))]


def matrix(scores: DataFrame, names: Sequence[str], thresholds: Sequence[float] = (), counts: bool = False) -> DataFrame:
    """A row for each sample, a column for each score and threshold, and with ``counts`` one for its n.

    ``names`` are the scores in order.
    """
    levels = list(thresholds) or [None]
    cells = []
    for p in names:
        for t in levels:
            own = (F.col("prs") == p) & (F.col("thr").isNull() if t is None else F.col("thr") == float(t))
            cells.append(F.sum(F.when(own, F.col("score"))).alias(f"{p}{_suffix(t)}"))
            if counts:
                cells.append(F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias(f"{p}_CNT{_suffix(t)}"))
    return scores.groupBy("sample").agg(*cells)


def display_name(path: str) -> str:
    """A file's name without folders and known suffixes."""
    name = path.rsplit("/", 1)[-1]
    while (cut := next((s for s in (".gz", ".txt", ".tsv", ".vcf", ".bcf") if name.endswith(s)), None)) is not None:
        name = name[: -len(cut)]
    return name


def c_general(x: float | None) -> str:
    """A number with six significant digits and its trailing zeros, as C prints it with %#.6g."""
    return "nan" if x is None or x != x else "%#.6g" % x


@F.pandas_udf(T.StringType())
def _printed(x: pd.Series) -> pd.Series:
    return x.map(c_general)


def write_matrix(scores: DataFrame, path: str) -> None:
    """A score matrix as tab-separated text with a header."""
    whole = {f.name for f in scores.schema if f.dataType.typeName() in ("long", "integer")}
    cells = [F.col(c) if c == "sample" or c in whole else _printed(F.col(c).cast("double")).alias(c) for c in scores.columns]
    scores.orderBy("sample").select(*cells).withColumnRenamed("sample", "SAMPLE").write.csv(path, sep="\t", header=True)
