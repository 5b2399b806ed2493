"""Summary text to normalised association rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.functions.alleles import flip_direction, harmonise, identifier, munge_allele, number, p_to_lp, resolve_contig, strict_number, strict_position
from locusloom.sources.fasta import with_reference
from locusloom.sources.text import bind


def munge(
    raw: DataFrame,
    codes: dict[str, str],
    contigs: Sequence[str],
    fasta: DataFrame | None = None,
    sample: str = "SAMPLE",
    ns: float | None = None,
    nc: float | None = None,
    ne: float | None = None,
    iffy_tag: str = "IFFY",
    mismatch_tag: str = "REF_MISMATCH",
    strict: bool = False,
) -> DataFrame:
    """Normalise the all-string columns of ``raw`` by header synonyms ``codes``.

    Effects are of alt, which is the effect allele a1 unless the reference begins with a1 and not a2: then alleles are
    exchanged, effects negated and frequencies mirrored. Without ``fasta`` (see :mod:`locusloom.sources.fasta`)
    ref is a2 and nothing is checked. Rows of unknown contigs are left out. Constants fill in for missing columns.
    With ``strict`` text that is neither a number nor a missing mark is an error, else it is missing.
    """
    at = bind(raw.columns, codes)
    col = lambda c: F.col(f"`{at[c]}`")
    has = lambda *cs: all(c in at for c in cs)
    null = F.lit(None).cast("double")
    text = lambda c: strict_number(col(c)) if strict else col(c)
    num = lambda c: number(text(c)) if c in at else null
    lp = p_to_lp(text("P")) if has("P") else num("LP")
    es = num("BETA") if has("BETA") else F.when(num("OR") > 0, F.ln(num("OR"))) if has("OR") else null
    cases = F.coalesce(num("N_CAS"), F.lit(nc).cast("double"))
    total = F.coalesce(num("N"), cases + num("N_CON") if has("N_CAS", "N_CON") else null, F.lit(ns).cast("double"))
    effective = F.coalesce(num("NEFF"), num("NEFFDIV2") * 2, F.lit(ne).cast("double"))
    other = "A2" if has("A2") else "A*" if has("A*") else None
    rows = raw.select(
        resolve_contig(col("CHR"), contigs).alias("chrom"),
        F.trim(strict_position(col("BP")) if strict else col("BP")).try_cast("bigint").alias("pos"),
        (identifier(col("SNP")) if has("SNP") else F.lit(None).cast("string")).alias("id"),
        munge_allele(col("A1")).alias("_a1"),
        (munge_allele(col(other)) if other else F.lit(None).cast("string")).alias("_a2"),
        F.lit(sample).alias("study"),
        total.alias("ns"), num("Z").alias("ez"), num("INFO").alias("si"), cases.alias("nc"), es.alias("es"), num("SE").alias("se"), lp.alias("lp"),
        num("FRQ").alias("af"), num("AC").alias("ac"), effective.alias("ne"), num("HET_I2").alias("i2"),
        (p_to_lp(text("HET_P")) if has("HET_P") else num("HET_LP")).alias("cq"),
        (col("DIRE") if has("DIRE") else F.lit(None).cast("string")).alias("ed"),
    ).where(F.col("chrom").isNotNull())
    if fasta is None:
        return _named(rows.withColumn("_class", F.lit("same")), iffy_tag, mismatch_tag)
    longest = F.greatest(F.length("_a1"), F.length("_a2"))
    rows = with_reference(rows, fasta, F.col("pos"), longest, "_ref")
    return _named(rows.withColumn("_class", harmonise(F.col("_a1"), F.col("_a2"), F.col("_ref"))).drop("_ref"), iffy_tag, mismatch_tag)


def swapped(rows: DataFrame, swap: Column) -> DataFrame:
    """Mirror the statistics of the rows where ``swap`` holds."""
    turn = lambda new, old: F.when(swap, new).otherwise(F.col(old)).alias(old)
    new = {"ez": -F.col("ez"), "es": -F.col("es"), "af": 1 - F.col("af"), "ac": 2 * F.col("ns") - F.col("ac"), "ed": flip_direction(F.col("ed"))}
    return rows.select(*[turn(new[c], c) if c in new else F.col(c) for c in rows.columns])


def _named(rows: DataFrame, iffy_tag: str, mismatch_tag: str) -> DataFrame:
    swap = F.col("_class") == "swap"
    rows = swapped(rows, swap)
    tags = F.array_compact(F.array(F.when(F.col("_class") == "iffy", iffy_tag), F.when(F.col("_class") == "mismatch", mismatch_tag)))
    rows = rows.withColumn("ref", F.when(swap, F.col("_a1")).otherwise(F.col("_a2"))).withColumn("alt", F.when(swap, F.col("_a2")).otherwise(F.col("_a1"))).withColumn("filters", tags)
    return rows.drop("_a1", "_a2", "_class")
