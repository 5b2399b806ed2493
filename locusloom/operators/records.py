"""Whole records, with INFO and samples, from one genome build to another.

A record has chrom, pos, alleles (the reference first), info (a map of texts; flags are ""), and may have id, qual, filters, samples (structs
of a name, genotypes and further fields) and other columns. It is placed by its alleles as in :mod:`locusloom.operators.liftover`; where the
destination's reference is another allele or none of them, all values that depend on alleles are rewritten by their
tags' rules, in one projection for any number of alleles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.functions.swap import rewritten_info, rewritten_samples
from locusloom.operators.liftover import TOLD, lift, lift_points

#: Fields of sample structs and their tags.
SAMPLE_TAGS = {"gt": "GT", "ds": "DS", "hds": "HDS", "ap1": "AP1", "ap2": "AP2", "gp": "GP", "as_": "AS", "es": "ES", "ez": "EZ", "ed": "ED", "ac": "AC", "an": "AN", "af": "AF"}


def with_info(info: Column, new: dict[str, Column]) -> Column:
    """The map with entries set, where their values aren't null."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in new.items()])
    told = F.filter(entries, lambda e: e["value"].isNotNull())
    names = F.transform(told, lambda e: e["key"])
    return F.map_concat(F.map_filter(info, lambda k, v: ~F.array_contains(names, k)), F.map_from_entries(told))


def lift_records(
    records: DataFrame,
    blocks: DataFrame,
    src: DataFrame | None,
    dst: DataFrame,
    info: dict[str, str],
    formats: dict[str, str],
    rules: dict[str, tuple[str, ...]] | None = None,
    lift_end: bool = False,
    write_src: bool = False,
    write_fail: bool = False,
    strict: bool = False,
    **options,
) -> DataFrame:
    """The records in the destination, with swap, flip, n_matches and reject_reason; those rejected are as they were.

    ``info`` and ``formats`` map tags to their Number, ``options`` are those of :func:`liftover.lift`. INFO gets FLIP and SWAP, SRC_CHROM, SRC_POS and
    SRC_REF_ALT with ``write_src``, FAIL5 or FAIL3 with ``write_fail`` where an anchor needed a pad. END is the new record's last base,
    or, with ``lift_end``, lifted itself and missing where contig, strand or order don't agree.
    """
    own = records.columns
    placed = lift(records, blocks, src, dst, **options)
    end = F.try_element_at("info", F.lit("END")).try_cast("long")
    if lift_end:
        placed = lift_points(placed.withColumn("_end", end), blocks, "_end", "e")
    ok = F.col("reject_reason").isNull() & F.col("q_pos").isNotNull()
    s = F.when(ok, F.coalesce(F.col("swap"), F.lit(0))).otherwise(F.lit(0))
    placed = placed.withColumn("_s", s).withColumn("_n", F.size("alleles"))
    rewritten = rewritten_info(F.col("info"), info, F.col("_s"), F.col("_n"), rules, strict)
    symbolic = F.col("swap").isNull()
    if lift_end:
        order = F.when(F.col("flip"), F.col("e_pos") <= F.col("q_pos")).otherwise(F.col("e_pos") >= F.col("q_pos"))
        same = (F.col("e_chrom") == F.col("q_chrom")) & ((F.col("e_strand") == 1) == F.col("flip")) & order
        last = F.when(same, F.col("e_pos").cast("string")).otherwise(".")
    else:
        last = (F.col("q_pos") + F.when(symbolic, end - F.col("pos")).otherwise(F.length(F.get("q_alleles", F.lit(0))) - 1)).cast("string")
    told = {
        "END": F.when(end.isNotNull(), last),
        "FLIP": F.when(F.col("flip"), F.lit("")),
        "SWAP": F.when(F.col("_s") != 0, F.col("_s")),
    }
    if write_src:
        told |= {"SRC_CHROM": F.col("chrom"), "SRC_POS": F.col("pos"), "SRC_REF_ALT": F.array_join("alleles", ",")}
    if write_fail:
        told |= {"FAIL5": F.when(F.col("n_pad5") > 0, F.lit("")), "FAIL3": F.when(F.col("n_pad3") > 0, F.lit(""))}
    new = {"chrom": F.col("q_chrom"), "pos": F.col("q_pos"), "alleles": F.col("q_alleles"), "info": with_info(rewritten, told)}
    if "samples" in own:
        names = records.schema["samples"].dataType.elementType.names
        new["samples"] = rewritten_samples(F.col("samples"), {f: SAMPLE_TAGS.get(f, "") for f in names}, formats, F.col("_s"), F.col("_n"), rules)
    columns = [F.when(ok, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in own]
    told_columns = [F.col(c) for c in TOLD if c in ("flip", "swap", "n_matches", "reject_reason")]
    return placed.select(*columns, *told_columns)


def rejects(lifted: DataFrame) -> DataFrame:
    """Records that weren't lifted, with the reason among their filters."""
    gone = lifted.where(F.col("reject_reason").isNotNull())
    return gone.withColumn("filters", F.array_union(F.coalesce("filters", F.array().cast("array<string>")), F.array("reject_reason"))) if "filters" in lifted.columns else gone
