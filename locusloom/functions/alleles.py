"""Contigs, alleles and numbers of summary-statistics text, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of the sex chromosomes and the mitochondrion.
X_NAMES = ("23", "25", "XY", "XX", "PAR1", "PAR2", "X", "chrX")
Y_NAMES = ("24", "Y", "chrY")
MT_NAMES = ("26", "MT", "chrM", "M", "chrMT")
#: IUPAC codes, their complements, and brackets that mirror.
IUPAC, COMPLEMENT = "ACGTURYSWKMBDHVNacgturyswkmbdhvn[]<>", "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn][><"


def resolve_contig(raw: Column, contigs: Sequence[str]) -> Column:
    """The name in ``contigs`` that ``raw`` means, or null: as it is, without or with ``chr``, or by alias."""
    known = lambda c: F.when(c.isin(list(contigs)), c)
    bare = F.when(F.startswith(raw, F.lit("chr")), F.substring(raw, 4, 1 << 30)).otherwise(raw)
    first = lambda names: next((n for n in names if n in contigs), None)
    parts = [known(raw), known(bare), known(F.concat(F.lit("chr"), bare))]
    for names, own in ((X_NAMES, ("X", "chrX")), (Y_NAMES, ("Y", "chrY")), (MT_NAMES, ("MT", "chrM"))):
        if (name := first(own)) is not None:
            parts.append(F.when(raw.isin(list(names)), F.lit(name)))
    return F.coalesce(*parts)


def p_to_lp(p: Column) -> Column:
    """-log10 of a number given as text, however small: the mantissa's logarithm and the exponent apart."""
    text = F.lower(F.trim(p))
    before = F.substring_index(text, "e", 1)
    mantissa = before.try_cast("double")
    exponent = F.when(F.length(before) < F.length(text), F.substr(text, F.length(before) + 2).try_cast("int")).otherwise(0)
    return F.when(mantissa == 0, float("inf")).otherwise(-F.log10(mantissa) - exponent)  # no logarithm of less than nothing


def strict_number(text: Column) -> Column:
    """``text``, an error where it is neither a number nor a missing mark: nothing, or what begins with ``.`` or ``NA``."""
    known = text.isNull() | F.trim(text).try_cast("double").isNotNull() | F.trim(text).rlike(r"^(\.|NA|$)")
    return F.when(known, text).otherwise(F.raise_error(F.concat(F.lit("not a number: "), text)))


def strict_position(text: Column) -> Column:
    """``text``, an error where it isn't a whole number."""
    return F.when(text.isNull() | F.trim(text).try_cast("bigint").isNotNull(), text).otherwise(F.raise_error(F.concat(F.lit("not a position: "), text)))


def number(text: Column) -> Column:
    """A number, or null for a missing mark."""
    return F.trim(text).try_cast("double")


def identifier(text: Column) -> Column:
    return F.when((F.upper(text) != "NA") & (text != ".") & (text != ""), text)


def munge_allele(raw: Column) -> Column:
    """Symbolic alleles in angle brackets, digits as letters, others in upper case."""
    symbolic = F.upper(F.substring(raw, 1, 1)).isin("D", "I") | raw.contains("+")
    return (
        F.when(F.substring(raw, 1, 1).isin("<", "*"), raw)
        .when(symbolic, F.concat(F.lit("<"), raw, F.lit(">")))
        .when(raw.rlike("^[1-4]$"), F.translate(raw, "1234", "ACGT"))
        .otherwise(F.upper(raw))
    )


def flip_direction(ed: Column) -> Column:
    return F.translate(ed, "+-", "-+")


def reverse_complement(allele: Column) -> Column:
    return F.reverse(F.translate(allele, IUPAC, COMPLEMENT))


def strand_flip(allele: Column) -> Column:
    """The allele on the other strand; symbolic and overlapping-deletion alleles stay."""
    return F.when(F.startswith(allele, F.lit("<")) | (allele == "*"), allele).otherwise(reverse_complement(allele))


def harmonise(a1: Column, a2: Column, reference: Column) -> Column:
    """swap, same, iffy or mismatch: which of effect allele a1 and other allele a2 the reference begins with."""
    up = F.upper(reference)
    one, two = F.startswith(up, F.upper(a1)), F.startswith(up, F.upper(a2))
    return F.when(one & two, "iffy").when(one, "swap").when(two, "same").otherwise("mismatch")
