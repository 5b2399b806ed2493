"""Allele dosages of genotype fields, as Column expressions: an array with a dosage for each allele, null if missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def _whole(a: Column) -> Column:
    """Whether an array is there and holds no nulls."""
    return a.isNotNull() & ~F.exists(a, lambda x: x.isNull())


def _alleles(n: Column) -> Column:
    return F.sequence(F.lit(0), n.cast("int") - 1)


def from_gt(gt: Column, n_alleles: Column) -> Column:
    """Counts of each allele among the called ones, one or two."""
    count = F.transform(_alleles(n_alleles), lambda a: F.size(F.filter(gt, lambda g: g == a)).cast("double"))
    return F.when(_whole(gt) & (F.size(gt) > 0), count)


def from_ds(ds: Column) -> Column:
    """Dosages of the alternative alleles; the rest of two is the reference's."""
    d = F.transform(ds, lambda x: x.cast("double"))
    return F.when(_whole(ds), F.concat(F.array(2.0 - _sum(d)), d))


def from_hds(hds: Column) -> Column:
    alt = F.get(hds, F.lit(0)).cast("double") + F.get(hds, F.lit(1)).cast("double")
    return F.when(_whole(hds) & (F.size(hds) == 2), F.array(2.0 - alt, alt))


def from_ap(ap1: Column, ap2: Column) -> Column:
    """Allele probabilities of both haplotypes."""
    one, two = (F.transform(x, lambda y: y.cast("double")) for x in (ap1, ap2))
    return F.when(_whole(ap1) & _whole(ap2), F.concat(F.array(2.0 - _sum(one) - _sum(two)), F.zip_with(one, two, lambda a, b: a + b)))


def from_gp(gp: Column, n_alleles: Column) -> Column:
    """Genotype probabilities, in the order where (a, b), a <= b, is at b (b + 1) / 2 + a."""
    at = lambda a, b: F.get(gp, (F.greatest(a, b) * (F.greatest(a, b) + 1) / 2 + F.least(a, b)).cast("int")).cast("double")
    total = F.transform(_alleles(n_alleles), lambda a: _sum(F.transform(_alleles(n_alleles), lambda b: F.when(a == b, 2 * at(a, b)).otherwise(at(a, b)))))
    return F.when(_whole(gp), total)


def from_as(shift: Column) -> Column:
    """Allelic shift of a heterozygote: against the reference, for the alternative."""
    s = shift.cast("double")
    return F.when(s.isNotNull() & (s != 0), F.array(-s, s))


#: Fields in the order in which they are taken if present.
PRIORITY = ("DS", "GP", "AP", "HDS", "GT")


def dosages(use: str, sample: Column, n_alleles: Column) -> Column:
    """By the name of a field of the sample struct (gt, ds, hds, ap1 and ap2, gp, as_)."""
    builders = {
        "GT": lambda: from_gt(sample["gt"], n_alleles), "DS": lambda: from_ds(sample["ds"]), "HDS": lambda: from_hds(sample["hds"]),
        "AP": lambda: from_ap(sample["ap1"], sample["ap2"]), "GP": lambda: from_gp(sample["gp"], n_alleles), "AS": lambda: from_as(sample["as_"]),
    }
    if use not in builders:
        raise ValueError(f"unknown field {use}")
    return builders[use]()
