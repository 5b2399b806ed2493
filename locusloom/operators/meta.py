"""Fixed-effect meta-analysis of studies in tidy form: a row for each variant and study.

Key columns are chrom, pos, ref, alt (others by ``key``); a study has an ordinal ``study`` and any of es, se, ez,
lp, ns, nc, ne, af, ac, id, filters. Everything is one aggregation by key with partial sums, whatever
the number of studies; nothing is joined.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from locusloom.functions.stats import chi2_lp, correlation_from_truncated, effective_n, two_sided_lp, with_abs_z

KEY = ("chrom", "pos", "ref", "alt")
SUMMED = ("ns", "nc", "ac", "ne")


def _known(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def with_z(studies: DataFrame, scheme: str = "szw") -> DataFrame:
    """Add ``z``: of ``szw`` ez, else the quantile of lp with the sign of es; of ``ivw`` es/se; of ``blup`` ez, es/se or the quantile."""
    has = set(studies.columns)
    null = F.lit(None).cast("double")
    if scheme == "ivw":
        return studies.withColumn("z", F.try_divide("es", "se") if {"es", "se"} <= has else null)
    parts: list[Column] = [F.nanvl("ez", null)] if "ez" in has else []
    if scheme == "blup" and {"es", "se"} <= has:
        parts.append(F.try_divide("es", "se"))
    if {"es", "lp"} <= has:
        studies = with_abs_z(studies, "lp", "_zlp")
        parts.append(F.when(F.col("es") < 0, -1.0).when(F.col("es") >= 0, 1.0) * F.col("_zlp"))
    return studies.withColumn("z", F.coalesce(*parts, null)).drop("_zlp")


def has_z(studies: DataFrame) -> Column:
    """Whether the ``szw`` z of :func:`with_z` is there, told from what it is made of: a filter on z itself would work it out twice."""
    out = F.lit(False)
    if "ez" in studies.columns:
        out = _known(F.col("ez"))
    if {"es", "lp"} <= set(studies.columns):
        out |= _known(F.col("es")) & _known(F.col("lp")) & (F.col("lp") >= 0) & (F.col("lp") < float("inf"))
    return F.coalesce(out, F.lit(False))


def with_effective_n(studies: DataFrame) -> DataFrame:
    null = F.lit(None).cast("double")
    get = lambda c: F.col(c) if c in studies.columns else null
    return studies.withColumn("ne", effective_n(get("ne"), get("ns"), get("nc")))


def _all_or_null(c: str) -> Column:
    """The sum, missing if any contributor lacks the value."""
    return F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c)


def _direction(n_studies: int) -> Column:
    """A sign for each study in order, ? where it doesn't contribute."""
    given = F.sort_array(F.collect_list(F.struct("study", F.col("_sign").alias("s"))))
    signs = F.map_from_entries(given)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n_studies - 1)), lambda i: F.coalesce(F.try_element_at(signs, i.cast("int")), F.lit("?"))), "")


def combine(studies: DataFrame, scheme: str = "ivw", het: bool = False, n_studies: int | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """Inverse-variance (``ivw``: es, se) or sample-size (``szw``: ez, or lp and the sign of es) weighted combination.

    ``het`` adds Cochran's i2 and cq (null with one study); ``n_studies`` adds the direction string ed; sums of ns, nc, ac, ne
    and the weighted mean af are missing if a contributor lacks them. Rows that can't contribute are left out.
    """
    key = list(key)
    if scheme == "ivw":
        rows = studies.where(_known(F.col("es")) & _known(F.col("se")) & (F.col("se") > 0))
        rows = rows.withColumn("_w", 1 / (F.col("se") * F.col("se"))).withColumn("_wx", F.col("_w") * F.col("es")).withColumn("_x", F.col("es"))
    elif scheme == "szw":
        rows = with_effective_n(studies.where(has_z(studies)))
        rows = with_z(rows.where(_known(F.col("ne")) & (F.col("ne") > 0)))
        rows = rows.withColumn("_w", F.col("ne").cast("double")).withColumn("_wx", F.col("z") * F.sqrt("ne")).withColumn("_x", F.col("z"))
    else:
        raise ValueError("scheme is 'ivw' or 'szw'")
    spread = F.col("_wx") * F.col("_x") if scheme == "ivw" else F.col("_x") * F.col("_x")
    rows = rows.withColumn("_spread", spread)
    aggs = [F.sum("_w").alias("_w"), F.sum("_wx").alias("_wx"), F.sum("_spread").alias("_spread"), (F.count("*") - 1).cast("int").alias("_df")]
    aggs += [_all_or_null(c) for c in SUMMED if c in rows.columns]
    if "af" in rows.columns:
        rows = rows.withColumn("_waf", F.col("_w") * F.col("af"))
        aggs.append(F.when(F.count("af") == F.count("*"), F.sum("_waf") / F.sum("_w")).alias("af"))
    if "id" in rows.columns:
        aggs.append(F.array_join(F.array_sort(F.collect_set("id")), ";").alias("id"))
    if "filters" in rows.columns:
        aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list("filters")))).alias("filters"))
    if n_studies:
        rows = rows.withColumn("_sign", F.when(F.col("_x") > 0, "+").when(F.col("_x") < 0, "-").otherwise("0"))
        aggs.append(_direction(n_studies).alias("ed"))
    out = rows.groupBy(*key).agg(*aggs)
    out = out.withColumn("_z", F.abs(F.col("_wx") / F.sqrt("_w")))
    if scheme == "ivw":
        out = out.withColumn("es", F.col("_wx") / F.col("_w")).withColumn("se", 1 / F.sqrt("_w"))
    else:
        out = out.withColumn("ez", F.col("_wx") / F.sqrt("_w"))
    out = out.withColumn("lp", two_sided_lp("_z"))
    if het:
        out = out.withColumn("_q", F.greatest(F.col("_spread") - F.col("_wx") * F.col("_wx") / F.col("_w"), F.lit(0.0))).withColumn("_root", F.sqrt("_q"))
        some = F.col("_df") > 0
        i2 = F.when(F.col("_q") > 0, F.greatest((F.col("_q") - F.col("_df")) / F.col("_q"), F.lit(0.0)) * 100).otherwise(0.0)
        out = out.withColumn("i2", F.when(some, i2)).withColumn("cq", F.when(some, chi2_lp("_q", "_df")))
    return out.drop("_w", "_wx", "_spread", "_df", "_z", "_q", "_root")


def output_fields(studies: Sequence[set[str]], scheme: str, het: bool = False, overlap: bool = False) -> list[str]:
    """The fields that a combination of studies with these fields has."""
    everywhere = set.intersection(*map(set, studies)) if studies else set()
    out = ["es", "se"] if scheme == "ivw" else ["ez"]
    out.append("lp")
    if "af" in everywhere:
        out.append("af")
    if not overlap:
        out += [c for c in ("ns", "nc", "ac") if c in everywhere]
    if overlap and scheme == "szw" or (scheme == "ivw" and {"ns", "ne"} & everywhere):
        out.append("ne")
    return out + (["i2", "cq"] if het else [])


#: Numbers of a dense piece of variants by studies, 32 MB in double precision.
PIECE = 1 << 22


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, starts) of a list column without null lists; missing values are NaN."""
    lists = batch.column(name)
    values = lists.flatten()
    if pa.types.is_floating(values.type):
        values = values.fill_null(float("nan"))
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=starts[1:])
    return values.to_numpy(zero_copy_only=False), starts


def _product_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a task's variants of z_a z_b and of 1, a row for each pair of its studies."""
    known, total, count = np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros((0, 0))
    for batch in batches:
        own, starts = _lists(batch, "_k")
        z, _ = _lists(batch, "_z")
        every = np.union1d(known, own)
        if len(every) > len(known):
            at = np.ix_(*[np.searchsorted(every, known)] * 2)
            wider = np.zeros((2, len(every), len(every)))
            wider[0][at], wider[1][at] = total, count
            known, (total, count) = every, wider
        column, row = np.searchsorted(known, own), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        step = max(1, PIECE // max(len(known), 1))
        for first in range(0, len(starts) - 1, step):
            part = slice(starts[first], starts[min(first + step, len(starts) - 1)])
            shape = (min(step, len(starts) - 1 - first), len(known))
            cell = (row[part] - first) * len(known) + column[part]
            values = np.bincount(cell, z[part], shape[0] * shape[1]).reshape(shape)
            there = np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape).astype(float)
            total += values.T @ values
            count += there.T @ there
    i, j = np.nonzero(np.triu(count, 1))
    yield pa.RecordBatch.from_arrays([pa.array(known[i]), pa.array(known[j]), pa.array(total[i, j]), pa.array(count[i, j].astype(np.int64))], ["a", "b", "total", "n"])


def truncated_products(studies: DataFrame, key: Sequence[str] = KEY, scheme: str = "szw") -> DataFrame:
    """(a, b, mean, n) for pairs of studies: the mean of z_a z_b over variants where both lie in [-1, 1].

    A task holds two square matrices of its studies and adds its variants to them by matrix products, some millions of numbers at a time;
    only the sums are shuffled further. Studies are whole numbers.
    """
    kind = dict(studies.dtypes)["study"]
    null_like = with_z(studies, scheme).where(F.col("z").between(-1.0, 1.0) & F.col("study").isNotNull())
    one = F.struct(F.col("study").cast("long").alias("study"), F.col("z").cast("double").alias("z"))
    rows = null_like.groupBy(*key).agg(F.collect_list(one).alias("_s"))  # a struct for each study
    sums = rows.where(F.size("_s") > 1).select(F.col("_s.study").alias("_k"), F.col("_s.z").alias("_z")).mapInArrow(_product_sums, "a long, b long, total double, n long")
    pairs = sums.groupBy("a", "b").agg((F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    return pairs.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "mean", "n")


def overlap_correlations(studies: DataFrame, n_studies: int, key: Sequence[str] = KEY, scheme: str = "szw") -> np.ndarray:
    """Correlations of the studies' null statistics, 0 for pairs without shared variants."""
    rho = np.eye(n_studies)
    for r in truncated_products(studies, key, scheme).collect():  # a row for each pair of studies
        rho[r.a, r.b] = rho[r.b, r.a] = correlation_from_truncated(r.mean)
    return rho


def presence_patterns(studies: DataFrame, n_studies: int, key: Sequence[str] = KEY) -> DataFrame:
    """(pattern, n): which studies have a variant, as a string of 0 and 1."""
    mine = F.transform(F.sequence(F.lit(0), F.lit(n_studies - 1)), lambda i: F.when(F.array_contains("_s", i.cast("int")), "1").otherwise("0"))
    held = studies.groupBy(*key).agg(F.collect_set(F.col("study").cast("int")).alias("_s"))
    return held.groupBy(F.array_join(mine, "").alias("pattern")).agg(F.count("*").alias("n"))


def _forms(rho: np.ndarray, key: list[str]):
    """The quadratic forms of each variant in the inverse correlations of its studies.

    Variants come sorted by their studies within a partition, so a run of equal patterns takes one inverse and a few
    matrix products, and only the last pattern's inverse is held.
    """

    def inverse(pattern: np.ndarray) -> np.ndarray:
        own = rho[np.ix_(pattern, pattern)]
        try:
            return np.linalg.inv(own)
        except np.linalg.LinAlgError:  # studies that are the same
            return np.linalg.pinv(own, hermitian=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, r = None, np.zeros((0, 0))
        for batch in batches:
            studies, starts = _lists(batch, "_k")
            columns = [_lists(batch, c)[0] for c in ("_zs", "_ws", "_afs", "_roots")]
            sizes, out = np.diff(starts), np.empty((5, batch.num_rows))
            patterns = [studies[x:y].tobytes() for x, y in zip(starts[:-1], starts[1:], strict=True)]
            first = 0
            while first < batch.num_rows:
                last = first + 1
                while last < batch.num_rows and patterns[last] == patterns[first]:
                    last += 1
                if patterns[first] != held:
                    held, r = patterns[first], inverse(studies[starts[first] : starts[first + 1]])
                z, w, af, root = (c[starts[first] : starts[last]].reshape(last - first, sizes[first]) for c in columns)
                rw = w @ r
                out[:, first:last] = (rw * w).sum(1), (rw * z).sum(1), ((z @ r) * z).sum(1), ((root @ r) * root).sum(1), (rw * w * af).sum(1)
                first = last
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in key], *map(pa.array, out), pa.array(sizes - 1, pa.int32())], [*key, "_n", "_x", "_q0", "ne", "_af", "_df"])

    return run


def combine_overlapping(studies: DataFrame, rho: np.ndarray, scheme: str = "ivw", het: bool = False, key: Sequence[str] = KEY) -> DataFrame:
    """Combination that allows for correlated null statistics.

    With the inverse R of the correlations among a variant's studies, N = w'Rw and x = z'Rw for weights w (1/se or
    sqrt(ne)): es = x/N, se = 1/sqrt(N), ez = x/sqrt(N), ne = sqrt(ne)'R sqrt(ne), and af is weighted alike; ne and af are missing
    if a contributor lacks them. Each pattern of studies is inverted once in a partition, whatever the number of studies,
    and there may be as many patterns as variants. Where studies are the same (singular correlations) the pseudo-inverse is taken.
    """
    key = list(key)
    rows = with_effective_n(with_z(studies, scheme)).where(_known(F.col("z")))
    weight = F.when(F.col("se") > 0, F.try_divide(F.lit(1.0), F.col("se"))) if scheme == "ivw" else F.when(F.col("ne") > 0, F.sqrt("ne"))
    rows = rows.withColumn("_w", weight.cast("double")).where(_known(F.col("_w")))
    af = F.col("af") if "af" in rows.columns else F.lit(None).cast("double")
    one = F.struct(F.col("study").cast("int").alias("study"), "z", F.col("_w").alias("w"), af.cast("double").alias("af"), F.sqrt("ne").alias("root"))
    held = rows.groupBy(*key).agg(F.sort_array(F.collect_list(one)).alias("_s"))
    lists = {"_k": "study", "_zs": "z", "_ws": "w", "_afs": "af", "_roots": "root"}
    held = held.select(*key, *[F.col(f"_s.{f}").alias(c) for c, f in lists.items()]).sortWithinPartitions("_k")
    fields = StructType([held.schema[c] for c in key] + [StructField(c, DoubleType()) for c in ("_n", "_x", "_q0", "ne", "_af")] + [StructField("_df", IntegerType())])
    held = held.mapInArrow(_forms(np.asarray(rho, float), key), fields)
    null = F.lit(None).cast("double")
    held = held.withColumn("ne", F.nanvl("ne", null)).withColumn("af", F.nanvl(F.col("_af") / F.col("_n"), null)).withColumn("_z", F.abs("_x") / F.sqrt("_n"))
    if scheme == "ivw":
        held = held.withColumn("es", F.col("_x") / F.col("_n")).withColumn("se", 1 / F.sqrt("_n"))
    else:
        held = held.withColumn("ez", F.col("_x") / F.sqrt("_n"))
    held = held.withColumn("lp", two_sided_lp("_z"))
    if het:
        held = held.withColumn("_q", F.greatest(F.col("_q0") - F.col("_x") * F.col("_x") / F.col("_n"), F.lit(0.0))).withColumn("_root", F.sqrt("_q"))
        i2 = F.when(F.col("_q") > 0, F.greatest((F.col("_q") - F.col("_df")) / F.col("_q"), F.lit(0.0)) * 100).otherwise(0.0)
        held = held.withColumn("i2", F.when(F.col("_df") > 0, i2)).withColumn("cq", F.when(F.col("_df") > 0, chi2_lp("_q", "_df")))
    return held.drop("_n", "_x", "_q0", "_af", "_z", "_df", "_q", "_root")
