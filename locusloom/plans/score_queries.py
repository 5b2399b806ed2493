"""Polygenic scores of fifty samples over genotypes and markers derived from orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.operators import score
from locusloom.operators.filters import select_samples
from locusloom.plans.views import view, with_views

THRESHOLDS = (1e-5, 1e-8, 1e-12)


def genotypes(spark: SparkSession, d: str) -> DataFrame:
    """A row for each variant, with all fields of all samples; GP and DS tell the same dosage."""
    ds, n = F.col("ds"), F.col("n_alt")
    gt = F.when(n == 0, F.array(F.lit(0), F.lit(0))).when(n == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(1)))
    sample = F.struct(
        "sample", gt.alias("gt"), F.array(ds).alias("ds"), F.array(ds * 0.4, ds * 0.6).alias("hds"), F.array(ds * 0.3).alias("ap1"), F.array(ds * 0.2).alias("ap2"),
        F.array((1 - ds / 2) * (1 - ds / 2), ds - ds * ds / 2, ds * ds / 4).alias("gp"), (n - 1).cast("int").alias("as_"),
    )
    held = view(spark, d, "dosage").groupBy("vid").agg(F.collect_list(sample).alias("samples"))
    return view(spark, d, "variants").join(held, "vid").select("chrom", "pos", F.concat(F.lit("rs"), F.col("vid").cast("string")).alias("id"), F.array("ref", "alt").alias("alleles"), "samples")


def markers(spark: SparkSession, d: str) -> DataFrame:
    """Two scores, whose effect alleles are alt for even variants and ref for odd ones."""
    rows = view(spark, d, "study_stats").where("study < 2").join(view(spark, d, "variants"), "vid")
    return rows.select(
        F.concat(F.lit("prs"), F.col("study").cast("string")).alias("prs"), "chrom", "pos", F.concat(F.lit("rs"), F.col("vid").cast("string")).alias("id"),
        F.when(F.col("vid") % 2 == 0, F.col("alt")).otherwise(F.col("ref")).alias("a1"), "es", (F.col("ns") / 40.0).alias("lp"), F.col("vid").alias("line"),
    )


def _by_field(use: str, digits: int):
    def run(spark, d):
        return score.score(genotypes(spark, d), markers(spark, d), use).select("sample", "prs", F.round("score", digits).alias("score"))

    return run


def score_thresholds(spark, d):
    out = score.score(genotypes(spark, d), markers(spark, d), "DS", THRESHOLDS, counts=True)
    return out.select("sample", "prs", "thr", F.round("score", 6).alias("score"), "n")


def score_counts(spark, d):
    out = score.score(genotypes(spark, d), markers(spark, d), "AS", counts=True)
    return out.select("sample", "prs", F.round("score", 9).alias("score"), "n")


def score_pivot(spark, d):
    out = score.score(genotypes(spark, d), markers(spark, d), "DS", THRESHOLDS, counts=True).withColumn("score", F.round("score", 6))
    return score.matrix(out, ["prs0", "prs1"], THRESHOLDS, counts=True)


def score_association(spark, d):
    """Markers of association tables: exact alleles, null effects skipped, null lp never passes."""
    v = F.col("vid")
    rows = view(spark, d, "study_stats").join(view(spark, d, "variants"), "vid")
    rows = rows.select(
        F.concat(F.lit("prs"), F.col("study").cast("string")).alias("prs"), "chrom", "pos",
        F.when(v % 3 == 0, F.col("alt")).otherwise(F.col("ref")).alias("ref"), F.when(v % 3 == 0, F.col("ref")).otherwise(F.col("alt")).alias("alt"),
        F.when(v % 5 > 0, F.col("es")).alias("es"), F.when(v % 7 > 0, F.col("ns") / 40.0).alias("lp"),
    )
    out = score.score(genotypes(spark, d), rows, "DS", THRESHOLDS, counts=True, association=True)
    return out.select("sample", "prs", "thr", F.round("score", 6).alias("score"), "n")


def score_matched(spark, d):
    rows = score.matched(genotypes(spark, d), score.first_markers(markers(spark, d)))
    return rows.groupBy("prs").agg(F.count("*").alias("n_matched"), F.count_if(F.col("_allele") == 0).alias("n_reference"))


def _doubled(spark, d) -> DataFrame:
    """Markers with a later copy of each that tells another effect."""
    rows = markers(spark, d)
    return rows.unionByName(rows.withColumn("es", F.col("es") + 1).withColumn("line", F.col("line") + 1_000_000_000))


def score_by_id(spark, d):
    return score.score(genotypes(spark, d), markers(spark, d), "GT", by_id=True).select("sample", "prs", F.round("score", 9).alias("score"))


def score_by_pos(spark, d):
    return score.score(genotypes(spark, d), markers(spark, d).drop("id"), "GT").select("sample", "prs", F.round("score", 9).alias("score"))


def score_first_wins(spark, d):
    return score.score(genotypes(spark, d), _doubled(spark, d), "GT").select("sample", "prs", F.round("score", 9).alias("score"))


def score_auto_field(spark, d):
    """Without a named field DS is taken, as all fields are there."""
    return score.score(genotypes(spark, d), markers(spark, d)).select("sample", "prs", F.round("score", 6).alias("score"))


def samples_subset(spark, d):
    rows = view(spark, d, "dosage")
    own = select_samples(rows, list(range(0, 50, 3)))
    return own.groupBy("sample").agg(F.count("*").alias("n"), F.round(F.sum("ds"), 6).alias("total"))


QUERIES = {
    "score_gt": _by_field("GT", 9), "score_ds": _by_field("DS", 6), "score_hds": _by_field("HDS", 6), "score_ap": _by_field("AP", 6), "score_gp": _by_field("GP", 6), "score_as": _by_field("AS", 9),
    "score_thresholds": score_thresholds, "score_counts": score_counts, "score_association": score_association, "score_pivot": score_pivot, "score_matched": score_matched, "score_by_id": score_by_id, "score_by_pos": score_by_pos,
    "score_first_wins": score_first_wins, "score_auto_field": score_auto_field, "samples_subset": samples_subset,
}


def _sql(alt: str, ref: str, digits: int, where: str = "", more: str = "", group: str = "") -> str:
    dosage = f"case when s.vid % 2 = 0 then {alt} else {ref} end"
    return f"select sample, 'prs'||study::varchar as prs{group}, round(sum(es*({dosage})), {digits}) as score{more} from study_stats s join dosage g on s.vid = g.vid where study < 2{where} group by all"


_GT = _sql("n_alt", "2-n_alt", 9)
_DS = _sql("ds", "2-ds", 6)
_AS = _sql("n_alt-1", "1-n_alt", 9, " and n_alt <> 1")
_THR = ", ".join(str(t) for t in THRESHOLDS)

ORACLES = {k: with_views(v) for k, v in {
    "score_gt": _GT, "score_by_id": _GT, "score_by_pos": _GT, "score_first_wins": _GT, "score_ds": _DS, "score_hds": _DS, "score_auto_field": _DS,
    "score_ap": _sql("ds*0.3::double+ds*0.2::double", "2-ds*0.3::double-ds*0.2::double", 6), "score_gp": _DS, "score_as": _AS,
    "score_thresholds": f"with t as (select unnest([{_THR}])::double as thr) select sample, 'prs'||study::varchar as prs, thr, round(sum(es*(case when s.vid % 2 = 0 then ds else 2-ds end)), 6) as score, count(*) as n from study_stats s join dosage g on s.vid = g.vid join t on not (ns/40.0 < -log10(thr)) where study < 2 group by all",
    "score_counts": _sql("n_alt-1", "1-n_alt", 9, " and n_alt <> 1", ", count(*) as n"),
    "score_pivot": f"with t as (select unnest([{_THR}])::double as thr), r as (select sample, study, thr, sum(es*(case when s.vid % 2 = 0 then ds else 2-ds end)) as score, count(*) as n from study_stats s join dosage g on s.vid = g.vid join t on not (ns/40.0 < -log10(thr)) where study < 2 group by all) select sample, "
    + ", ".join(f"round(sum(case when study = {k} and thr = {t}::double then score end), 6) as \"prs{k}_p{t:.6g}\", coalesce(sum(case when study = {k} and thr = {t}::double then n end), 0)::bigint as \"prs{k}_CNT_p{t:.6g}\"" for k in (0, 1) for t in THRESHOLDS)
    + " from r group by sample",
    "score_association": f"with t as (select unnest([{_THR}])::double as thr) select sample, 'prs'||study::varchar as prs, thr, round(sum(es*ds), 6) as score, count(*) as n from study_stats s join dosage g on s.vid = g.vid join t on ns/40.0 >= -log10(thr) where s.vid % 3 > 0 and s.vid % 5 > 0 and s.vid % 7 > 0 group by all",
    "score_matched": "select 'prs'||study::varchar as prs, count(*) as n_matched, count(*) filter (where s.vid % 2 = 1) as n_reference from study_stats s where study < 2 and vid in (select vid from dosage) group by 1",
    "samples_subset": "select sample, count(*) as n, round(sum(ds), 6) as total from dosage where sample % 3 = 0 group by sample",
}.items()}
