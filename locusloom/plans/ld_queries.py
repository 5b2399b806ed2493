"""Linkage-disequilibrium models over blocks of twenty nodes derived from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.operators import gibbs, ld, tables
from locusloom.plans.views import view, with_views

BETA_COV, CROSS, TOLERANCE = 0.01, 0.9, 1e-13


def nodes(spark: SparkSession, d: str, pops: int = 1) -> DataFrame:
    """Nodes of each population with the association of the study of its number."""
    own = view(spark, d, "ld_nodes")
    stats = view(spark, d, "study_stats").select("vid", F.col("study").alias("_study"), (F.col("es") / F.col("se")).alias("z"), F.col("ns").cast("double").alias("n"))
    every = own.withColumn("pop", F.explode(F.sequence(F.lit(0), F.lit(pops - 1))))
    joined = every.join(stats, (every["vid"] == stats["vid"]) & (F.col("pop") == F.col("_study")), "left").drop(stats["vid"]).drop("_study")
    return joined.withColumn("pop", F.concat(F.lit("P"), F.col("pop").cast("string")))


def edges(spark: SparkSession, d: str, pops: int = 1) -> DataFrame:
    every = view(spark, d, "ld_edges").withColumn("pop", F.explode(F.sequence(F.lit(0), F.lit(pops - 1))))
    return every.select("ld_block", F.concat(F.lit("P"), F.col("pop").cast("string")).alias("pop"), "i", "j", "w")


def _ldgm(spark, d) -> DataFrame:
    """Nodes with their later neighbours as arrays."""
    later = view(spark, d, "ld_edges").groupBy("ld_block", F.col("i").alias("ld_node")).agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("_e"))
    held = view(spark, d, "ld_nodes").join(later, ["ld_block", "ld_node"], "left").withColumn("pop", F.lit("P0"))
    none = F.coalesce("_e", F.array().cast("array<struct<j:bigint,w:double>>"))
    return held.withColumn("ld_neighbors", F.transform(none, lambda x: x["j"])).withColumn("ld_weights", F.transform(none, lambda x: x["w"])).drop("_e")


def ld_edges(spark, d):
    return ld.symmetric(ld.edges_of(_ldgm(spark, d))).select("ld_block", "i", "j", "w")


def export_ldgm(spark, d):
    return tables.precision_edges(_ldgm(spark, d))


def ld_checked(spark, d):
    """Rows with a neighbour before them or without a frequency are told apart."""
    rows = _ldgm(spark, d)
    rows = rows.withColumn("af", F.when(F.col("vid") % 13 > 0, F.col("af"))).withColumn("ld_neighbors", F.when(F.col("vid") % 11 == 0, F.transform("ld_neighbors", lambda x: x - 2)).otherwise(F.col("ld_neighbors")))
    good, bad = ld.checked(rows)
    return good.select("vid", F.lit(True).alias("good")).unionByName(bad.select("vid", F.lit(False).alias("good")))


def ld_association(spark, d):
    """Pairs of markers on one node; the first with an association stands for it."""
    v = view(spark, d, "variants")
    own = _ldgm(spark, d).withColumn("ld_node", F.col("ld_node") - F.col("ld_node") % 2).join(v, "vid")
    stats = v.join(view(spark, d, "study_stats").where("study = 0 and vid % 3 > 0"), "vid").withColumn("z", F.col("es") / F.col("se")).withColumn("n", F.col("ns"))
    return ld.with_association(own, stats).select("ld_block", "ld_node", "vid", F.round("z", 8).alias("z"), "n")


def ld_table(spark, d):
    """Markers, some swapped, with the edge list of their blocks."""
    v = view(spark, d, "variants").select("vid", "chrom", "pos", F.col("ref").alias("anc"), F.col("alt").alias("deriv"))
    snps = view(spark, d, "ld_nodes").select("ld_block", "ld_node", "vid", "af").join(v, "vid").withColumn("swapped", F.col("vid") % 4 == 0)
    loops = view(spark, d, "ld_nodes").where("vid % 7 > 0").select("ld_block", F.col("ld_node").alias("i"), F.col("ld_node").alias("j"), F.col("ld_diagonal").alias("w"))
    out = ld.from_edge_list(snps, view(spark, d, "ld_edges").where("i % 5 > 0").unionByName(loops))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("ld_block", "ld_node", "chrom", "pos", "ref", "alt", "aa", F.round("af", 6).alias("af"), "ld_diagonal", text("ld_neighbors"), F.round(F.get("ld_weights", F.lit(0)), 6).alias("weight"))


def ld_nodes(spark, d):
    out = ld.node_map(nodes(spark, d, 2).where("z is not null"))
    return out.select("ld_block", "ld_node", F.array_join("pops", ",").alias("pops"))


def _summary(correct: bool, *columns: str):
    def run(spark, d):
        out = ld.summary(nodes(spark, d, 4), correct=correct)
        return out.select("pop", *[F.round(c, 9).alias(c) if c not in ("missing", "non_missing") else F.col(c) for c in columns])

    return run


def ld_block_median(spark, d):
    rows = ld.node_statistics(nodes(spark, d)).where("z is not null")
    return rows.groupBy("ld_block").agg(F.round(F.median("alpha_hat"), 9).alias("median_a"), F.round(F.median(F.col("alpha_hat") * F.col("alpha_hat")), 9).alias("median_a2"), F.round(F.avg("n"), 6).alias("mean_n"))


def ld_sigma(spark, d):
    out = ld.prior_covariance(nodes(spark, d, 2), BETA_COV, CROSS)
    return out.select("ld_block", "ld_node", "pop1", "pop2", F.round("sigma", 10).alias("sigma"))


def _effects(df: DataFrame) -> DataFrame:
    return df.select("ld_block", "pop", "ld_node", F.round("es", 7).alias("es"))


def blup_diag(spark, d):
    return _effects(ld.blup(nodes(spark, d), edges(spark, d).where(F.lit(False)), beta_cov=BETA_COV, tolerance=TOLERANCE))


def blup_pair(spark, d):
    own = nodes(spark, d).where("ld_node < 2")
    return _effects(ld.blup(own, edges(spark, d).where("i = 0"), beta_cov=BETA_COV, tolerance=TOLERANCE))


def blup_full(spark, d):
    return _effects(ld.blup(nodes(spark, d, 2), edges(spark, d, 2), beta_cov=BETA_COV, cross_corr=CROSS, tolerance=TOLERANCE))


def blup_spread(spark, d):
    """All blocks as if they were too large for a task: the same as blup_full."""
    return _effects(ld.blup(nodes(spark, d, 2), edges(spark, d, 2), beta_cov=BETA_COV, cross_corr=CROSS, tolerance=1e-11, task_rows=0))


def pgs_burn_in(spark, d):
    """With no more iterations than the burn-in: the same as blup_full."""
    return _effects(gibbs.pgs(nodes(spark, d, 2), edges(spark, d, 2), beta_cov=BETA_COV, cross_corr=CROSS, tolerance=TOLERANCE, iterations=2, burn_in=2))


def pgs_gibbs(spark, d):
    return _effects(gibbs.pgs(nodes(spark, d), edges(spark, d), beta_cov=BETA_COV, iterations=10, burn_in=2, seed=7, max_alpha2=0.05, herit_per_marker=1e-3))


def ld_matrices(spark, d):
    out = ld.system_entries(nodes(spark, d, 2), edges(spark, d, 2), beta_cov=BETA_COV, cross_corr=CROSS)
    return out.withColumn("value", F.round("value", 9))


def ld_vectors(spark, d):
    out = ld.system_vectors(nodes(spark, d, 2))
    return out.select("ld_block", "pop", "ld_node", "seen", *[F.round(c, 9).alias(c) for c in ("alpha_hat", "effect", "sd")])


def bayes_factor(spark, d):
    rows = ld.node_statistics(nodes(spark, d)).where("z is not null and alpha_hat is not null")
    return rows.select("ld_block", "ld_node", F.round(gibbs.log_bayes_factor_of(F.col("sd"), F.col("alpha_hat"), F.col("n"), 0.05), 8).alias("log_bf"))


QUERIES = {
    "ld_edges": ld_edges, "export_ldgm": export_ldgm, "ld_checked": ld_checked, "ld_nodes": ld_nodes, "ld_missing": _summary(False, "non_missing", "missing", "trace_inf"), "ld_block_median": ld_block_median,
    "ld_lambda": _summary(False, "lambda_gc", "sigmasq_inf", "beta_cov"), "ld_lambda_corrected": _summary(True, "lambda_gc", "sigmasq_inf", "beta_cov"), "ld_sigma": ld_sigma,
    "ld_alpha2": _summary(False, "max_alpha2", "sum_alpha2"), "ld_association": ld_association, "ld_table": ld_table,
    "blup_diag": blup_diag, "blup_pair": blup_pair, "blup_full": blup_full, "blup_spread": blup_spread, "pgs_burn_in": pgs_burn_in, "pgs_gibbs": pgs_gibbs, "bayes_factor": bayes_factor,
    "ld_matrices": ld_matrices, "ld_vectors": ld_vectors,
}

_NODES = lambda pops: f"k as (select l.*, p, es/se as z, case when es is not null then ns end as n, (case when aa = 1 then -1 else 1 end)*(es/se)/sqrt(ns) as a, pow(sqrt(2*af_*(1-af_)), 0.5) as sd from (select ld_block, ld_node, vid as lvid, aa, af as af_, ld_diagonal, unnest(range({pops})) as p from ld_nodes) l left join (select * from study_stats where ns > 0) s on s.vid = lvid and s.study = p)"
_SUMMARY = f"""with {_NODES(4)}, b as (select p, ld_block, count(z) as have, count(*)-count(z) as lack, avg(n) as mean_n, median(a*a) as m, sum(a*a) as a2, sum(case when z is not null then sd*sd end) as tr from k group by all),
u as (select p, sum(have) as have, sum(lack) as lack, median(mean_n)*median(m)/{0.45493642311957283031}::double as lam, median(mean_n) as mn, sum(a2) as a2, sum(tr) as tr from b group by p)"""
_SIGMA = "greatest((lam-1)/(mn*72.6::double*(have/(have+lack))), 0)"
_PAIR = f"""with {_NODES(1)}, m as (select ld_block, avg(n) as bn from k where ld_node < 2 group by ld_block),
t as (select x.ld_block, x.ld_diagonal as da, y.ld_diagonal as db, w, x.a as aa_, y.a as ab, x.sd as sa, y.sd as sb, x.aa as ga, y.aa as gb, x.af_ as fa, y.af_ as fb, bn from k x join k y on x.ld_block = y.ld_block and x.ld_node = 0 and y.ld_node = 1 join (select * from ld_edges where i = 0) e on e.ld_block = x.ld_block join m on m.ld_block = x.ld_block),
v as (select *, case when aa_ is null then 0 when ab is null then (da-w*w/db)*aa_ else da*aa_+w*ab end as ya, case when ab is null then 0 when aa_ is null then (db-w*w/da)*ab else db*ab+w*aa_ end as yb, case when aa_ is null then 0 else {BETA_COV}::double*sa*sa end as va, case when ab is null then 0 else {BETA_COV}::double*sb*sb end as vb from t),
r as (select *, (va+da/bn)*(vb+db/bn)-(w/bn)*(w/bn) as det from v),
f as (select ld_block, 'P0' as pop, 0::bigint as ld_node, va*((vb+db/bn)*ya-(w/bn)*yb)/det*(case when ga = 1 then -1 else 1 end)/sqrt(2*fa*(1-fa)) as es from r where aa_ is not null
union all select ld_block, 'P0' as pop, 1::bigint as ld_node, vb*((va+da/bn)*yb-(w/bn)*ya)/det*(case when gb = 1 then -1 else 1 end)/sqrt(2*fb*(1-fb)) as es from r where ab is not null)"""


def _full_sql() -> str:
    """SQL of the whole model of two populations: a block's nodes are a chain, so elimination runs along it and back.

    First the missing nodes given the seen ones, then the system of effects with its two rows (p, q; q, r) for each node.
    """
    both = (0, 1)
    each = lambda text: ", ".join(text.replace("#", str(k)) for k in both)
    chain = "over (partition by ld_block order by k)"
    product = lambda v: f"d*{v}+w*coalesce(lead({v}) {chain}, 0)+u*coalesce(lag({v}) {chain}, 0)"
    known = each("coalesce(max(case when p = # then a end), 0) as a#, max((p = # and z is not null)::int) as s#, coalesce(max(case when p = # and z is not null then sd end), 0) as v#")
    back0, back1 = "(f.r*(f.g0-f.b0*x.x0)-f.q*(f.g1-f.b1*x.x1))/f.det", "(f.p*(f.g1-f.b1*x.x1)-f.q*(f.g0-f.b0*x.x0))/f.det"
    pivot = "t.p-e.b0*e.b0*e.r/e.det as p, t.q+e.b0*e.b1*e.q/e.det as q, t.r-e.b1*e.b1*e.p/e.det as r"
    sides = "t.y0-e.b0*(e.r*e.g0-e.q*e.g1)/e.det as g0, t.y1-e.b1*(e.p*e.g1-e.q*e.g0)/e.det as g1"
    return f"""with recursive {_NODES(2)},
m as (select ld_block, {each("coalesce(avg(case when p = # then n end), 1) as n#")} from k group by ld_block),
o as (select ld_block, ld_node as k, max(aa) as aa, max(af_) as af, max(ld_diagonal) as d, {known} from k group by all),
t as (select o.*, {each("m.n#")}, coalesce(e.w, 0) as w, coalesce(b.w, 0) as u from o join m on o.ld_block = m.ld_block
  left join ld_edges e on e.ld_block = o.ld_block and e.i = o.k left join ld_edges b on b.ld_block = o.ld_block and b.j = o.k),
c as (select *, {each(f"(1-s#)*({product('a#')}) as b#, w*(1-s#)*(1-coalesce(lead(s#) {chain}, 1)) as o#, case when s# = 1 then 1.0 else d end as m#")} from t),
f as (select ld_block, k, {each("m#::double as m#, b#::double as g#, o#::double as o#")} from c where k = 0
  union all select c.ld_block, c.k, {each("c.m#-f.o#*f.o#/f.m#, c.b#-f.o#/f.m#*f.g#, c.o#")} from c join f on c.ld_block = f.ld_block and c.k = f.k+1),
h as (select ld_block, k, {each("g#/m# as x#")} from f where k = 19
  union all select f.ld_block, f.k, {each("(f.g#-f.o#*h.x#)/f.m#")} from f join h on f.ld_block = h.ld_block and f.k = h.k-1),
l as (select t.*, {each("case when s# = 1 then a# else -x# end as e#")} from t join h on t.ld_block = h.ld_block and t.k = h.k),
y as (select *, {each(f"s#*({product('e#')}) as y#, w/n# as b#")}, {BETA_COV}*v0*v0+d/n0 as p, {BETA_COV * CROSS}*v0*v1 as q, {BETA_COV}*v1*v1+d/n1 as r from l),
e as (select ld_block, k, p::double as p, q::double as q, r::double as r, y0::double as g0, y1::double as g1, b0::double as b0, b1::double as b1, (p*r-q*q)::double as det from y where k = 0
  union all select ld_block, k, p, q, r, g0, g1, b0, b1, p*r-q*q from (select t.ld_block, t.k, {pivot}, {sides}, t.b0, t.b1 from y t join e on t.ld_block = e.ld_block and t.k = e.k+1)),
x as (select ld_block, k, (r*g0-q*g1)/det as x0, (p*g1-q*g0)/det as x1 from e where k = 19
  union all select f.ld_block, f.k, {back0}, {back1} from e f join x on f.ld_block = x.ld_block and f.k = x.k-1),
z as (select t.*, {BETA_COV}*v0*(v0*x0+{CROSS}*v1*x1) as z0, {BETA_COV}*v1*(v1*x1+{CROSS}*v0*x0) as z1 from t join x on t.ld_block = x.ld_block and t.k = x.k)
""" + " union all ".join(f"select ld_block, 'P{k}' as pop, k as ld_node, round((case when aa = 1 then -1 else 1 end)*z{k}/sqrt(2*af*(1-af)), 7) as es from z where s{k} = 1" for k in both)


ORACLES = {k: with_views(v) for k, v in {
    "ld_edges": "select ld_block, i, j, w from ld_edges where (ld_block, i) in (select (ld_block, ld_node) from ld_nodes) union all select ld_block, j as i, i as j, w from ld_edges where (ld_block, i) in (select (ld_block, ld_node) from ld_nodes)",
    "export_ldgm": "select ld_block, i, j, w from ld_edges union all select ld_block, ld_node as i, ld_node as j, ld_diagonal as w from ld_nodes",
    "ld_checked": "select vid, vid % 13 > 0 and not (vid % 11 = 0 and ld_node < 19) as good from ld_nodes",
    "ld_nodes": f"with {_NODES(2)} select ld_block, ld_node, string_agg('P'||p::varchar, ',' order by p) as pops from k where z is not null group by ld_block, ld_node",
    "ld_missing": f"{_SUMMARY} select 'P'||p::varchar as pop, have::bigint as non_missing, lack::bigint as missing, round(tr, 9) as trace_inf from u",
    "ld_block_median": f"with {_NODES(1)} select ld_block, round(median(a), 9) as median_a, round(median(a*a), 9) as median_a2, round(avg(n), 6) as mean_n from k where z is not null group by ld_block",
    "ld_alpha2": f"with {_NODES(4)} select 'P'||p::varchar as pop, round(max(a*a), 9) as max_alpha2, round(sum(a*a), 9) as sum_alpha2 from k where z is not null group by p",
    "ld_association": "with s as (select vid, es/se as z, ns as n from study_stats where study = 0 and vid % 3 > 0), t as (select ld_block, ld_node - ld_node % 2 as ld_node, l.vid, pos, case when n > 0 then z end as z, case when n > 0 and z is not null then n end as n from ld_nodes l join variants v on l.vid = v.vid left join s on s.vid = l.vid) select ld_block, ld_node, vid, round(z, 8) as z, n from (select *, row_number() over (partition by ld_block, ld_node order by z is null, pos) as k from t) where k = 1",
    "ld_table": """with t as (select ld_block as b, i, j, w from ld_edges where i % 5 > 0)
select l.ld_block, l.ld_node, chrom, pos, case when l.vid % 4 = 0 then alt else ref end as ref, case when l.vid % 4 = 0 then ref else alt end as alt, (l.vid % 4 = 0)::int as aa, round(case when l.vid % 4 = 0 then 1 - af else af end, 6) as af,
  case when l.vid % 7 > 0 then ld_diagonal end as ld_diagonal, coalesce(j::varchar, '') as ld_neighbors, round(w, 6) as weight
from ld_nodes l join variants v on l.vid = v.vid left join t on t.b = l.ld_block and t.i = l.ld_node where l.vid % 7 > 0 or j is not null""",
    "ld_lambda": f"{_SUMMARY} select 'P'||p::varchar as pop, round(lam, 9) as lambda_gc, round({_SIGMA}, 9) as sigmasq_inf, round({_SIGMA}/(tr/have), 9) as beta_cov from u",
    "ld_lambda_corrected": f"{_SUMMARY}, c as (select *, {_SIGMA}*least(pow((lam-1)/(a2/have*mn-1)/0.6::double, 2), 1) as sg from u) select 'P'||p::varchar as pop, round(lam, 9) as lambda_gc, round(sg, 9) as sigmasq_inf, round(sg/(tr/have), 9) as beta_cov from c",
    "ld_sigma": f"with {_NODES(2)} select x.ld_block, x.ld_node, 'P'||x.p::varchar as pop1, 'P'||y.p::varchar as pop2, round({BETA_COV}::double*x.sd*y.sd*(case when x.p = y.p then 1 else {CROSS}::double end), 10) as sigma from k x join k y on x.ld_block = y.ld_block and x.ld_node = y.ld_node and x.p <= y.p and x.z is not null and y.z is not null",
    "blup_diag": f"with {_NODES(1)}, m as (select ld_block, avg(n) as bn from k group by ld_block) select k.ld_block, 'P0' as pop, ld_node, round((case when aa = 1 then -1 else 1 end)*{BETA_COV}::double*sd*sd*ld_diagonal*a/({BETA_COV}::double*sd*sd+ld_diagonal/bn)/sqrt(2*af_*(1-af_)), 7) as es from k join m on k.ld_block = m.ld_block where z is not null",
    "ld_vectors": f"with {_NODES(2)} select ld_block, 'P'||p::varchar as pop, ld_node, z is not null as seen, round(a, 9) as alpha_hat, round(a/sqrt(2*af_*(1-af_)), 9) as effect, round(case when z is not null then sd else 0 end, 9) as sd from k",
    "ld_matrices": f"""with {_NODES(2)}, m as (select ld_block, p, coalesce(avg(n), 1) as mean_n from k group by all),
x as (select ld_block, p, ld_node as i, ld_node as j, ld_diagonal as w from k union all select ld_block, p, i, j, w from ld_edges, range(2) t(p) union all select ld_block, p, j as i, i as j, w from ld_edges, range(2) t(p)),
s as (select x.ld_block, x.p as p, y.p as q, x.ld_node as i, {BETA_COV}::double*x.sd*y.sd*(case when x.p = y.p then 1 else {CROSS}::double end) as v from k x join k y on x.ld_block = y.ld_block and x.ld_node = y.ld_node where x.z is not null and y.z is not null),
e as (select 'P' as matrix, ld_block, p, i, p as q, j, w as v from x union all select 'S' as matrix, ld_block, p, i, q, i as j, v from s
  union all select 'A' as matrix, ld_block, p, i, q, j, sum(v) as v from (select x.ld_block, x.p, i, x.p as q, j, w/mean_n as v from x join m on x.ld_block = m.ld_block and x.p = m.p union all select ld_block, p, i, q, i as j, v from s) group by all)
select matrix, ld_block, 'P'||p::varchar as pop1, i as node1, 'P'||q::varchar as pop2, j as node2, round(v, 9) as value from e""",
    "blup_full": _full_sql(),
    "blup_spread": _full_sql(),
    "pgs_burn_in": _full_sql(),
    "blup_pair": f"{_PAIR} select ld_block, pop, ld_node, round(es, 7) as es from f",
    "bayes_factor": f"with {_NODES(1)} select ld_block, ld_node, round(-0.5::double*(ln(1+n*sd*sd*0.05::double)-n*a*a*(n*sd*sd*0.05::double)/(1+n*sd*sd*0.05::double)), 8) as log_bf from k where z is not null",
}.items()}
