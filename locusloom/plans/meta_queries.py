"""Meta-analysis over four studies derived from line items."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.functions.stats import binomial_lp, truncated_correlation_series, with_abs_z
from locusloom.functions.tables import cut
from locusloom.operators import meta
from locusloom.plans import sqltext
from locusloom.plans.views import view, with_views

STUDIES, VID = 4, ["vid"]


def studies(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "study_stats")


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def meta_ivw(spark, d):
    return _rounded(meta.combine(studies(spark, d).select("vid", "study", "es", "se"), "ivw", key=VID), es=6, se=6, lp=5)


def meta_szw(spark, d):
    """ez counts before lp, whose quantile takes the sign of es; se isn't looked at."""
    rows = studies(spark, d).withColumn("_x", F.abs(F.col("es") / F.col("se"))).withColumn("lp", meta.two_sided_lp("_x"))
    rows = cut(rows.select("vid", "study", "es", "se", "lp", "ns"))  # stands for a table that has lp
    rows = rows.select("vid", "study", "es", (F.col("se") * 3).alias("se"), F.when(F.col("study") == 0, 2 * F.col("es") / F.col("se")).alias("ez"), "lp", "ns")
    return _rounded(meta.combine(rows, "szw", key=VID), ez=6, lp=5).select("vid", "ez", "lp")


def meta_het(spark, d):
    out = meta.combine(studies(spark, d).select("vid", "study", "es", "se"), "ivw", het=True, key=VID)
    return _rounded(out, es=6, se=6, lp=5, i2=4, cq=5)


def meta_sums(spark, d):
    rows = studies(spark, d).withColumn("nc", F.when(F.col("nc") > 0, F.col("nc")))
    return _rounded(meta.combine(rows, "ivw", key=VID), af=6).select("vid", "ns", "nc", "af")


def meta_logp(spark, d):
    rows = studies(spark, d).select("vid", "study", F.abs(F.col("es") / F.col("se")).alias("z"))
    return rows.select("vid", "study", F.round(meta.two_sided_lp("z"), 6).alias("lp"))


def meta_direction(spark, d):
    rows = studies(spark, d).withColumn("study", F.col("study").cast("int"))
    return meta.combine(rows.select("vid", "study", "es", "se"), "ivw", n_studies=STUDIES, key=VID).select("vid", "ed")


def meta_filters_union(spark, d):
    tag = F.when(F.col("es") > 0.01, F.array(F.lit("HIGH"))).when(F.col("es") < -0.01, F.array(F.lit("LOW"), F.concat(F.lit("S"), F.col("study").cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = studies(spark, d).withColumn("filters", tag).withColumn("id", F.concat(F.lit("rs"), (F.col("vid") % 7).cast("string")))
    return meta.combine(rows.select("vid", "study", "es", "se", "filters", "id"), "ivw", key=VID).select("vid", "id", F.array_join("filters", ";").alias("filters"))


def meta_eff_n(spark, d):
    return meta.with_effective_n(studies(spark, d)).select("vid", "study", F.round("ne", 6).alias("ne"))


def meta_z_from_lp(spark, d):
    rows = studies(spark, d).withColumn("lp", F.col("ns") / 10.0)
    return with_abs_z(rows, "lp", "z").select("vid", "study", F.round(meta.two_sided_lp("z"), 6).alias("lp_again"), (F.col("z") > 0).alias("positive"))


def meta_overlap_corr(spark, d):
    rows = studies(spark, d).withColumn("ez", F.col("es") / F.col("se") / 4).select("vid", "study", "ez")
    return meta.truncated_products(rows, VID).select(F.col("a").alias("study_a"), F.col("b").alias("study_b"), F.round("mean", 6).alias("mean_product"), F.col("n").alias("n_shared"))


RHO = 0.2


def meta_overlap_fixed_rho(spark, d):
    rows = studies(spark, d).where("study < 2").withColumn("ez", F.col("es") / F.col("se"))
    rho = np.array([[1, RHO], [RHO, 1]])
    return _rounded(meta.combine_overlapping(rows.select("vid", "study", "ez", "ns"), rho, "szw", key=VID), ez=6, ne=6).select("vid", "ez", "ne")


def meta_overlap_full(spark, d):
    """Correlations from the data, then all patterns of four studies."""
    rows = studies(spark, d).select("vid", "study", "es", "se", "ns", "af")
    small = rows.withColumn("ez", F.col("es") / F.col("se") / 4).select("vid", "study", "ez")
    out = meta.combine_overlapping(rows, meta.overlap_correlations(small, STUDIES, VID), "ivw", het=True, key=VID)
    return _rounded(out, es=6, se=6, lp=5, ne=4, af=6, i2=4, cq=5)


def meta_patterns(spark, d):
    return meta.presence_patterns(studies(spark, d), STUDIES, VID)


def meta_union(spark, d):
    from locusloom.operators.tables import stack

    rows = studies(spark, d)
    return stack(*[rows.where(F.col("study") == k).select("vid", F.lit(f"study{k}").alias("study")) for k in range(STUDIES)]).groupBy("study").agg(F.count("*").alias("n_rows"), F.countDistinct("vid").alias("n_variants"))


def plot_binom(spark, d):
    rows = studies(spark, d).select("vid", "study", (F.col("ns") % 97).cast("int").alias("a"), (F.col("nc") % 89).cast("int").alias("b")).where("a + b > 0")
    return rows.select("vid", "study", F.round(binomial_lp(F.col("a"), F.col("b")), 6).alias("lp"))


_W = "sum(1/(se*se)) as w, sum(es/(se*se)) as wx, sum(es*es/(se*se)) as spread, count(*)-1 as df"
_IVW = f"with m as (select vid, {_W} from study_stats group by vid), z as (select *, abs(wx/sqrt(w)) as z from m)"



def _overlap_sql() -> str:
    """SQL of ``meta_overlap_full``.

    A correlation is the largest sum of halvings whose truncated correlation stays below the mean product. Studies that a variant lacks are
    rows of the unit matrix, so that one elimination serves all patterns; with pivots d and the eliminated sides u and v the form u'Rv is
    the sum of u v / d.
    """
    n, sides = range(STUDIES), ("w", "z", "root", "fw")
    pairs = [(i, j) for i in n for j in n if i < j]
    value = "0.0::double"
    for c in truncated_correlation_series()[::-1]:
        value = f"({value}*(a+h)*(a+h)+{float(c)!r}::double)"
    halvings = "list_transform(range(0, 50), lambda k: case when k = 0 then 0 else pow(0.5::double, k) end)"
    found = f"case when t > 0 then list_reduce({halvings}, lambda a, h: case when (a+h)*{value} < t then a+h else a end) else 0 end"
    given = lambda c, k: f"coalesce(max(case when study = {k} then {c} end), 0)"
    values = {"w": "1/se", "z": "es/se", "root": "sqrt(ns)", "fw": "af/se"}
    start = ", ".join([f"{given(values[c], k)} as {c}{k}" for c in sides for k in n] + [f"max((study = {k})::int) as h{k}" for k in n])
    cells = ", ".join([f"1.0::double as m{k}{k}" for k in n] + [f"h{i}*h{j}*coalesce(r{i}{j}, 0) as m{i}{j}" for i, j in pairs])
    steps = [f"e0 as (select vid, df, {', '.join(f'{c}{k}' for c in sides for k in n)}, {cells} from v, rho)"]
    for k in n[:-1]:
        below = [i for i in n if i > k]
        new = [f"{c}{i} - m{k}{i}/m{k}{k}*{c}{k} as {c}{i}" for c in sides for i in below]
        new += [f"m{i}{j} - m{k}{i}/m{k}{k}*m{k}{j} as m{i}{j}" for i in below for j in below if i <= j]
        steps.append(f"e{k + 1} as (select * replace ({', '.join(new)}) from e{k})")
    form = lambda u, v: "+".join(f"{u}{k}*{v}{k}/m{k}{k}" for k in n)
    forms = f"{form('w', 'w')} as n, {form('w', 'z')} as x, {form('z', 'z')} as q0, {form('root', 'root')} as ne, {form('fw', 'w')} as f"
    return f"""with y as (select vid, study, es/se/4 as z from study_stats where es/se/4 between -1 and 1),
p as (select a.study as i, b.study as j, avg(a.z*b.z) as t from y a join y b on a.vid = b.vid and a.study < b.study group by all),
c as (select i, j, {found} as r from p),
rho as (select {', '.join(f'max(case when i = {i} and j = {j} then r end) as r{i}{j}' for i, j in pairs)} from c),
v as (select vid, count(*) - 1 as df, {start} from study_stats group by vid),
{', '.join(steps)},
g as (select vid, df, {forms} from e{STUDIES - 1}),
q as (select *, greatest(q0-x*x/n, 0) as q, sqrt(greatest(q0-x*x/n, 0)) as root, abs(x)/sqrt(n) as z from g)
select vid, round(x/n, 6) as es, round(1/sqrt(n), 6) as se, round({sqltext.two_sided_lp('z')}, 5) as lp, round(ne, 4) as ne, round(f/n, 6) as af,
  case when df > 0 then round(case when q > 0 then greatest((q-df)/q, 0)*100 else 0 end, 4) end as i2,
  case when df > 0 then round({sqltext.chi2_lp('q', 'df', 'root')}, 5) end as cq from q"""


QUERIES = {
    "meta_ivw": meta_ivw, "meta_szw": meta_szw, "meta_het": meta_het, "meta_sums": meta_sums, "meta_logp": meta_logp, "meta_direction": meta_direction, "meta_filters_union": meta_filters_union,
    "meta_eff_n": meta_eff_n, "meta_z_from_lp": meta_z_from_lp, "meta_overlap_corr": meta_overlap_corr, "meta_overlap_fixed_rho": meta_overlap_fixed_rho, "meta_overlap_full": meta_overlap_full,
    "meta_patterns": meta_patterns, "meta_union": meta_union, "plot_binom": plot_binom,
}

ORACLES = {k: with_views(v) for k, v in {
    "meta_ivw": f"{_IVW} select vid, round(wx/w, 6) as es, round(1/sqrt(w), 6) as se, round({sqltext.two_sided_lp('z')}, 5) as lp from z",
    "meta_szw": f"with m as (select vid, sum(ns) as w, sum(es/se*case when study = 0 then 2 else 1 end*sqrt(ns)) as wx from study_stats where ns > 0 group by vid), z as (select *, abs(wx/sqrt(w)) as z from m) select vid, round(wx/sqrt(w), 6) as ez, round({sqltext.two_sided_lp('z')}, 5) as lp from z",
    "meta_het": f"""{_IVW}, q as (select *, greatest(spread-wx*wx/w, 0) as q, sqrt(greatest(spread-wx*wx/w, 0)) as root from z)
select vid, round(wx/w, 6) as es, round(1/sqrt(w), 6) as se, round({sqltext.two_sided_lp('z')}, 5) as lp,
  case when df > 0 then round(case when q > 0 then greatest((q-df)/q, 0)*100 else 0 end, 4) end as i2, case when df > 0 then round({sqltext.chi2_lp('q', 'df', 'root')}, 5) end as cq from q""",
    "meta_sums": "select vid, sum(ns) as ns, case when count(nullif(nc, 0)) = count(*) then sum(nc) end as nc, round(sum(af/(se*se))/sum(1/(se*se)), 6) as af from study_stats group by vid",
    "meta_logp": f"with t as (select vid, study, abs(es/se) as z from study_stats) select vid, study, round({sqltext.two_sided_lp('z')}, 6) as lp from t",
    "meta_direction": "with p as (select vid, max(case when study=0 then case when es>0 then '+' when es<0 then '-' else '0' end end) as a, max(case when study=1 then case when es>0 then '+' when es<0 then '-' else '0' end end) as b, max(case when study=2 then case when es>0 then '+' when es<0 then '-' else '0' end end) as c, max(case when study=3 then case when es>0 then '+' when es<0 then '-' else '0' end end) as e from study_stats group by vid) select vid, coalesce(a,'?')||coalesce(b,'?')||coalesce(c,'?')||coalesce(e,'?') as ed from p",
    "meta_filters_union": "with f as (select vid, unnest(case when es > 0.01 then ['HIGH'] when es < -0.01 then ['LOW', 'S'||study::varchar] else ['~'] end) as t from study_stats) select vid, 'rs'||(vid%7)::varchar as id, coalesce(array_to_string(list_sort(list(distinct t) filter (where t <> '~')), ';'), '') as filters from f group by vid",
    "meta_eff_n": "select vid, study, round(coalesce(case when ns <> 0 then 4*(ns-nc)*nc/ns end, ns), 6) as ne from study_stats",
    "meta_z_from_lp": "select vid, study, round(ns/10.0, 6) as lp_again, ns > 0 as positive from study_stats",
    "meta_overlap_corr": "with z as (select vid, study, es/se/4 as z from study_stats), k as (select * from z where z between -1 and 1) select a.study as study_a, b.study as study_b, round(avg(a.z*b.z), 6) as mean_product, count(*) as n_shared from k a join k b on a.vid = b.vid and a.study < b.study group by 1, 2",
    "meta_overlap_fixed_rho": f"""with t as (select vid, max(case when study=0 then es/se end) as z1, max(case when study=1 then es/se end) as z2, max(case when study=0 then ns end) as n1, max(case when study=1 then ns end) as n2 from study_stats where study < 2 group by vid)
select vid, round(case when n1 is null then z2 when n2 is null then z1 else ((z1*sqrt(n1)+z2*sqrt(n2)-{RHO}*(z1*sqrt(n2)+z2*sqrt(n1)))/(1-{RHO}*{RHO}))/sqrt((n1+n2-2*sqrt(n1*n2)*{RHO})/(1-{RHO}*{RHO})) end, 6) as ez,
  round(case when n1 is null then n2 when n2 is null then n1 else (n1+n2-2*sqrt(n1*n2)*{RHO})/(1-{RHO}*{RHO}) end, 6) as ne from t""",
    "meta_overlap_full": _overlap_sql(),
    "meta_patterns": "with p as (select vid, max((study=0)::int)::varchar||max((study=1)::int)::varchar||max((study=2)::int)::varchar||max((study=3)::int)::varchar as pattern from study_stats group by vid) select pattern, count(*) as n from p group by pattern",
    "meta_union": "select 'study'||study::varchar as study, count(*) as n_rows, count(distinct vid) as n_variants from study_stats group by study",
    "plot_binom": "with t as (select vid, study, (ns % 97)::int as a, (nc % 89)::int as b from study_stats), u as (select * from t where a+b > 0), s as (select vid, study, a, b, sum(exp(lgamma(a+b+1)-lgamma(k+1)-lgamma(a+b-k+1)-(a+b)*ln(2::double))) as c from (select vid, study, a, b, unnest(range(0, least(a,b)+1)) as k from u) group by all) select vid, study, round(greatest(-(ln(2::double)+ln(c))/ln(10::double), 0), 6) as lp from s",
}.items()}
