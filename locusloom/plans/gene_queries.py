"""Consequences of variants on transcripts derived from parts, over the sequence of repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.operators import consequence, manhattan
from locusloom.plans.text_queries import sequence
from locusloom.plans.views import view, with_views

#: Introns, the last exon, and what of the first and the last one isn't coding.
INTRON1, INTRON2, LAST, HEAD, TAIL = 30, 25, 60, 10, 12


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Three exons for each transcript; every eleventh transcript isn't coding."""
    rows = view(spark, d, "gene_models")
    s1, l1, l2 = F.col("s1"), F.col("l1"), F.col("l2")
    s2 = s1 + l1 + INTRON1
    s3 = s2 + l2 + INTRON2
    part = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"))
    exons = [part("exon", s1, s1 + l1 - 1), part("exon", s2, s2 + l2 - 1), part("exon", s3, s3 + LAST - 1)]
    coding = [part("CDS", s1 + HEAD, s1 + l1 - 1), part("CDS", s2, s2 + l2 - 1), part("CDS", s3, s3 + LAST - TAIL - 1)]
    name, gene = F.concat(F.lit("T"), F.col("vid").cast("string")), F.concat(F.lit("G"), F.col("vid").cast("string"))
    strand = F.when(F.col("minus") == 1, "-").otherwise("+")
    rows = rows.select(name.alias("transcript"), gene.alias("gene"), F.lit("made").alias("biotype"), "chrom", strand.alias("strand"), F.lit(0).alias("phase"), F.explode(F.when(F.col("vid") % 11 > 0, F.array(*exons, *coding)).otherwise(F.array(*exons))).alias("_p"))
    return rows.select("transcript", "gene", "biotype", "chrom", "strand", "phase", "_p.*")


def variants(spark: SparkSession, d: str) -> DataFrame:
    """Substitutions, deletions of one and three bases and insertions of a stop codon, that agree with the sequence."""
    at, kind = F.col("pos") + F.col("vid"), F.col("vid") % 5
    base = lambda k: F.substring(F.lit("ACGT"), ((at + k - 1) % 4 + 1).cast("int"), F.lit(1))
    ref = F.when(kind == 2, F.concat(base(0), base(1))).when(kind == 4, F.concat(*[base(k) for k in range(4)])).otherwise(base(0))
    alt = F.when(kind == 0, base(1)).when(kind == 1, base(2)).when(kind == 3, F.concat(base(0), F.lit("TGA"))).otherwise(base(0))
    return view(spark, d, "variants").select("vid", "chrom", at.alias("pos"), ref.alias("ref"), alt.alias("alt"))


def consequences(spark, d):
    out = consequence.consequences(variants(spark, d), segments(spark, d), sequence(spark, d))
    return out.select("chrom", "pos", "ref", "alt", "transcript", "gene", "strand", "consequence", "amino_acids")


def consequence_worst(spark, d):
    """All variants with their most severe consequence, and whether a plot marks it as coding."""
    rows = consequence.annotate(variants(spark, d), segments(spark, d), sequence(spark, d))
    return rows.select("vid", "consequence", "gene", "amino_acids", manhattan.is_coding(F.col("consequence")).alias("coding"))


QUERIES = {"consequences": consequences, "consequence_worst": consequence_worst}


def _sql() -> str:
    base = lambda k: f"substring('ACGT', cast((here+{k}-1)%4+1 as int), 1)"
    piece = lambda s, n: f"substring(repeat('ACGT', 60), cast(({s}-1)%4+1 as int), cast({n} as int))"
    meets = lambda a, b: f"(f <= {b} and l >= {a})"
    inside = lambda a, b: f"least(f, l) >= {a} and greatest(f, l) <= {b}"
    codes = lambda s: "16*(instr('TCAG', substring(#, 3*k+1, 1))-1)+4*(instr('TCAG', substring(#, 3*k+2, 1))-1)+instr('TCAG', substring(#, 3*k+3, 1))".replace("#", s)
    acids = lambda s: f"array_to_string([substring('{consequence.STANDARD}', {codes(s)}, 1) for k in range(0, (length({s})/3)::int)], '')"
    return f"""with g as (select m.*, pos+v.vid as here, v.vid%5 as kind from gene_models m join variants v on m.vid = v.vid),
h as (select *, {base(0)} as b0, {base(1)} as b1, s1+l1-1 as e1, s1+l1+{INTRON1} as s2, s1+l1+{INTRON1}+l2-1 as e2, s1+l1+{INTRON1}+l2+{INTRON2} as s3, s1+l1+{INTRON1}+l2+{INTRON2 + LAST - 1} as e3 from g),
i as (select *, case kind when 2 then b0||b1 when 4 then b0||b1||{base(2)}||{base(3)} else b0 end as ref, case kind when 0 then b1 when 1 then {base(2)} when 3 then b0||'TGA' else b0 end as alt,
  case when kind in (0, 1) or kind = 3 and b0 = 'A' then here else here+1 end as f, case kind when 3 then 0 when 4 then 3 else 1 end as r,
  case kind when 0 then b1 when 1 then {base(2)} when 3 then case when b0 = 'A' then 'ATG' else 'TGA' end else '' end as a from h),
j as (select *, f+r-1 as l, s1+{HEAD} as c1, e3-{TAIL} as c3, vid%11 > 0 as coding, {piece(f's1+{HEAD}', f'l1-{HEAD}')}||{piece('s2', 'l2')}||{piece('s3', LAST - TAIL)} as fwd from i),
k as (select *, case when minus = 1 then reverse(translate(fwd, 'ACGT', 'TGCA')) else fwd end as cds, case when minus = 1 then reverse(translate(a, 'ACGT', 'TGCA')) else a end as na,
  case when not coding then null when {inside('c1', 'e1')} then case when minus = 1 then {LAST - TAIL}+l2+e1-l else f-c1 end
    when {inside('s2', 'e2')} then case when minus = 1 then {LAST - TAIL}+e2-l else l1-{HEAD}+f-s2 end
    when {inside('s3', 'c3')} then case when minus = 1 then c3-l else l1-{HEAD}+l2+f-s3 end end as c,
  coding and ({meets('c1', 'e1')} or {meets('s2', 'e2')} or {meets('s3', 'c3')}) as in_cds, {meets('s1', 'e1')} or {meets('s2', 'e2')} or {meets('s3', 'e3')} as in_exon,
  {meets('e1+1', 'e1+2')} or {meets('e2+1', 'e2+2')} as after_exon, {meets('s2-2', 's2-1')} or {meets('s3-2', 's3-1')} as before_exon,
  {meets('e1-2', 'e1+8')} or {meets('s2-8', 's2+2')} or {meets('e2-2', 'e2+8')} or {meets('s3-8', 's3+2')} as near from j where {meets('s1', 'e3')}),
n as (select *, (c-c%3)::int as z, (c+greatest(r, 1)-1-(c+greatest(r, 1)-1)%3+3)::int as y from k),
o as (select *, case when y <= length(cds) then substring(cds, z+1, y-z) end as p from n),
q as (select *, substring(p, 1, (c-z)::int)||na||substring(p, (c-z+r+1)::int) as q from o),
s as (select *, {acids('p')} as pp, case when (length(a)-r)%3 = 0 then {acids('q')} end as qq, case when length(a) > r then 'inframe_insertion' when length(a) < r then 'inframe_deletion' end as by_size from q),
t as (select *, case when in_cds then case when c is null then 'coding_sequence' when (length(a)-r)%3 <> 0 then 'frameshift' when p is null then coalesce(by_size, 'coding_sequence')
    when instr(qq, '*') > 0 and instr(pp, '*') = 0 then 'stop_gained' when instr(pp, '*') > 0 and instr(qq, '*') = 0 then 'stop_lost' when z = 0 and pp like 'M%' and qq not like 'M%' then 'start_lost'
    when pp = qq then case when instr(pp, '*') > 0 then 'stop_retained' else 'synonymous' end else coalesce(by_size, 'missense') end
  when in_exon then case when not coding then 'non_coding' when case when minus = 1 then f > c3 else l < c1 end then '5_prime_utr' else '3_prime_utr' end else 'intron' end as place,
  case when minus = 1 then after_exon else before_exon end as acceptor, case when minus = 1 then before_exon else after_exon end as donor from s),
u as (select *, place in ('synonymous', 'stop_retained', '5_prime_utr', '3_prime_utr', 'non_coding', 'intron') as mild from t),
w as (select vid, chrom, here as pos, ref, alt, 'T'||vid as transcript, 'G'||vid as gene, case when minus = 1 then '-' else '+' end as strand,
  concat_ws('&', case when acceptor then 'splice_acceptor' end, case when donor then 'splice_donor' end, case when not mild then place end, case when near and not acceptor and not donor then 'splice_region' end, case when mild then place end) as consequence,
  case when qq is null or pp is null then null when pp = qq then (z/3+1)::int||pp else (z/3+1)::int||pp||'>'||(z/3+1)::int||qq end as amino_acids from u)"""


ORACLES = {
    "consequences": with_views(f"{_sql()} select chrom, pos, ref, alt, transcript, gene, strand, consequence, amino_acids from w"),
    "consequence_worst": with_views(f"{_sql()} select v.vid, consequence, gene, amino_acids, regexp_matches(consequence, '{'|'.join(manhattan.CODING)}') as coding from variants v left join w on v.vid = w.vid"),
}
