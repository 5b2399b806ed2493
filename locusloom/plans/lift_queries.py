"""Liftover of variants derived from parts over chain blocks derived from parts, and the allele-swap rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusloom.functions import alleles, swap
from locusloom.functions.tables import shared_folder
from locusloom.operators import liftover, records, tables
from locusloom.plans.text_queries import sequence
from locusloom.plans.views import view, with_views
from locusloom.sources import chain


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Data lines of chains; every fifth gap is one base on both sides, so that its blocks are one."""
    return view(spark, d, "chain_lines")


def placed(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "chain_blocks")
    gaps = chain.with_gaps(rows.select("chain_ind", "block_ind", "t_start", "q_start", "size"))
    return rows.drop("t_start", "q_start", "size").join(gaps, ["chain_ind", "block_ind"]).select(
        "chain_ind", "block_ind", F.col("t_chrom").alias("b_chrom"), F.col("t_start").alias("b_start"), (F.col("t_start") + F.col("size") - 1).alias("b_end"), F.col("q_start").alias("b_q"),
        F.concat(F.lit("q"), "t_chrom").alias("q_chrom"), "q_size", F.col("q_strand").cast("int").alias("q_strand"), "t_start_gap", "t_end_gap", "q_start_gap", "q_end_gap",
    )


def chain_blocks(spark, d):
    """Starts are running sums of sizes and gaps."""
    out = chain.merge_blocks(lines(spark, d), max_gap=-1)
    return out.select("chain_ind", F.col("block_ind").alias("line"), "t_start", "q_start", "size")


def chain_merge(spark, d):
    out = chain.merge_blocks(lines(spark, d), max_gap=1)
    return out.select("chain_ind", F.col("block_ind").alias("line"), "t_start", "q_start", "size")


def chain_file(spark, d):
    """The same from a chain file, which is read in splits and checked."""
    path = shared_folder(spark, "chains")
    rows = lines(spark, d)
    last = Window.partitionBy("chain_ind").orderBy(F.col("line").desc())
    rows = rows.withColumn("_end", F.row_number().over(last) == 1)
    zero = F.when(F.col("_end"), 0)
    sums = rows.groupBy("chain_ind").agg(F.sum(F.col("size") + F.coalesce(zero, "dt")).alias("t"), F.sum(F.col("size") + F.coalesce(zero, "dq")).alias("q"))
    chrom = (F.col("chain_ind") + 1).cast("string")
    head = F.format_string("chain 1 chr%s %d + 0 %d q%s %d - 0 %d %d", chrom, F.col("t"), F.col("t"), chrom, F.col("q"), F.col("q"), F.col("chain_ind") + 1)
    text = sums.select("chain_ind", F.lit(-1).cast("long").alias("line"), head.alias("value"))
    body = F.when(F.col("_end"), F.col("size").cast("string")).otherwise(F.concat_ws("\t", "size", "dt", "dq"))
    text.unionByName(rows.select("chain_ind", "line", body.alias("value"))).orderBy("chain_ind", "line").select("value").write.text(path)
    heads, blocks = chain.read_chains(spark, path, max_gap=1, strict=True)
    first = F.min("block_ind").over(Window.partitionBy("chain_ind"))
    blocks = blocks.withColumn("line", F.col("block_ind") - first).join(heads.select("chain_ind", (F.col("id") - 1).alias("name")), "chain_ind")
    return blocks.select(F.col("name").alias("chain_ind"), "line", "t_start", "q_start", "size")


def chain_neighbours(spark, d):
    return placed(spark, d).select("chain_ind", "block_ind", "t_start_gap", "t_end_gap", "q_start_gap", "q_end_gap")


def chain_dedup(spark, d):
    rows = view(spark, d, "chain_blocks").select(F.col("block_ind").alias("chain_ind"), (F.col("block_ind") % 50).alias("id"))
    return chain.first_chains(rows)


def lift_point(spark, d):
    return liftover.lift_points(view(spark, d, "variants"), placed(spark, d)).select("vid", "q_chrom", "q_pos", "q_strand", F.col("q_chain").alias("chain"), F.col("q_block").alias("block"))


def lift_flip(spark, d):
    out = liftover.lift_single(view(spark, d, "variants"), placed(spark, d))
    return out.select("vid", "q_pos", "q_ref", "q_alt", "flip")


def _lifted(spark, d) -> DataFrame:
    return liftover.lift_single(view(spark, d, "variants"), placed(spark, d), sequence(spark, d, "q"), write_src=True)


def lift_ref_snp(spark, d):
    return _lifted(spark, d).select("vid", "q_pos", "q_ref", "q_alt", "swap", "src_chrom", "src_pos", "src_ref_alt")


def lift_reject(spark, d):
    rows = view(spark, d, "variants").withColumn("chrom", F.when(F.col("vid") % 9 > 0, F.col("chrom")))
    return liftover.lift_single(rows, placed(spark, d)).where(F.col("reject_reason").isNotNull()).select("vid", "reject_reason")


def lift_counts(spark, d):
    return liftover.counts(_lifted(spark, d))


def lift_end(spark, d):
    """Ends are lifted too, and go where contig or strand don't agree or the order turns."""
    rows = view(spark, d, "variants").withColumn("end", F.col("pos") + F.col("vid") % 3000)
    return liftover.lift_ends(rows, placed(spark, d)).select("vid", "q_pos", "q_end")


def lift_anchors(spark, d):
    rows = view(spark, d, "variants").withColumn("end", F.col("pos") + F.col("vid") % 700)
    return liftover.lift_spans(rows, placed(spark, d)).select("vid", "q_pos", "q_end", "n_pad5", "n_pad3", "reject_reason")


def _longer(spark, d) -> DataFrame:
    """Deletions and insertions in the sequence of repeats."""
    at = F.col("pos") + F.col("vid")
    base = lambda k: F.substring(F.lit("ACGT"), ((at + k - 1) % 4 + 1).cast("int"), F.lit(1))
    v = view(spark, d, "variants")
    two = F.concat(base(0), base(1))
    return v.select("vid", "chrom", at.alias("pos"), F.when(F.col("vid") % 2 == 0, two).otherwise(base(0)).alias("ref"), F.when(F.col("vid") % 2 == 0, base(0)).otherwise(two).alias("alt"))


def _extra(spark, d) -> DataFrame:
    """A substitution with bases around it, one base twice, two bases twice."""
    at = F.col("pos") + F.col("vid")
    base = lambda k: F.substring(F.lit("ACGT"), ((at + k - 1) % 4 + 1).cast("int"), F.lit(1))
    kind = F.col("vid") % 3
    ref = F.when(kind == 0, F.concat(*[base(k) for k in range(4)])).otherwise(base(0))
    alt = F.when(kind == 0, F.concat(base(0), base(1), base(3), base(3))).when(kind == 1, F.concat(base(0), base(0))).otherwise(F.concat(base(0), base(-1), base(0)))
    return view(spark, d, "variants").select("vid", "chrom", at.alias("pos"), ref.alias("ref"), alt.alias("alt"))


def lift_longer(spark, d):
    out = liftover.lift_longer(_longer(spark, d), placed(spark, d), sequence(spark, d), sequence(spark, d, "q"))
    return out.select("vid", "q_chrom", "q_pos", F.array_join("q_alleles", ",").alias("q_alleles"), "flip", "swap", "reject_reason")


def lift_nw(spark, d):
    score = liftover.alignment_score(F.concat("ref", F.lit("AC"), "alt"), F.concat("ref", "alt"))
    return view(spark, d, "variants").select("vid", score.alias("score"))


def _records(spark, d) -> DataFrame:
    """Records of three alleles, joined from rows of one alternative each, with INFO and two samples; all lie in blocks."""
    at = F.floor(F.col("pos") / 10000) * 10000 + 1 + F.col("pos") % 7999
    v, third = F.col("vid"), F.expr("case when ref <> 'A' and alt <> 'A' then 'A' when ref <> 'C' and alt <> 'C' then 'C' else 'G' end")
    rows = view(spark, d, "variants").select("vid", "chrom", at.alias("pos"), "ref", F.explode(F.array("alt", third)).alias("alt"))
    joined = tables.join_alleles(rows, (), ("vid", "chrom", "pos", "ref"))
    text = lambda *x: F.concat_ws(",", *[y.cast("string") for y in x])
    info = {
        "AC": text(v % 11, v % 7), "AN": F.lit("100"), "AF": F.lit("0.25,0.5"), "RD": text(v, v + 1, v + 2), "GL": text(*[v * 10 + i for i in range(6)]), "ALLELE_A": (v % 3).cast("string"),
        "XX": F.lit("x"), "END": F.col("pos").cast("string"),
    }
    entries = F.map_from_arrays(F.array(*[F.lit(k) for k in info]), F.array(*info.values()))
    number = lambda x: x.cast("double")
    one = lambda name, k: F.struct(
        F.lit(name).alias("sample"), F.array(((v + k) % 3).cast("int"), F.lit(None).cast("int") if k else (v % 2).cast("int")).alias("gt"), F.array(number(v % 3) / 4, number(v % 2) / 2).alias("ds"),
        F.array(*[number(v * 10 + i + k) for i in range(6)]).alias("gp"), F.array(number(v % 5 + k), number(v % 6)).alias("es"),
    )
    return joined.select("vid", "chrom", "pos", F.array_prepend("alt", F.col("ref")).alias("alleles"), entries.alias("info"), F.array(one("s0", 0), one("s1", 1)).alias("samples"))


#: Tags of the records by what they have values for.
INFO_NUMBERS = {"AC": "A", "AN": "1", "AF": "A", "RD": "R", "GL": "G", "ALLELE_A": "1", "XX": "1", "END": "1"}
FORMAT_NUMBERS = {"GT": "1", "DS": "A", "GP": "G", "ES": "A"}


def lift_records(spark, d):
    """Whole records: places, alleles, all INFO values and samples, a row for each sample."""
    out = records.lift_records(_records(spark, d), placed(spark, d), None, sequence(spark, d, "q"), INFO_NUMBERS, FORMAT_NUMBERS, write_src=True)
    rows = out.select("vid", "chrom", "pos", F.array_join("alleles", ",").alias("alleles"), "swap", "flip", "info", F.explode("samples").alias("x"))
    texts = [F.try_element_at("info", F.lit(k)).alias(k.lower()) for k in ("AC", "AF", "RD", "GL", "ALLELE_A", "XX", "END", "FLIP", "SRC_POS", "SRC_REF_ALT")]
    texts.append(F.try_element_at("info", F.lit("SWAP")).alias("swap_1"))
    joined = lambda f: F.array_join(F.transform(F.col(f"x.{f}"), lambda y: y.cast("int").cast("string")), ",", ".").alias(f)
    return rows.select("vid", "chrom", "pos", "alleles", "swap", *texts, "x.sample", joined("gt"), *[F.get("x.ds", F.lit(i)).alias(f"ds{i}") for i in range(3)], joined("gp"), joined("es"))


def lift_extend(spark, d):
    """Each pair is extended over the whole sequence around it, as far as that repeats."""
    out = liftover.extend_rows(_longer(spark, d), sequence(spark, d))
    return out.select("vid", "x_pos", F.array_join("x_alleles", ",").alias("alleles"))


def lift_left_align(spark, d):
    rows = _extra(spark, d)
    return liftover.align_rows(rows, sequence(spark, d)).select("vid", "y_pos", F.array_join("y_alleles", ",").alias("alleles"))


def _arrays(spark, d) -> DataFrame:
    """Three alleles; s is -1, 0, 1 or 2."""
    v = F.col("vid")
    return view(spark, d, "variants").select(
        "vid", (v % 4 - 1).cast("int").alias("s"), F.array(v % 11, v % 7).alias("AC"), F.lit(100).cast("long").alias("AN"), F.array(v % 5, v % 6).cast("array<double>").alias("ES"), F.array(v % 3 / 4.0, v % 2 / 8.0).alias("AF"),
        F.array(v % 3 / 4.0, v % 2 / 2.0).alias("DS"), F.array(v % 2, v % 3).cast("array<int>").alias("GT"), F.array(v, v + 1, v + 2).alias("R"), F.array(*[v * 10 + i for i in range(6)]).alias("G"), F.array(v, v + 1).alias("A"),
    )


def _values(c, n: int):
    """The elements as columns, so that nothing hangs on how numbers are printed."""
    return [F.get(c, F.lit(i)).cast("double").alias(f"x{i}") for i in range(n)] + [F.size(c).alias("n")]


def _swapped(rule, n: int):
    def run(spark, d):
        return _arrays(spark, d).withColumn("_y", rule()).select("vid", *_values(F.col("_y"), n))

    return run


def swap_tags(spark, d):
    """All rules by tag."""
    rows = _arrays(spark, d)
    out = swap.with_swapped(rows, {"AC": "A", "AF": "A", "DS": "A", "ES": "A", "R": "R", "G": "G", "A": "A"}, F.col("s"), F.lit(3))
    return out.select("vid", *[F.get(c, F.lit(0)).cast("double").alias(c.lower()) for c in ("AC", "AF", "DS", "ES", "R", "G", "A")])


QUERIES = {
    "chain_blocks": chain_blocks, "chain_merge": chain_merge, "chain_file": chain_file, "chain_neighbours": chain_neighbours, "chain_dedup": chain_dedup, "lift_point": lift_point, "lift_flip": lift_flip, "lift_ref_snp": lift_ref_snp,
    "lift_reject": lift_reject, "lift_counts": lift_counts, "lift_end": lift_end, "lift_anchors": lift_anchors, "lift_longer": lift_longer, "lift_extend": lift_extend, "lift_left_align": lift_left_align, "lift_nw": lift_nw, "lift_records": lift_records,
    "swap_ac": _swapped(lambda: swap.complement(F.col("AC"), F.col("s"), F.col("AN")), 3), "swap_af": _swapped(lambda: swap.complement(F.col("AF"), F.col("s"), F.lit(1.0)), 3),
    "swap_ds": _swapped(lambda: swap.complement(F.col("DS"), F.col("s"), F.lit(2.0)), 3), "swap_es": _swapped(lambda: swap.effect(F.col("ES"), F.col("s")), 3),
    "swap_r": _swapped(lambda: swap.per_allele(F.col("R"), F.col("s")), 4), "swap_g": _swapped(lambda: swap.per_genotype(F.col("G"), F.lit(3), F.col("s")), 10),
    "swap_a": _swapped(lambda: swap.per_alt(F.col("A"), F.col("s")), 3), "swap_gt": _swapped(lambda: swap.allele_codes(F.col("GT"), F.col("s")), 2), "swap_tags": swap_tags,
}


def _list_sql(exchanged: str, prepended: str, same: str, n: int) -> str:
    """Lists by s, as columns."""
    cells = ", ".join(f"y[{i + 1}]::double as x{i}" for i in range(n))
    return f"with t as (select vid, (vid % 4 - 1)::int as s, vid as v from variants), u as (select vid, case when s > 0 then {exchanged} when s = -1 then {prepended} else {same} end as y from t) select vid, {cells}, len(y) as n from u"


def _complement_sql(a: str, b: str, total: str) -> str:
    rest = f"({total}-{a}-{b})"
    return _list_sql(f"[case when s = 1 then {rest} else {a} end, case when s = 2 then {rest} else {b} end]", f"[{rest}, {a}, {b}]", f"[{a}, {b}]", 3)


_G = "[v*10, v*10+1, v*10+2, v*10+3, v*10+4, v*10+5]"
_BLOCK = "select vid, 'q'||t_chrom as q_chrom, case when q_strand = 0 then q_start+pos-1-t_start+1 else q_size-q_start-(pos-1-t_start) end as q_pos, q_strand, chain_ind, block_ind from variants v join chain_blocks b on v.chrom = b.t_chrom and pos-1 between t_start and t_start+size-1"
#: The base k places behind a variant in the sequence of repeats.
_BASE = lambda k: f"substring('ACGT', ((pos+vid+{k}-1) % 4 + 1)::int, 1)"
_FLIP = "translate({0}, 'ACGT', 'TGCA')"
_SINGLE = f"with l as ({_BLOCK}), t as (select v.*, q_pos, q_strand, case when q_strand = 1 then {_FLIP.format('ref')} else ref end as a, case when q_strand = 1 then {_FLIP.format('alt')} else alt end as b from variants v left join l on v.vid = l.vid)"
_LONGEST = "n as (select chrom, (max(pos+vid)/4.0+100)::int*4 as len from variants group by chrom)"
_REF = f"""{_SINGLE}, {_LONGEST}, r as (select t.*, case when q_pos <= len then substring('ACGT', ((q_pos-1) % 4 + 1)::int, 1) end as base from t join n on t.chrom = n.chrom),
w as (select *, case when q_pos is not null then case when base = a then 0 when base = b then 1 else -1 end end as swap from r)"""
_AT = lambda p, tag: f"{tag} as (select s.vid, chain_ind as {tag}_c, t_chrom as {tag}_chrom, q_strand as {tag}_s, q_size as {tag}_size, t_start as {tag}_t, case when q_strand = 0 then q_start+{p}-1-t_start+1 else q_size-q_start-({p}-1-t_start) end as {tag}_q from sp s join chain_blocks b on s.chrom = b.t_chrom and {p}-1 between t_start and t_start+size-1)"
# Blocks of a chain have the same strand and lie more than 250 bases apart in the destination, so the other anchor is always found by arithmetic.
_ANCHORS = f"""with sp as (select vid, chrom, pos, pos+vid % 700 as e from variants), {_AT("pos", "a5")}, {_AT("e", "a3")},
nb as (select chain_ind, t_start, lag(t_start+size) over (partition by chain_ind order by t_start) as pe, lead(t_start+1) over (partition by chain_ind order by t_start) as ns from chain_blocks),
j as (select sp.*, a5_c, a5_q, a5_s, a5_size, a3_c, a3_q, a3_s, a3_size, p.pe, n.ns, e-pos as span from sp left join a5 on a5.vid = sp.vid left join a3 on a3.vid = sp.vid left join nb p on p.chain_ind = a3_c and p.t_start = a3_t left join nb n on n.chain_ind = a5_c and n.t_start = a5_t),
k as (select *, case when a5_q is null and a3_q is not null then case when pos-pe between 1 and 250 then pos-pe when span <= 250 then least(250, pos-1) end end as p5, case when a3_q is null and a5_q is not null then case when ns-e between 1 and 250 then ns-e when span <= 250 then 250 end end as p3 from j),
f as (select *, case when coalesce(a5_s, a3_s) = 1 then -1 else 1 end as sg, coalesce(a5_size, a3_size) as sz from k),
g as (select *, case when a5_q is not null then a5_q when a3_q is not null then greatest(least(a3_q-sg*(case when sg = 1 then span else 0 end+coalesce(p5, 0)), sz), 1) end as q1, case when a3_q is not null then a3_q when a5_q is not null then greatest(least(a5_q+sg*(case when sg = 1 then span else 0 end+coalesce(p3, 0)), sz), 1) end as q2 from f),
h as (select *, case when a5_q is null and a3_q is null then 'UnmappedAnchors' when a5_q is not null and a3_q is not null and abs(q2-q1) > span+250 then 'ApartAnchors' when a5_q is null and p5 is null then 'UnmappedAnchor5' when a3_q is null and p3 is null then 'UnmappedAnchor3' end as reason from g)
select vid, case when reason is null then least(q1, q2) end as q_pos, case when reason is null then greatest(q1, q2) end as q_end, coalesce(p5, 0) as n_pad5, coalesce(p3, 0) as n_pad3, reason as reject_reason from h"""

_JOINED = lambda x: f"array_to_string([coalesce(y::varchar, '.') for y in {x}], ',')"
_GENOTYPES = lambda x: f"(case s when 0 then {x} when 1 then [{x}[i] for i in [3, 2, 1, 5, 4, 6]] when 2 then [{x}[i] for i in [6, 5, 3, 4, 2, 1]] else [null, null, {x}[1], null, {x}[2], {x}[3], null, {x}[4], {x}[5], {x}[6]] end)"
_RENUMBERED = lambda x: f"[case when s = -1 then g+1 when g = 0 then s when g = s then 0 else g end for g in {x}]"
_RESTS = lambda a, b, total: f"(case s when 0 then [{a}, {b}] when 1 then [{total}-{a}-{b}, {b}] when 2 then [{a}, {total}-{a}-{b}] else [{total}-{a}-{b}, {a}, {b}] end)"
_RECORDS = f"""with r as (select vid, chrom, (pos//10000)*10000+1+pos%7999 as pos, ref, alt, case when ref <> 'A' and alt <> 'A' then 'A' when ref <> 'C' and alt <> 'C' then 'C' else 'G' end as third from variants),
m as (select r.*, [ref, least(alt, third), greatest(alt, third)] as al, 'q'||t_chrom as q_chrom, case when q_strand = 0 then q_start+pos-1-t_start+1 else q_size-q_start-(pos-1-t_start) end as q_pos, q_strand from r join chain_blocks b on r.chrom = b.t_chrom and pos-1 between t_start and t_start+size-1),
{_LONGEST},
f as (select m.*, case when q_strand = 1 then [translate(a, 'ACGT', 'TGCA') for a in al] else al end as fl, case when q_pos <= len then substring('ACGT', ((q_pos-1) % 4 + 1)::int, 1) else 'N' end as base from m join n on m.chrom = n.chrom),
t as (select *, (coalesce(list_position(fl, base), 0)-1)::int as s, vid as v from f),
u as (select *, unnest([0, 1]) as k from t)
select vid, q_chrom as chrom, q_pos as pos, array_to_string(case when s = -1 then list_prepend(base, fl) when s > 0 then [case when i = 0 then fl[s+1] when i = s then fl[1] else fl[i+1] end for i in [0, 1, 2]] else fl end, ',') as alleles, s as swap,
{_JOINED(_RESTS('v%11', 'v%7', '100'))} as ac, {_JOINED(_RESTS('0.25::double', '0.5::double', '1'))} as af,
{_JOINED('(case s when -1 then [null, v, v+1, v+2] when 1 then [v+1, v, v+2] when 2 then [v+2, v+1, v] else [v, v+1, v+2] end)')} as rd, {_JOINED(_GENOTYPES('[v*10, v*10+1, v*10+2, v*10+3, v*10+4, v*10+5]'))} as gl,
{_JOINED(_RENUMBERED('[v%3]'))} as allele_a, 'x' as xx, q_pos::varchar as end, case when s <> 0 then s::varchar end as swap_1, case when q_strand = 1 then '' end as flip, pos::varchar as src_pos, array_to_string(al, ',') as src_ref_alt,
's'||k as sample, {_JOINED(_RENUMBERED('[(v+k)%3, case when k = 0 then v%2 end]'))} as gt, {', '.join(f"{_RESTS('(v%3/4.0::double)', '(v%2/2.0::double)', '2')}[{i + 1}]::double as ds{i}" for i in range(3))},
{_JOINED(_GENOTYPES('[v*10+k, v*10+1+k, v*10+2+k, v*10+3+k, v*10+4+k, v*10+5+k]'))} as gp, {_JOINED('(case s when -1 then [null, v%5+k, v%6] else [case when s = 1 then -(v%5+k) else v%5+k end, case when s = 2 then -(v%6) else v%6 end] end)')} as es from u"""

ORACLES = {k: with_views(v) for k, v in {
    "chain_blocks": "select chain_ind, line, coalesce(sum(size+dt) over w, 0)::bigint as t_start, coalesce(sum(size+dq) over w, 0)::bigint as q_start, size from chain_lines window w as (partition by chain_ind order by line rows between unbounded preceding and 1 preceding)",
    "chain_merge": """with t as (select *, coalesce(sum(size+dt) over w, 0)::bigint as ts, coalesce(sum(size+dq) over w, 0)::bigint as qs, coalesce(lag(dt) over o = lag(dq) over o and lag(dt) over o <= 1, false) as joined from chain_lines window w as (partition by chain_ind order by line rows between unbounded preceding and 1 preceding), o as (partition by chain_ind order by line)),
i as (select *, sum(case when joined then 0 else 1 end) over (partition by chain_ind order by line) as island from t)
select chain_ind, min(line) as line, min(ts) as t_start, min(qs) as q_start, max(ts+size)-min(ts) as size from i group by chain_ind, island""",
    "chain_file": """with t as (select *, coalesce(sum(size+dt) over w, 0)::bigint as ts, coalesce(sum(size+dq) over w, 0)::bigint as qs, coalesce(lag(dt) over o = lag(dq) over o and lag(dt) over o <= 1, false) as joined from chain_lines window w as (partition by chain_ind order by line rows between unbounded preceding and 1 preceding), o as (partition by chain_ind order by line)),
i as (select *, sum(case when joined then 0 else 1 end) over (partition by chain_ind order by line) as island from t)
select chain_ind, min(line) as line, min(ts) as t_start, min(qs) as q_start, max(ts+size)-min(ts) as size from i group by chain_ind, island""",
    "chain_neighbours": "select chain_ind, block_ind, " + ", ".join(f"coalesce({c}_start-lag({c}_start+size) over w, -1) as {c}_start_gap, coalesce(lead({c}_start) over w-{c}_start-size, -1) as {c}_end_gap" for c in "tq") + " from chain_blocks window w as (partition by chain_ind order by t_start)",
    "chain_dedup": "select min(block_ind) as chain_ind, block_ind % 50 as id from chain_blocks where block_ind % 50 > 0 group by block_ind % 50 union all select block_ind as chain_ind, 0 as id from chain_blocks where block_ind % 50 = 0",
    "lift_point": f"with l as ({_BLOCK}) select v.vid, q_chrom, q_pos, q_strand, chain_ind as chain, block_ind as block from variants v left join l on v.vid = l.vid",
    "lift_flip": f"{_SINGLE} select vid, q_pos, case when q_pos is not null then a end as q_ref, case when q_pos is not null then b end as q_alt, coalesce(q_strand = 1, false) as flip from t",
    "lift_ref_snp": f"{_REF} select vid, q_pos, case swap when 0 then a when 1 then b when -1 then base end as q_ref, case swap when 0 then b when 1 then a when -1 then a||','||b end as q_alt, swap, chrom as src_chrom, pos as src_pos, ref||','||alt as src_ref_alt from w",
    "lift_reject": f"with l as ({_BLOCK}) select v.vid, case when v.vid % 9 = 0 then 'MissingContig' else 'UnmappedAnchors' end as reject_reason from variants v left join l on v.vid = l.vid where v.vid % 9 = 0 or l.vid is null",
    "lift_counts": f"{_REF} select count(*) as total, count(*) filter (where swap > 0) as swapped, count(*) filter (where swap = -1) as ref_added, count(*) filter (where q_pos is null) as rejected from w",
    "lift_end": f"with sp as (select vid, chrom, pos, pos+vid % 3000 as e from variants), {_AT('pos', 'a5')}, {_AT('e', 'a3')} select sp.vid, a5_q as q_pos, case when a5_chrom = a3_chrom and a5_s = a3_s and (case when a5_s = 1 then a5_q >= a3_q else a3_q >= a5_q end) then a3_q end as q_end from sp left join a5 on a5.vid = sp.vid left join a3 on a3.vid = sp.vid",
    "lift_anchors": _ANCHORS, "lift_records": _RECORDS,
    "lift_nw": "select vid, 2-6-2 as score from variants",  # both bases match, and one gap takes the two others
    "lift_extend": f"select vid, pos+vid as x_pos, case when vid % 2 = 0 then {_BASE(0)}||{_BASE(1)}||{_BASE(2)}||','||{_BASE(0)}||{_BASE(2)} else {_BASE(0)}||{_BASE(1)}||{_BASE(2)}||','||{_BASE(0)}||{_BASE(1)}||{_BASE(1)}||{_BASE(2)} end as alleles from variants",
    "lift_left_align": f"""select vid, pos+vid+case vid % 3 when 0 then 2 when 1 then -1 else -2 end as y_pos, case vid % 3 when 0 then {_BASE(2)}||','||{_BASE(3)}
when 1 then {_BASE(-1)}||','||{_BASE(-1)}||{_BASE(0)} else {_BASE(-2)}||','||{_BASE(-2)}||{_BASE(-1)}||{_BASE(0)} end as alleles from variants""",
    "swap_ac": _complement_sql("v%11", "v%7", "100"), "swap_af": _complement_sql("(v%3/4.0::double)", "(v%2/8.0::double)", "1"), "swap_ds": _complement_sql("(v%3/4.0::double)", "(v%2/2.0::double)", "2"),
    "swap_es": _list_sql("[case when s = 1 then -(v%5) else v%5 end, case when s = 2 then -(v%6) else v%6 end]", "[null, v%5, v%6]", "[v%5, v%6]", 3),
    "swap_r": _list_sql("[case when s = 1 then v+1 else v+2 end, case when s = 1 then v else v+1 end, case when s = 2 then v else v+2 end]", "[null, v, v+1, v+2]", "[v, v+1, v+2]", 4),
    "swap_g": _list_sql(f"[{_G}[i] for i in case when s = 1 then [3, 2, 1, 5, 4, 6] else [6, 5, 3, 4, 2, 1] end]", "[null, null, v*10, null, v*10+1, v*10+2, null, v*10+3, v*10+4, v*10+5]", _G, 10),
    "swap_a": _list_sql("[v, v+1]", "[null, v, v+1]", "[v, v+1]", 3),
    "swap_gt": _list_sql("[case when g = 0 then s when g = s then 0 else g end for g in [v%2, v%3]]", "[v%2+1, v%3+1]", "[v%2, v%3]", 2),
    "swap_tags": """with t as (select vid, vid as v, (vid % 4 - 1)::int as s from variants) select vid, (case when s in (1, -1) then 100-v%11-v%7 else v%11 end)::double as ac, case when s in (1, -1) then 1-v%3/4.0::double-v%2/8.0::double else v%3/4.0::double end as af,
case when s in (1, -1) then 2-v%3/4.0::double-v%2/2.0::double else v%3/4.0::double end as ds, (case s when -1 then null when 1 then -(v%5) else v%5 end)::double as es, (case s when -1 then null when 0 then v else v+s end)::double as r,
(case s when -1 then null when 0 then v*10 when 1 then v*10+2 else v*10+5 end)::double as g, (case when s = -1 then null else v end)::double as a from t""",
}.items()}
