"""Variants from one genome build to another through chain blocks.

Single-base variants stay in Catalyst: an interval join on bins, strand flips and allele choice as Columns. Longer ones
are lifted by two anchors, and only their alleles pass through small Python helpers with a window of reference.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusloom.functions.alleles import strand_flip
from locusloom.functions.tables import cut
from locusloom.operators.indels import align as align_pairs
from locusloom.operators.indels import clip_padding, extend_alleles, find_reference, left_align, matches
from locusloom.operators.intervals import join_points
from locusloom.sources.fasta import OVERLAP, with_reference

MAX_INDEL = 250


def lift_points(rows: DataFrame, blocks: DataFrame, pos: str = "pos", prefix: str = "q", chrom: str = "chrom") -> DataFrame:
    """Add {prefix}_chrom, {prefix}_pos (1-based), {prefix}_strand, {prefix}_chain, {prefix}_block; null if unmapped.

    Of several blocks the last in file order counts. ``blocks`` are placed (see :mod:`locusloom.sources.chain`).
    """
    places = rows.select(F.col(chrom).alias("_place_c"), F.col(pos).alias("_place_p")).where("_place_c is not null and _place_p is not null").distinct()
    hits = join_points(places, blocks, [("_place_c", "b_chrom")], F.col("_place_p") - 1, "b_start", "b_end")
    off = F.col("_place_p") - 1 - F.col("b_start")
    q = F.when(F.col("q_strand") == 0, F.col("b_q") + off + 1).otherwise(F.col("q_size") - F.col("b_q") - off)
    found = hits.groupBy("_place_c", "_place_p").agg(F.max_by(F.struct(F.col("q_chrom"), q.alias("pos"), "q_strand", "chain_ind", "block_ind", "q_size"), F.struct("chain_ind", "block_ind")).alias("_at"))
    names = {"q_chrom": "chrom", "pos": "pos", "q_strand": "strand", "chain_ind": "chain", "block_ind": "block", "q_size": "size"}
    joined = rows.join(found, (F.col(chrom) == F.col("_place_c")) & (F.col(pos) == F.col("_place_p")), "left")
    return joined.select(*rows.columns, *[F.col(f"_at.{a}").alias(f"{prefix}_{b}") for a, b in names.items()])


def lift_ends(rows: DataFrame, blocks: DataFrame, start: str = "pos", end: str = "end") -> DataFrame:
    """Lift a record's position and its end: q_chrom, q_pos, q_strand and q_end, null where contig, strand or order don't agree."""
    both = lift_points(lift_points(rows, blocks, start), blocks, end, "z")
    order = F.when(F.col("q_strand") == 1, F.col("q_pos") >= F.col("z_pos")).otherwise(F.col("z_pos") >= F.col("q_pos"))
    same = (F.col("q_chrom") == F.col("z_chrom")) & (F.col("q_strand") == F.col("z_strand")) & order
    return both.withColumn("q_end", F.when(same, F.col("z_pos"))).select(*rows.columns, "q_chrom", "q_pos", "q_strand", "q_end")


def is_single(ref: Column, alt: Column) -> Column:
    return ref.rlike("^[ACGTNacgtn]$") & alt.rlike("^[ACGTNacgtn]$")


def lift_single(rows: DataFrame, blocks: DataFrame, fasta: DataFrame | None = None, write_src: bool = False) -> DataFrame:
    """Lift single-base variants: q_chrom, q_pos, q_ref, q_alt, flip, swap and reject_reason.

    swap is 0 if the destination has the ref allele, 1 if it has alt, -1 if neither (its base becomes ref and both
    alleles alternatives, as ``A,B``).
    """
    lifted = lift_points(rows, blocks).withColumn("flip", F.coalesce(F.col("q_strand") == 1, F.lit(False)))
    a, b = (F.when(F.col("flip"), strand_flip(F.col(c))).otherwise(F.col(c)) for c in ("ref", "alt"))
    lifted = lifted.withColumn("_a", a).withColumn("_b", b)
    if fasta is None:
        lifted = lifted.withColumn("_dst", F.col("_a"))
    else:
        lifted = with_reference(lifted, fasta, F.col("q_pos"), F.lit(1), "_dst", contig="q_chrom")
    swap = F.when(F.upper("_dst") == F.upper("_a"), 0).when(F.upper("_dst") == F.upper("_b"), 1).otherwise(-1)
    out = lifted.withColumn("swap", F.when(F.col("q_pos").isNotNull(), swap))
    out = out.withColumn("q_ref", F.when(F.col("swap") == 0, F.col("_a")).when(F.col("swap") == 1, F.col("_b")).when(F.col("swap") == -1, F.col("_dst")))
    out = out.withColumn("q_alt", F.when(F.col("swap") == 0, F.col("_b")).when(F.col("swap") == 1, F.col("_a")).when(F.col("swap") == -1, F.concat_ws(",", "_a", "_b")))
    out = out.withColumn("reject_reason", reject_reason(F.col("q_pos").isNull()))
    if write_src:
        out = out.withColumn("src_chrom", F.col("chrom")).withColumn("src_pos", F.col("pos")).withColumn("src_ref_alt", F.concat_ws(",", "ref", "alt"))
    return out.drop("_a", "_b", "_dst")


def reject_reason(unmapped: Column) -> Column:
    return F.when(F.col("chrom").isNull(), "MissingContig").when(unmapped, "UnmappedAnchors")


def lift_spans(rows: DataFrame, blocks: DataFrame, start: str = "pos", end: str = "end", max_inc: int = MAX_INDEL) -> DataFrame:
    """Lift intervals by their first and last base: q_chrom, q_pos, q_end, q_strand, n_pad5, n_pad3, reject_reason.

    Where one anchor isn't mapped, the nearest block of the other's chain pads it; both must come down on one chain,
    contig and strand, in a span at most ``max_inc`` longer than the source's.
    """
    both = lift_points(lift_points(rows, blocks, start, "a"), blocks, end, "z")
    span = F.col(end) - F.col(start)
    mapped5, mapped3 = F.col("a_pos").isNotNull(), F.col("z_pos").isNotNull()
    # The edges of the chain's blocks around a block: where its neighbours end and begin.
    order = Window.partitionBy("chain_ind").orderBy("b_start", "block_ind")
    size = F.col("t_size").cast("long") if "t_size" in blocks.columns else F.lit(None).cast("long")
    near = blocks.select(
        "chain_ind", "block_ind", F.lag("b_end").over(order).alias("prev_end"), F.lead("b_start").over(order).alias("next_start"), size.alias("t_size")
    )
    for side, tag in (("z", "p"), ("a", "n")):
        edge = (F.col("prev_end" if tag == "p" else "next_start") + 1).alias(f"_{tag}")
        own = near.select(F.col("chain_ind").alias(f"_{tag}c"), F.col("block_ind").alias(f"_{tag}b"), edge, F.col("t_size").alias(f"_{tag}size"))
        both = both.join(own, (F.col(f"{side}_chain") == F.col(f"_{tag}c")) & (F.col(f"{side}_block") == F.col(f"_{tag}b")), "left").drop(f"_{tag}c", f"_{tag}b")
    pad5 = F.when(~mapped5 & mapped3, F.when(F.col("_p").isNotNull() & (F.col(start) - F.col("_p")).between(1, max_inc), F.col(start) - F.col("_p")).otherwise(F.when(span <= max_inc, F.least(F.lit(max_inc), F.col(start) - 1))))
    pad3 = F.when(mapped5 & ~mapped3, F.when(F.col("_n").isNotNull() & (F.col("_n") - F.col(end)).between(1, max_inc), F.col("_n") - F.col(end)).otherwise(F.when(span <= max_inc, F.lit(max_inc))))
    pad3 = F.least(pad3, F.col("_nsize") - F.col(end))  # a pad ends with its contig
    both = both.withColumn("n_pad5", F.coalesce(pad5, F.lit(0)).cast("long")).withColumn("n_pad3", F.coalesce(pad3, F.lit(0)).cast("long"))
    padded = lift_points(both.withColumn("_s5", F.col(start) - F.col("n_pad5")).withColumn("_e3", F.col(end) + F.col("n_pad3")), blocks, "_s5", "p5")
    padded = lift_points(padded, blocks, "_e3", "p3")
    anchor = lambda side: F.struct(*[F.col(f"{side}_{c}").alias(f"a_{c}") for c in ("chrom", "strand", "chain", "size", "pos")])
    good = F.when(mapped5, anchor("a")).otherwise(anchor("z"))
    padded = padded.withColumn("_g", good).withColumn("_plus", F.when(F.col("_g.a_strand") == 1, -1).otherwise(1))

    def other(tag: str, pad: Column, sign: int) -> Column:
        """The anchor opposite to the mapped one: lifted from the pad's end, else by arithmetic.

        On the reverse strand the pad alone counts, forwards the span too.
        """
        length = pad + F.when(F.col("_plus") == 1, span).otherwise(0)
        apart = (F.col(f"{tag}_pos") - F.col("_g.a_pos")) * F.col("_plus") * sign
        fits = (F.col(f"{tag}_chrom") == F.col("_g.a_chrom")) & (F.col(f"{tag}_strand") == F.col("_g.a_strand")) & apart.between(0, max_inc)
        return F.greatest(F.least(F.when(fits, F.col(f"{tag}_pos")).otherwise(F.col("_g.a_pos") + sign * F.col("_plus") * length), F.col("_g.a_size")), F.lit(1))

    first = F.when(mapped5, F.col("a_pos")).when(mapped3, other("p5", F.col("n_pad5"), -1))
    last = F.when(mapped3, F.col("z_pos")).when(mapped5, other("p3", F.col("n_pad3"), 1))
    padded = padded.withColumn("_first", first).withColumn("_last", last)
    same = (F.col("a_chain") == F.col("z_chain")) & (F.col("a_chrom") == F.col("z_chrom")) & (F.col("a_strand") == F.col("z_strand"))
    length = F.abs(F.col("_last") - F.col("_first"))
    reason = (
        F.when(~mapped5 & ~mapped3, "UnmappedAnchors").when(mapped5 & mapped3 & ~same, "MismatchAnchors").when(mapped5 & mapped3 & (length > span + max_inc), "ApartAnchors")
        .when(~mapped5 & pad5.isNull(), "UnmappedAnchor5").when(~mapped3 & pad3.isNull(), "UnmappedAnchor3")
    )
    ok = F.col("reject_reason").isNull()
    out = padded.withColumn("reject_reason", reason)
    return out.select(
        *rows.columns, F.when(ok, F.col("_g.a_chrom")).alias("q_chrom"), F.when(ok, F.least("_first", "_last")).alias("q_pos"), F.when(ok, F.greatest("_first", "_last")).alias("q_end"),
        F.when(ok, F.col("_g.a_strand")).alias("q_strand"), "n_pad5", "n_pad3", "reject_reason",
    )


def _alleles_and(*numbers: str) -> T.StructType:
    return T.StructType([T.StructField("alleles", T.ArrayType(T.StringType())), *(T.StructField(n, T.IntegerType()) for n in numbers)])


@F.pandas_udf(_alleles_and("n_left", "n_right"))
def extended(alleles: pd.Series, left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Alleles made unique at both ends by reference bases from the windows around."""
    out = [extend_alleles(list(a), x or "", y or "") for a, x, y in zip(alleles, left, right, strict=True)]
    return pd.DataFrame(out, columns=["alleles", "n_left", "n_right"])


@F.pandas_udf(_alleles_and("moved", "used"))
def aligned(alleles: pd.Series, left: pd.Series) -> pd.DataFrame:
    """Alleles trimmed and left-aligned within the window before them; ``used`` tells how much of it they moved through."""
    return pd.DataFrame([left_align(list(a), x or "") for a, x in zip(alleles, left, strict=True)], columns=["alleles", "moved", "used"])


@F.pandas_udf(_alleles_and("swap", "moved", "n_matches"))
def told_reference(alleles: pd.Series, target: pd.Series, single: pd.Series) -> pd.DataFrame:
    """Which allele the destination's ``target`` is and how many are, with the alleles' ends made the destination's."""
    rows = zip(alleles, target, single, strict=True)
    out = [(*find_reference(list(a), t, bool(s)), len(matches(list(a), t))) if t else (list(a), None, 0, None) for a, t, s in rows]
    return pd.DataFrame(out, columns=["alleles", "swap", "moved", "n_matches"]).astype({"swap": "Int32", "n_matches": "Int32"})


@F.pandas_udf(T.IntegerType())
def pad_taken(alleles: pd.Series, pad: pd.Series, target: pd.Series, at_left: pd.Series) -> pd.Series:
    """How many bases of ``target`` belong to the pad; a batch's alignments are made together."""
    return pd.Series(clip_padding([list(a) for a in alleles], list(pad), list(target), list(at_left)))


def _in_windows(rows: DataFrame, fasta: DataFrame, contig: str, first: str, last: str | None, window: int, told: Column, used_left: Column, used_right: Column, out: str) -> DataFrame:
    """Add ``out``: ``told`` of the reference ``_left`` of ``first`` and ``_right`` of ``last``.

    Rows that used up a window get the bases beyond it, until none does or the contig ends.
    """
    todo = rows.withColumn("_left", F.lit("")).withColumn("_right", F.lit(""))
    reach, done = min(window, OVERLAP), None
    while True:
        n = F.least(F.lit(reach), F.col(first) - 1 - F.length("_left"))
        todo = with_reference(todo, fasta, F.col(first) - F.length("_left") - n, n, "_l", contig=contig)
        if last is None:
            todo = todo.withColumn("_r", F.lit(""))
        else:
            todo = with_reference(todo, fasta, F.col(last) + 1 + F.length("_right"), F.lit(reach), "_r", contig=contig, short=True)
        new = lambda c: F.coalesce(F.col(c), F.lit(""))
        todo = todo.withColumn("_left", F.concat(new("_l"), "_left")).withColumn("_right", F.concat("_right", new("_r"))).withColumn(out, told)
        more = (used_left & (F.length(new("_l")) > 0)) | (used_right & (F.length(new("_r")) > 0))
        todo = cut(todo.withColumn("_more", F.coalesce(more, F.lit(False))))
        part = todo.where(~F.col("_more")).select(*rows.columns, out)
        done = part if done is None else done.unionByName(part)
        todo = todo.where("_more").select(*rows.columns, "_left", "_right")
        if todo.isEmpty():
            return done
        reach = OVERLAP


def _extended_in_windows(rows: DataFrame, src: DataFrame, window: int) -> DataFrame:
    """Add _x, the alleles ``_alleles`` from pos to ``_ref_end`` extended by as much reference as they need."""
    used_left, used_right = F.col("_x.n_left") >= F.length("_left"), F.col("_x.n_right") >= F.length("_right")
    return _in_windows(rows, src, "chrom", "pos", "_ref_end", window, extended("_alleles", "_left", "_right"), used_left, used_right, "_x")


@F.pandas_udf(T.IntegerType())
def alignment_score(query: pd.Series, target: pd.Series) -> pd.Series:
    """The best score of global alignments with affine gaps; a batch's are made together."""
    q, t = query.fillna("").tolist(), target.fillna("").tolist()
    return pd.Series(align_pairs(q, t, [0] * len(q), [False] * len(q))[0]) if q else pd.Series([], dtype=int)


def with_alleles(rows: DataFrame) -> DataFrame:
    """``rows`` with the array ``alleles``, made of ref and alt where there is none."""
    return rows if "alleles" in rows.columns else rows.withColumn("alleles", F.array("ref", "alt"))


def are_single(alleles: Column) -> Column:
    """Whether all alleles are single bases (or ``*``, which is none)."""
    return F.forall(alleles, lambda a: a.rlike(r"^[ACGTNacgtn*]$"))


def exchanged(alleles: Column, s: Column, reference: Column) -> Column:
    """The alleles with allele ``s`` first, or, where it is -1, with a new ``reference`` before all."""
    moved = F.transform(alleles, lambda a, i: F.when(i == 0, F.get(alleles, s)).when(i == s, F.get(alleles, F.lit(0))).otherwise(a))
    return F.when(s > 0, moved).when(s == -1, F.array_prepend(alleles, reference)).otherwise(alleles)


def _without_pads(lifted: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """Spans whose anchor is a pad's end are made those of the alleles, by aligning pad and alleles with the destination."""
    left, right = F.col("n_pad5") > 0, F.col("n_pad3") > 0
    first = F.when(left, F.col("_s") - F.col("n_pad5")).when(right, F.col("_e") + 1)
    keyed = lifted.withColumn("_first", first).withColumn("_left", left != F.col("flip"))
    keyed = with_reference(keyed, src, F.col("_first"), F.col("n_pad5") + F.col("n_pad3"), "_pad", contig="chrom")
    keyed = keyed.withColumn("_pad", F.when(F.col("flip"), strand_flip(F.col("_pad"))).otherwise(F.col("_pad")))
    padded = F.col("_first").isNotNull() & (F.col("q_end") > F.col("q_pos"))
    keyed = with_reference(keyed, dst, F.when(padded, F.col("q_pos")), F.col("q_end") - F.col("q_pos") + 1, "_whole", contig="q_chrom")
    keyed = keyed.withColumn("_taken", pad_taken("_al", "_pad", "_whole", F.coalesce("_left", F.lit(False))))
    keyed = keyed.withColumn("q_pos", F.when(F.col("_left"), F.col("q_pos") + F.col("_taken")).otherwise(F.col("q_pos")))
    keyed = keyed.withColumn("q_end", F.when(F.col("_left"), F.col("q_end")).otherwise(F.col("q_end") - F.col("_taken")))
    return keyed.drop("_first", "_left", "_pad", "_whole", "_taken")


TOLD = ("q_chrom", "q_pos", "q_alleles", "flip", "swap", "n_matches", "n_pad5", "n_pad3", "reject_reason")


def lift_longer(rows: DataFrame, blocks: DataFrame, src: DataFrame | None, dst: DataFrame, window: int = 100, max_inc: int = MAX_INDEL, align: bool = True) -> DataFrame:
    """Lift variants with longer alleles: q_chrom, q_pos, q_alleles, flip, swap, n_matches, n_pad5, n_pad3, reject_reason.

    ``rows`` have ref and alt, or ``alleles``, any number of them. Alleles are extended to be unique, lifted by their anchors, flipped,
    told which of them the destination has and left-aligned there. Where one anchor is mapped only with a pad, pad and alleles
    are aligned with the destination's bases. n_matches tells how many alleles the destination could have; of several
    the first is taken. ``window`` bases of reference are looked at first, and more for the rows that need more. Without ``src``
    alleles stay as they are, and rows that need a pad are rejected.
    """
    blocks = cut(blocks)
    keyed = with_alleles(rows).withColumn("_alleles", F.col("alleles")).withColumn("_ref_end", F.col("pos") + F.length(F.get("alleles", F.lit(0))) - 1)
    if src is None:
        keyed = keyed.withColumn("_x", F.struct(F.col("_alleles").alias("alleles"), F.lit(0).alias("n_left"), F.lit(0).alias("n_right")))
    else:
        keyed = _extended_in_windows(keyed, src, window)
    keyed = keyed.withColumn("_s", F.col("pos") - F.col("_x.n_left")).withColumn("_e", F.col("_ref_end") + F.col("_x.n_right"))
    lifted = lift_spans(keyed, blocks, "_s", "_e", max_inc).withColumn("flip", F.coalesce(F.col("q_strand") == 1, F.lit(False)))
    lifted = lifted.withColumn("_al", F.transform("_x.alleles", lambda a: F.when(F.col("flip"), strand_flip(a)).otherwise(a)))
    if src is None:
        padded = F.col("reject_reason").isNull() & (F.col("n_pad5") + F.col("n_pad3") > 0)
        lifted = lifted.withColumn("reject_reason", F.when(padded, "MissingFasta").otherwise(F.col("reject_reason")))
        lifted = lifted.withColumns({c: F.when(F.col("reject_reason").isNull(), F.col(c)) for c in ("q_chrom", "q_pos", "q_end")})
    else:
        lifted = _without_pads(lifted, src, dst)
    lifted = with_reference(lifted, dst, F.col("q_pos"), F.col("q_end") - F.col("q_pos") + 1, "_dst", contig="q_chrom")
    lifted = lifted.withColumn("_t", told_reference("_al", "_dst", are_single(F.col("_alleles"))))
    lifted = lifted.withColumn("swap", F.when(F.col("_dst").isNotNull(), F.col("_t.swap"))).withColumn("_al", F.col("_t.alleles"))
    lifted = lifted.withColumn("n_matches", F.col("_t.n_matches"))
    lifted = lifted.withColumn("q_pos", F.col("q_pos") + F.coalesce("_t.moved", F.lit(0)))
    lifted = lifted.withColumn("_al", exchanged(F.col("_al"), F.col("swap"), F.col("_dst")))
    if align:
        used_up = F.col("_y.used") >= F.length("_left")
        lifted = _in_windows(lifted, dst, "q_chrom", "q_pos", None, window, aligned("_al", "_left"), used_up, F.lit(False), "_y")
        lifted = lifted.withColumn("q_pos", F.col("q_pos") + F.col("_y.moved")).withColumn("_al", F.col("_y.alleles"))
    return lifted.select(*rows.columns, *[(F.col("_al") if c == "q_alleles" else F.col(c)).alias(c) for c in TOLD])


def extend_rows(rows: DataFrame, src: DataFrame, window: int = 100) -> DataFrame:
    """Without a chain: x_pos and x_alleles, the alleles extended by the source reference until they are unique."""
    keyed = with_alleles(rows).withColumn("_alleles", F.col("alleles")).withColumn("_ref_end", F.col("pos") + F.length(F.get("alleles", F.lit(0))) - 1)
    keyed = _extended_in_windows(keyed, src, window)
    return keyed.select(*rows.columns, (F.col("pos") - F.col("_x.n_left")).alias("x_pos"), F.col("_x.alleles").alias("x_alleles"))


def align_rows(rows: DataFrame, fasta: DataFrame, window: int = 100) -> DataFrame:
    """y_pos and y_alleles, the alleles trimmed and moved as far left as ``fasta`` allows."""
    keyed = with_alleles(rows).withColumn("_alleles", F.col("alleles"))
    out = _in_windows(keyed, fasta, "chrom", "pos", None, window, aligned("_alleles", "_left"), F.col("_y.used") >= F.length("_left"), F.lit(False), "_y")
    return out.select(*rows.columns, (F.col("pos") + F.col("_y.moved")).alias("y_pos"), F.col("_y.alleles").alias("y_alleles"))


#: Names of the mitochondrion.
MITOCHONDRION = ("MT", "chrM", "M", "chrMT")


def _lift_bases(rows: DataFrame, blocks: DataFrame, dst: DataFrame | None) -> DataFrame:
    """Lift variants whose alleles are single bases, any number of them."""
    lifted = lift_points(rows, blocks).withColumn("flip", F.coalesce(F.col("q_strand") == 1, F.lit(False)))
    lifted = lifted.withColumn("_al", F.transform("alleles", lambda a: F.when(F.col("flip"), strand_flip(a)).otherwise(a)))
    if dst is None:
        lifted = lifted.withColumn("_dst", F.get("_al", F.lit(0)))
    else:
        lifted = with_reference(lifted, dst, F.col("q_pos"), F.lit(1), "_dst", contig="q_chrom")
    upper = F.transform("_al", lambda a: F.upper(a))
    at = F.array_position(upper, F.upper("_dst")).cast("int") - 1  # -1 if no allele is
    lifted = lifted.withColumn("swap", F.when(F.col("q_pos").isNotNull(), F.coalesce(at, F.lit(-1))))
    many = F.size(F.filter(upper, lambda a: a == F.upper("_dst")))
    zero = F.lit(0).cast("long")
    told = {"q_alleles": exchanged(F.col("_al"), F.col("swap"), F.coalesce("_dst", F.lit("N"))), "n_matches": many, "n_pad5": zero, "n_pad3": zero, "reject_reason": F.lit(None).cast("string")}
    return lifted.withColumns(told).drop("_al", "_dst")


def lift(rows: DataFrame, blocks: DataFrame, src: DataFrame | None, dst: DataFrame, mt_name: str | None = "chrM", window: int = 100, max_inc: int = MAX_INDEL, align: bool = True) -> DataFrame:
    """Lift variants of all kinds: q_chrom, q_pos, q_alleles, flip, swap, n_matches, n_pad5, n_pad3, reject_reason.

    ``rows`` have ref and alt, or ``alleles``, any number of them. Single bases take the short way, those whose base isn't mapped and longer
    alleles the way by anchors; symbolic alleles are moved as points with their alleles as they are. Mitochondrial rows keep their
    position under ``mt_name``; with None they are lifted too.
    """
    # Variants are placed once each, without their rows' other columns; these are joined once.
    same = rows.select("chrom", "pos", *(["alleles"] if "alleles" in rows.columns else ["ref", "alt"]))
    placed = _lifted(with_alleles(same).select("chrom", "pos", "alleles").where("chrom is not null").distinct(), blocks, src, dst, mt_name, window, max_inc, align)
    placed = placed.select(F.col("chrom").alias("_kc"), F.col("pos").alias("_kp"), F.col("alleles").alias("_ka"), *TOLD)
    own = F.col("alleles") if "alleles" in rows.columns else F.array("ref", "alt")
    out = rows.join(placed, (F.col("chrom") == F.col("_kc")) & (F.col("pos") == F.col("_kp")) & (own == F.col("_ka")), "left").select(*rows.columns, *TOLD)
    nowhere = F.when(F.col("chrom").isNull(), "MissingContig").when(F.col("q_pos").isNull() & F.col("reject_reason").isNull(), "UnmappedAnchors")
    return out.withColumn("reject_reason", F.coalesce(nowhere, "reject_reason")).withColumn("flip", F.coalesce("flip", F.lit(False)))


def _lifted(keyed: DataFrame, blocks: DataFrame, src: DataFrame | None, dst: DataFrame, mt_name: str | None, window: int, max_inc: int, align: bool) -> DataFrame:
    """Variants (chrom, pos, alleles) with where they go, written down."""
    own, blocks = keyed.columns, cut(blocks)
    mito = F.coalesce(F.col("chrom").isin(*MITOCHONDRION), F.lit(False)) if mt_name else F.lit(False)
    alts = F.slice("alleles", F.lit(2), F.greatest(F.size("alleles") - 1, F.lit(0)))
    symbolic = F.exists(alts, lambda a: a.rlike(r"^<|[\[\]]")) | ((F.size(alts) > 0) & F.forall(alts, lambda a: a == "*"))
    keyed = cut(keyed.withColumn("_kind", F.when(mito, "mito").when(symbolic, "symbolic").when(are_single(F.col("alleles")), "single").otherwise("longer")))
    kind = lambda k: keyed.where(F.col("_kind") == k).drop("_kind")
    kinds = {r[0] for r in keyed.select("_kind").distinct().collect()}  # four at most
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("int")
    as_is = {"q_alleles": F.col("alleles"), "n_matches": none, "n_pad5": zero, "n_pad3": zero}
    same = {"q_chrom": F.lit(mt_name).cast("string"), "q_pos": F.col("pos"), "flip": F.lit(False), "swap": F.lit(0), "reject_reason": F.lit(None).cast("string")}
    parts, longer = [kind("mito").withColumns(as_is | same)], kind("longer")
    if "symbolic" in kinds:
        points = lift_points(kind("symbolic"), blocks)
        parts.append(points.withColumns(as_is | {"flip": F.coalesce(F.col("q_strand") == 1, F.lit(False)), "swap": none, "reject_reason": reject_reason(F.col("q_pos").isNull())}))
    if "single" in kinds:
        single = cut(_lift_bases(kind("single"), blocks, dst).select(*own, *TOLD))
        parts.append(single.where(F.col("q_pos").isNotNull()))
        longer = longer.unionByName(single.where(F.col("q_pos").isNull()).select(*own))
    if not longer.isEmpty():
        parts.append(lift_longer(longer, blocks, src, dst, window, max_inc, align))
    out = parts[0].select(*own, *TOLD)
    for p in parts[1:]:
        out = out.unionByName(p.select(*own, *TOLD))
    return cut(out)


def counts(lifted: DataFrame) -> DataFrame:
    """(total, swapped, ref_added, rejected)."""
    return lifted.agg(F.count("*").alias("total"), F.count_if(F.col("swap") > 0).alias("swapped"), F.count_if(F.col("swap") == -1).alias("ref_added"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"))
