import itertools
import random

import pytest
from pyspark.sql import functions as F

from locusloom.operators import indels, liftover
from locusloom.sources.fasta import chunked

BLOCKS = "chain_ind int, block_ind int, b_chrom string, b_start long, b_end long, b_q long, q_chrom string, q_size long, q_strand int, t_start_gap long, t_end_gap long, q_start_gap long, q_end_gap long"


def blocks(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], BLOCKS)


def test_point_formulas(spark):
    b = blocks(spark, [(0, 0, "c1", 0, 50, 100, "d", 1000, 0), (1, 1, "c2", 0, 50, 100, "d", 1000, 1)])
    rows = spark.createDataFrame([(1, "c1", 4), (2, "c2", 4), (3, "c1", 60)], "k int, chrom string, pos long")
    assert {r.k: r.q_pos for r in liftover.lift_points(rows, b).collect()} == {1: 104, 2: 897, 3: None}


def test_last_block_counts(spark):
    b = blocks(spark, [(0, 0, "c", 0, 50, 0, "d", 1000, 0), (1, 3, "c", 10, 20, 500, "e", 1000, 0)])
    got = liftover.lift_points(spark.createDataFrame([(1, "c", 15)], "k int, chrom string, pos long"), b).first()
    assert (got.q_chrom, got.q_pos, got.q_block) == ("e", 505, 3)


def test_there_and_back(spark):
    forth = [(0, 0, "c", 100, 199, 1000, "d", 5000, 0), (1, 1, "c", 300, 399, 50, "d", 5000, 1)]
    back = [(0, 0, "d", 1000, 1099, 100, "c", 900, 0), (1, 1, "d", 5000 - 150, 5000 - 51, 900 - 400, "c", 900, 1)]
    rows = spark.createDataFrame([(p, "c", p) for p in (101, 150, 200, 301, 350, 400)], "k int, chrom string, pos long")
    there = liftover.lift_points(rows, blocks(spark, forth)).select("k", F.col("q_chrom").alias("chrom"), F.col("q_pos").alias("pos"))
    assert all(r.q_pos == r.k for r in liftover.lift_points(there, blocks(spark, back)).collect())


def test_swap_and_new_reference(spark):
    b = blocks(spark, [(0, 0, "c", 0, 99, 0, "d", 100, 0)])
    seqs = chunked(spark.createDataFrame([("d", "ACGT" * 25)], "contig string, seq string"))
    rows = spark.createDataFrame([(1, "c", 1, "A", "C"), (2, "c", 1, "C", "A"), (3, "c", 1, "C", "G"), (4, "x", 1, "C", "G")], "k int, chrom string, pos long, ref string, alt string")
    got = {r.k: (r.swap, r.q_ref, r.q_alt, r.reject_reason) for r in liftover.lift_single(rows, b, seqs).collect()}
    assert got == {1: (0, "A", "C", None), 2: (1, "A", "C", None), 3: (-1, "A", "C,G", None), 4: (None, None, None, "UnmappedAnchors")}


def test_reject_reasons_of_spans(spark):
    b = blocks(spark, [(0, 0, "c", 0, 99, 0, "d", 9000, 0), (0, 1, "c", 200, 299, 1000, "d", 9000, 0), (1, 2, "c", 400, 499, 5000, "d", 9000, 0), (2, 3, "e", 0, 99, 0, "d", 9000, 1)])
    rows = [(1, "c", 10, 20), (2, "c", 10, 250), (3, "c", 250, 450), (4, "c", 120, 130), (5, "c", 90, 110), (6, "e", 10, 20), (7, "c", 150, 205)]
    got = {r.k: (r.q_pos, r.q_end, r.q_strand, r.reject_reason) for r in liftover.lift_spans(spark.createDataFrame(rows, "k int, chrom string, pos long, end long"), b).collect()}
    assert got[1] == (10, 20, 0, None) and got[6] == (9000 - 19, 9000 - 9, 1, None)
    assert got[2][3] == "ApartAnchors" and got[3][3] == "MismatchAnchors" and got[4][3] == "UnmappedAnchors"
    assert got[5][3] is None and got[5][0] == 90 and got[7][3] is None and got[7][1] == 1005


def test_deletion_is_left_aligned(spark):
    src, dst = "GGCATATATCC" + "G" * 60, "TT" + "GGCATATATCC" + "G" * 60
    b = blocks(spark, [(0, 0, "c", 0, len(src) - 1, 2, "d", len(dst), 0)])
    seqs = lambda c, s: chunked(spark.createDataFrame([(c, s)], "contig string, seq string"))
    rows = spark.createDataFrame([(1, "c", 5, "TAT", "T")], "k int, chrom string, pos long, ref string, alt string")
    got = liftover.lift_longer(rows, b, seqs("c", src), seqs("d", dst)).first()
    assert (got.q_chrom, got.q_pos, got.q_alleles, got.swap, got.reject_reason) == ("d", 5, ["CAT", "C"], 0, None)


def test_all_kinds_at_once(spark):
    src, dst = "GGCATATATCC" + "GATTACA" * 20, "TT" + "GGCATATATCC" + "GATTACA" * 20
    b = blocks(spark, [(0, 0, "c", 0, 30, 2, "d", len(dst), 0), (0, 1, "c", 32, len(src) - 1, 34, "d", len(dst), 0)])
    seqs = lambda c, s: chunked(spark.createDataFrame([(c, s)], "contig string, seq string"))
    rows = [(1, "c", 5, "TAT", "T"), (2, "c", 3, "C", "G"), (3, "c", 3, "C", "<DEL>"), (4, "MT", 3, "C", "G"), (5, "x", 3, "C", "G"), (6, "c", 32, src[31], "C"), (7, None, 3, "C", "G")]
    got = {r.k: (r.q_chrom, r.q_pos, r.q_alleles, r.swap, r.reject_reason) for r in liftover.lift(spark.createDataFrame(rows, "k int, chrom string, pos long, ref string, alt string"), b, seqs("c", src), seqs("d", dst)).collect()}
    assert got[1] == ("d", 5, ["CAT", "C"], 0, None) and got[2] == ("d", 5, ["C", "G"], 0, None) and got[3] == ("d", 5, ["C", "<DEL>"], None, None)
    assert got[4] == ("chrM", 3, ["C", "G"], 0, None) and got[5][4] == "UnmappedAnchors" and got[7][4] == "MissingContig"
    assert got[6] == ("d", 34, [src[31], "C"], 0, None)
    assert len(got) == 7


def test_extension_without_chain(spark):
    seqs = chunked(spark.createDataFrame([("c", "GGCATATATCC" + "G" * 200)], "contig string, seq string"))
    got = liftover.extend_rows(spark.createDataFrame([("c", 4, "ATA", "A")], "chrom string, pos long, ref string, alt string"), seqs).first()
    assert got.x_pos == 3 and got.x_alleles[0] == "CATATATC" and got.x_alleles[1] == "CATATC"


def apply(reference, pos, ref, alt):
    assert reference[pos - 1 : pos - 1 + len(ref)] == ref
    return reference[: pos - 1] + alt + reference[pos - 1 + len(ref) :]


def test_helpers_keep_the_haplotype():
    rng = random.Random(4)
    for _ in range(500):
        reference = "".join(rng.choice("AC") for _ in range(60))
        pos, n = rng.randint(20, 40), rng.randint(1, 4)
        ref = reference[pos - 1 : pos - 1 + n]
        alt = "".join(rng.choice("AC") for _ in range(rng.randint(1, 4)))
        if alt == ref:
            continue
        want = apply(reference, pos, ref, alt)
        alleles, moved, _ = indels.left_align([ref, alt], reference[: pos - 1])
        assert apply(reference, pos + moved, *alleles) == want
        wide, left, right = indels.extend_alleles([ref, alt], reference[: pos - 1], reference[pos - 1 + n :])
        assert apply(reference, pos - left, *wide) == want and len(wide[0]) == n + left + right
        again, further, _ = indels.left_align(alleles, reference[: pos - 1 + moved])
        assert (again, further) == (alleles, 0)
        # No equal variant lies further left.
        for p, k in itertools.product(range(1, pos + moved), range(1, 9)):
            r = reference[p - 1 : p - 1 + k]
            a = len(want) - len(reference) + k
            if a >= 1 and p + k - 1 < pos + moved:
                assert reference[: p - 1] + want[p - 1 : p - 1 + a] + reference[p - 1 + k :] != want or r == want[p - 1 : p - 1 + a]


def brute(query, target):
    """The best of all global alignments with affine gaps, by search."""
    from functools import lru_cache

    @lru_cache(None)
    def best(i, j, gap):
        if i == len(query) and j == len(target):
            return 0
        out = -(10**6)
        if i < len(query) and j < len(target):
            same = query[i] == target[j] or "N" in (query[i], target[j])
            out = best(i + 1, j + 1, 0) + (indels.MATCH if same else indels.MISMATCH)
        if i < len(query):
            out = max(out, best(i + 1, j, 1) + indels.EXTEND + (gap != 1) * indels.OPEN)
        if j < len(target):
            out = max(out, best(i, j + 1, 2) + indels.EXTEND + (gap != 2) * indels.OPEN)
        return out

    return best(0, 0, 0)


def test_alignment_score():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ("".join(rng.choice("ACGN") for _ in range(rng.randint(0, 7))) for _ in range(2))
        assert indels.align([a], [b], [0], [False])[0][0] == brute(a, b)


@pytest.mark.parametrize(
    ("alleles", "target", "single", "told"),
    [
        (["A", "C"], "C", False, (["A", "C"], 1, 0)),
        (["A", "C"], "G", False, (["A", "C"], -1, 0)),
        (["ACGT", "AT"], "TCGA", False, (["TCGA", "TA"], 0, 0)),
        (["ACGT", "*", "AT"], "TT", False, (["TCGT", "*", "TT"], 2, 0)),
        (["ACGT", "AT"], "ACCT", False, (["ACGT", "AT"], -1, 0)),
        (["CAG", "CTG"], "CTGGG", True, (["CAG", "CTG"], 1, 0)),
        (["CAG", "CTG"], "GGCAG", True, (["CAG", "CTG"], 0, 2)),
        (["CAG", "CTG"], "CAGCTG", True, (["CAG", "CTG"], -1, 0)),
    ],
)
def test_reference_search(alleles, target, single, told):
    assert indels.find_reference(alleles, target, single) == told


@pytest.mark.parametrize("unit", ["A", "CAT"])
def test_repeats_longer_than_the_window(spark, unit):
    """Deletions in a long repeat are extended over all of it and aligned to its start, also at the contig's end."""
    head, run = "GC" * 20 + "G", unit * 900
    seq = head + run + "GGTC" * 3
    rows = spark.createDataFrame([(1, "c", len(head) + 1 + 450 * len(unit), unit * 2, unit)], "k int, chrom string, pos long, ref string, alt string")
    at = len(head) + 450 * len(unit)
    alleles, n_left, _ = indels.extend_alleles([unit * 2, unit], seq[:at], seq[at + 2 * len(unit) :])
    seqs = chunked(spark.createDataFrame([("c", seq)], "contig string, seq string"))
    got = liftover.extend_rows(rows, seqs).first()
    assert (got.x_pos, got.x_alleles) == (at + 1 - n_left, alleles)
    b = blocks(spark, [(0, 0, "c", 0, len(seq) - 1, 0, "c", len(seq), 0)])
    got = liftover.lift_longer(rows, b, seqs, seqs).first()
    assert (got.q_pos, got.q_alleles, got.swap, got.reject_reason) == (len(head), ["G" + unit, "G"], 0, None)
