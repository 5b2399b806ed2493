import random

import pytest
from pyspark.sql import functions as F

from locusloom.operators import indels, liftover, records
from locusloom.sources import vcf
from locusloom.sources.fasta import chunked
from tests.test_liftover import blocks


def plain(query, target, cut, late):
    """Score, and the target's bases that the first ``cut`` of the query takes, by a table for each state and the path back."""
    both, target_alone, query_alone = range(3)
    n, m, low = len(target), len(query), -(10**8)
    score = [[[low] * (m + 1) for _ in range(n + 1)] for _ in range(3)]
    came = [[[0] * (m + 1) for _ in range(n + 1)] for _ in range(3)]
    best = lambda v: max((target_alone, query_alone, both), key=lambda k: v[k])
    score[both][0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            for k, di, dj in ((both, 1, 1), (target_alone, 1, 0), (query_alone, 0, 1)):
                if i < di or j < dj:
                    continue
                before = [score[h][i - di][j - dj] + (0 if k in (both, h) else indels.OPEN) for h in range(3)]
                h = best(before)
                same = k == both and (target[i - 1] == query[j - 1] or "N" in (target[i - 1], query[j - 1]))
                score[k][i][j] = before[h] + (indels.EXTEND if k != both else indels.MATCH if same else indels.MISMATCH)
                came[k][i][j] = h
    k = best([score[h][n][m] for h in range(3)])
    total, i, j, path = score[k][n][m], n, m, []
    while i or j:
        path.append(k)
        h = came[k][i][j]
        i, j, k = i - (k != query_alone), j - (k != target_alone), h
    path.reverse()
    if late:
        path.reverse()
    asked, taken = (m - cut if late else cut), 0
    for k in path:
        if asked <= 0:
            break
        taken += k != query_alone
        asked -= k != target_alone
    return total, n - taken if late else taken


def texts(rng, n):
    out = []
    for _ in range(n):
        query = [rng.choice("ACG") for _ in range(rng.randint(0, 12))]
        target = list(query)
        for _ in range(rng.randint(0, 5)):
            if target and rng.random() < 0.5:
                del target[rng.randrange(len(target))]
            else:
                target.insert(rng.randint(0, len(target)), rng.choice("ACGN"))
        out.append(("".join(query), "".join(target), rng.randint(0, len(query)), rng.random() < 0.5))
    return out


@pytest.mark.parametrize("cells", [1, 100, 1 << 16])
def test_alignments_against_tables(monkeypatch, cells):
    monkeypatch.setattr(indels, "CELLS", cells)
    rows = texts(random.Random(cells), 250)
    score, taken = indels.align(*zip(*rows, strict=True))
    assert [(int(s), int(t)) for s, t in zip(score, taken, strict=True)] == [plain(*r) for r in rows]


def test_pads_against_tables():
    rng = random.Random(5)
    alleles, pads, targets, left = [], [], [], []
    for _ in range(120):
        alleles.append(["".join(rng.choice("ACGT") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 3))] + (["*"] if rng.random() < 0.2 else []))
        pads.append(rng.choice([None, "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 9)))]))
        targets.append(rng.choice([None, "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 15)))]))
        left.append(rng.random() < 0.5)
    want = []
    for own, pad, target, at_left in zip(alleles, pads, targets, left, strict=True):
        told = [0]
        if pad and target and len(target) > 1:
            whole = [(pad + a if at_left else a + pad)[1:-1] for a in own if a != "*"]
            found = [plain(w, target[1:-1], min(len(pad), len(w)) if at_left else max(len(w) - len(pad), 0), not at_left) for w in whole]
            score, taken = max(found, key=lambda r: r[0])
            told = [taken if at_left else len(target) - 2 - taken]
        want += told
    assert indels.clip_padding(alleles, pads, targets, left) == want and sum(map(bool, want)) > 20


@pytest.mark.parametrize(
    ("alleles", "left", "right", "told"),
    [
        (["CATCAT", "CAT"], "GCAT" * 2, "CATCATG", (["GCATCATCATCATCATG", "GCATCATCATCATG"], 4, 7)),
        (["a", "AC"], "T", "CG", (["aCG", "ACCG"], 0, 2)),
        (["A", "AAA"], "", "AAAAAT", (["AAAAAAT", "AAAAAAAAT"], 0, 6)),
    ],
)
def test_extension_goes_by_whole_periods(alleles, left, right, told):
    assert indels.extend_alleles(alleles, left, right) == told


SCHEMA = "k int, chrom string, pos long, alleles array<string>"


def contig(spark, name, seq):
    return chunked(spark.createDataFrame([(name, seq)], "contig string, seq string"))


def test_several_alternatives(spark):
    src = "GATTACAGGCATTTGCA" + "ACGGTCATCG" * 12
    dst = src[:30] + "T" + src[31:50] + "GG" + src[50:]
    same = [(0, 0, "c", 0, 49, 0, "d", len(dst), 0), (0, 1, "c", 50, len(src) - 1, 52, "d", len(dst), 0)]
    b = blocks(spark, same)
    assert src[30] != "T"
    rows = [
        (1, "c", 10, [src[9], "T", "N"]),  # the reference stays
        (2, "c", 31, [src[30], "A" if src[30] != "A" else "C", "T"]),  # the second alternative becomes it
        (3, "c", 31, [src[30], next(x for x in "ACG" if x != src[30])]),  # a base that no allele has
        (4, "c", 50, [src[49], src[49] + "A", src[49] + "GG"]),  # of insertions the second is the destination's
        (5, None, 5, ["A", "C"]),
        (6, "c", 10_000, ["A", "C"]),
        (7, "c", 20, [src[19], "*"]),
    ]
    got = {r.k: r for r in liftover.lift(spark.createDataFrame(rows, SCHEMA), b, contig(spark, "c", src), contig(spark, "d", dst)).collect()}
    assert (got[1].q_pos, got[1].swap, got[1].q_alleles) == (10, 0, rows[0][3])
    assert (got[2].q_pos, got[2].swap, got[2].q_alleles) == (31, 2, ["T", rows[1][3][1], src[30]])
    assert (got[3].swap, got[3].q_alleles) == (-1, ["T", *rows[2][3]])
    assert (got[4].swap, got[4].n_matches, got[4].reject_reason) == (2, 1, None)
    assert dst.startswith(got[4].q_alleles[0], got[4].q_pos - 1) and dst[: got[4].q_pos - 1] + got[4].q_alleles[2] + dst[got[4].q_pos - 1 + len(got[4].q_alleles[0]) :] == src[:30] + "T" + src[31:]
    assert (got[5].reject_reason, got[6].reject_reason) == ("MissingContig", "UnmappedAnchors")
    assert got[7].q_pos == 20


def test_a_pad_is_aligned_away(spark):
    """The second anchor lies in a gap of the chain: it is found beyond a pad, which is then aligned with the destination."""
    rng = random.Random(3)
    src = "".join(rng.choice("ACGT") for _ in range(400))
    dst = src[:200] + "ACGTTGCA" + src[200:]
    b = blocks(spark, [(0, 0, "c", 0, 149, 0, "d", len(dst), 0), (0, 1, "c", 180, 399, 188, "d", len(dst), 0)])
    ref = src[139:155]  # begins in the first block, ends in the gap
    rows = spark.createDataFrame([(1, "c", 140, [ref, ref[0] + ref[-1]])], SCHEMA)
    got = liftover.lift(rows, b, contig(spark, "c", src), contig(spark, "d", dst)).first()
    assert (got.n_pad5, got.n_pad3 > 0, got.swap, got.reject_reason) == (0, True, 0, None)
    assert got.q_alleles[0] == dst[got.q_pos - 1 : got.q_pos - 1 + len(got.q_alleles[0])] and len(got.q_alleles[0]) - len(got.q_alleles[1]) == len(ref) - 2
    assert liftover.lift(rows, b, None, contig(spark, "d", dst)).first().reject_reason == "MissingFasta"


def test_alleles_that_tie(spark):
    """Without the source two alleles can be the destination's: the first is taken, and their number told."""
    src = dst = "TTACGACGTT" * 3
    b = blocks(spark, [(0, 0, "c", 0, 29, 0, "d", 30, 0)])
    rows = spark.createDataFrame([(1, "c", 3, ["ACG", "TCT"])], SCHEMA)
    got = liftover.lift(rows, b, None, contig(spark, "d", dst), align=False).first()
    assert (got.swap, got.n_matches) == (0, 2) and src[2:5] == "ACG"


HEADER = """##fileformat=VCFv4.2
##INFO=<ID=AC,Number=A,Type=Integer,Description="x">
##INFO=<ID=AN,Number=1,Type=Integer,Description="x">
##INFO=<ID=AF,Number=A,Type=Float,Description="x">
##INFO=<ID=RD,Number=R,Type=Integer,Description="x">
##INFO=<ID=ES,Number=A,Type=Float,Description="x">
##INFO=<ID=OLD,Number=A,Type=Float,Description="x">
##INFO=<ID=END,Number=1,Type=Integer,Description="x">
##INFO=<ID=DB,Number=0,Type=Flag,Description="x">
##FILTER=<ID=low,Description="x">
##FORMAT=<ID=GT,Number=1,Type=String,Description="x">
##FORMAT=<ID=DS,Number=A,Type=Float,Description="x">
##FORMAT=<ID=GP,Number=G,Type=Float,Description="x">
##contig=<ID=c,length=60>
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	s1	s2
"""


def test_from_file_to_file(spark, tmp_path):
    src, dst = "ACGT" * 15, "ACGT" * 5 + "C" + "CGT" + "ACGT" * 9 + "T"
    lines = [
        "c\t21\trs1\tA\tC,G\t30\tlow\tAC=1,2;AN=10;AF=0.25,.;RD=7,1,2;ES=-0.5,3;OLD=1,2;DB;AC=9;END=21\tGT:DS:GP\t0|1:1,0.25:1,2,3,4,5,6\t./2:.:.",
        "c\t22\t.\tC\tT\t.\tPASS\t.\tGT\t1/1\t0",
        "c\t23\t.\tG\tGA\t.\tPASS\tOLD=1\tGT\t0/1\t1|0",
        "x\t9\t.\tG\tA\t.\t.\tDB\tGT\t0/1\t1|0",
    ]
    (tmp_path / "in.vcf").write_text(HEADER + "\n".join(lines) + "\n")
    path = f"file://{tmp_path}/in.vcf"
    numbers = vcf.numbers(spark, path)
    assert numbers["INFO"]["RD"] == "R" and numbers["FORMAT"] == {"GT": "1", "DS": "A", "GP": "G"}
    b = blocks(spark, [(0, 0, "c", 0, 59, 0, "d", 61, 0)])
    lifted = records.lift_records(vcf.read_genotypes(spark, path, phase=True), b, contig(spark, "c", src), contig(spark, "d", dst), numbers["INFO"], numbers["FORMAT"], {"DROP": ("OLD",)}, write_src=True)
    kept = lifted.where("reject_reason is null")
    vcf.write_records(kept, f"file://{tmp_path}/out", vcf.header(spark, path), vcf.samples_of(spark, path), {"d": 61})
    out = [r.value for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    head, body = [x for x in out if x.startswith("#")], [x.split("\t") for x in out if not x.startswith("#")]
    assert head[0] == "##fileformat=VCFv4.2" and "##contig=<ID=d,length=61>" in head and not any("ID=c," in h for h in head) and sum(h.startswith("##INFO=<ID=SWAP,") for h in head) == 1
    assert [r[:7] for r in body] == [["d", "21", "rs1", "C", "A,G", "30.0", "low"], ["d", "22", ".", "C", "T", ".", "PASS"], ["d", "23", ".", "G", "GA", ".", "PASS"]]
    info = dict(x.partition("=")[::2] for x in body[0][7].split(";"))
    assert info == {"AC": "7,2", "AN": "10", "AF": ".,.", "RD": "1,7,2", "ES": "0.5,3", "DB": "", "END": "21", "SWAP": "1", "SRC_CHROM": "c", "SRC_POS": "21", "SRC_REF_ALT": "A,C,G"}
    assert body[0][8:] == ["GT:DS:GP", "1|0:0.75,0.25:3.0,2.0,1.0,5.0,4.0,6.0", "./2:.:."]
    assert body[1][7:] == ["SRC_CHROM=c;SRC_POS=22;SRC_REF_ALT=C,T", "GT:DS:GP", "1/1:.:.", "0:.:."] and body[2][7].startswith("OLD=1;")
    again = vcf.read_genotypes(spark, f"file://{tmp_path}/out", phase=True).orderBy("pos").collect()
    want = kept.orderBy("pos").collect()
    assert [(r.chrom, r.pos, r.alleles, r.filters, r.samples) for r in again] == [(r.chrom, r.pos, r.alleles, r.filters, r.samples) for r in want]
    gone = records.rejects(lifted).collect()
    assert [(r.chrom, r.pos, r.alleles, r.filters, r["info"]) for r in gone] == [("x", 9, ["G", "A"], ["UnmappedAnchors"], {"DB": ""})]


def test_a_new_reference_and_ends(spark):
    rows = spark.createDataFrame([("c", 3, ["A", "G"], {"AC": "3", "AN": "10", "G": "1,2,3", "END": "8", "X": "y"}), ("c", 3, ["A", "<DEL>"], {"END": "8", "AC": "."})], "chrom string, pos long, alleles array<string>, info map<string,string>")
    b = blocks(spark, [(0, 0, "c", 0, 19, 0, "d", 20, 1)])
    dst = contig(spark, "d", "CATG" * 5)
    for lift_end in (False, True):
        one, other = records.lift_records(rows, b, None, dst, {"AC": "A", "AN": "1", "G": "G"}, {}, lift_end=lift_end).orderBy(F.size("info").desc()).collect()
        assert (one.chrom, one.pos, one.alleles, one.swap, one.flip) == ("d", 18, ["A", "T", "C"], -1, True)
        assert one["info"] == {"AC": "7,3", "AN": "10", "G": ".,.,1,.,2,3", "X": "y", "END": "13" if lift_end else "18", "FLIP": "", "SWAP": "-1"}
        assert other["info"] == {"AC": ".", "END": "13" if lift_end else "23", "FLIP": ""} and other.swap is None
    with pytest.raises(Exception, match="not as many values"):
        records.lift_records(rows.withColumn("info", F.create_map(F.lit("G"), F.lit("1,2"))), b, None, dst, {"G": "G"}, {}, strict=True).collect()


def test_associations_with_several_alternatives(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\ty\n"
    (tmp_path / "a.vcf").write_text(head + "c\t1\t.\tA\tC,G\t.\t.\tK=1;K=2\tES:SE:NS:ED\t0.1,0.2:0.3,.:50:+,-\t.:.\nc\t2\t.\tA\t.\t.\t.\t.\tES\t1\t2\n")
    rows = [(r.pos, r.alt, r.study, r.es, r.se, r.ns, r.ed) for r in vcf.read_associations(spark, f"file://{tmp_path}/a.vcf").collect()]
    assert sorted(rows, key=str) == sorted(
        [(1, "C", "x", 0.1, 0.3, 50.0, "+"), (1, "G", "x", 0.2, None, 50.0, "-"), (1, "C", "y", None, None, None, None), (1, "G", "y", None, None, None, None), (2, ".", "x", 1.0, None, None, None), (2, ".", "y", 2.0, None, None, None)], key=str
    )
    assert vcf.read_records(spark, f"file://{tmp_path}/a.vcf").where("pos = 1").first()["info"] == {"K": "1"}
    (tmp_path / "b.vcf").write_text(head + "c\t1\t.\tA\tC,G,T\t.\t.\t.\tES\t0.1,0.2\t.\n")
    with pytest.raises(Exception, match="ES: not as many values"):
        vcf.read_associations(spark, f"file://{tmp_path}/b.vcf").collect()
