"""Consequences against a plain walk along each transcript, base by base."""

import random

import pytest
from pyspark.sql import functions as F

from locusloom.operators import consequence
from locusloom.sources import fasta, gff

PAIR = dict(zip("ACGT", "TGCA", strict=True))
BASES = "TCAG"
SEGMENTS = "transcript string, gene string, biotype string, chrom string, strand string, kind string, start long, end long, phase int"
VARIANTS = "chrom string, pos long, ref string, alt string"


def translate(seq, code):
    acids = []
    for k in range(0, len(seq) - len(seq) % 3, 3):
        codon = seq[k : k + 3]
        acids.append("X" if set(codon) - set("ACGT") else code[16 * BASES.index(codon[0]) + 4 * BASES.index(codon[1]) + BASES.index(codon[2])])
    return "".join(acids)


def plain(genome, model, pos, ref, alt):
    """(consequence, amino acids) of one variant on one transcript, or None."""
    ref, alt = ref.upper(), alt.upper()
    while ref and alt and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    while ref and alt and ref[0] == alt[0]:
        ref, alt, pos = ref[1:], alt[1:], pos + 1
    gone = set(range(pos, pos + len(ref)))

    def meets(a, b):
        return bool(gone & set(range(a, b + 1))) if ref else (a <= pos - 1 and pos <= b)

    exons, cds, strand, phase, chrom = model["exons"], model["cds"], model["strand"], model["phase"], model["chrom"]
    if not meets(exons[0][0], exons[-1][1]):
        return None
    terms, sites, near = set(), set(), False
    for k, (a, b) in enumerate(exons):
        if k and meets(a - 2, a - 1):
            sites.add("splice_acceptor" if strand == "+" else "splice_donor")
        if k + 1 < len(exons) and meets(b + 1, b + 2):
            sites.add("splice_donor" if strand == "+" else "splice_acceptor")
        near |= (k > 0 and meets(a - 8, a + 2)) or (k + 1 < len(exons) and meets(b - 2, b + 8))
        if ref and gone >= set(range(a, b + 1)):
            terms.add("exon_loss")
    terms |= sites
    if near and not sites:
        terms.add("splice_region")
    acids = None
    order = [p for a, b in cds for p in range(a, b + 1)]
    order = order if strand == "+" else order[::-1]
    within = [s for s in cds if meets(*s)]
    if within:
        whole = ref and any(set(range(a, b + 1)) >= gone for a, b in cds) or not ref
        old = "".join(genome[p - 1] if strand == "+" else PAIR.get(genome[p - 1], "N") for p in order)[phase:]
        new = alt if strand == "+" else "".join(PAIR.get(x, "N") for x in reversed(alt))
        place = None
        if whole:
            first = min(order.index(p) for p in gone) if ref else order.index(pos if strand == "+" else pos - 1)
            c = first - phase
            if c >= 0:
                k0, k1 = c // 3, (c + max(len(ref), 1) - 1) // 3
                p = old[3 * k0 : 3 * k1 + 3]
                q = p[: c - 3 * k0] + new + p[c - 3 * k0 + len(ref) :]
                code = consequence.MITOCHONDRIAL if chrom == "chrM" else consequence.STANDARD
                size = len(alt) - len(ref)
                by_size = "inframe_insertion" if size > 0 else "inframe_deletion" if size < 0 else None
                if size % 3:
                    place = "frameshift"
                elif len(p) < 3 * (k1 - k0 + 1):
                    place = by_size or "coding_sequence"
                else:
                    p, q = translate(p, code), translate(q, code)
                    acids = f"{k0 + 1}{p}" if p == q else f"{k0 + 1}{p}>{k0 + 1}{q}"
                    if "*" in q and "*" not in p:
                        place = "stop_gained"
                    elif "*" in p and "*" not in q:
                        place = "stop_lost"
                    elif k0 == 0 and p[0] == "M" and q[:1] != "M":
                        place = "start_lost"
                    elif p == q:
                        place = "stop_retained" if "*" in p else "synonymous"
                    else:
                        place = by_size or "missense"
        terms.add(place or "coding_sequence")
    elif any(meets(*e) for e in exons):
        if not cds:
            terms.add("non_coding")
        else:
            before = pos + len(ref) - 1 < cds[0][0] if strand == "+" else pos > cds[-1][1]
            terms.add("5_prime_utr" if before else "3_prime_utr")
    else:
        terms.add("intron")
    return "&".join(sorted(terms, key=consequence.SEVERITY.index)), acids


def models(rng, genomes):
    out = {}
    for k in range(60):
        chrom = rng.choice(sorted(genomes))
        at, exons = rng.randrange(20, 3000), []
        for _ in range(rng.randrange(1, 6)):
            size = rng.choice([1, 2, 5, 30, 80, 1500 if k % 10 == 0 else 40])
            exons.append((at, at + size - 1))
            at += size + rng.randrange(4, 60)
        strand, cds = rng.choice("+-"), []
        if k % 6:
            low, high = rng.randrange(exons[0][0], exons[0][1] + 1), rng.randrange(exons[-1][0], exons[-1][1] + 1)
            cds = [(max(a, low), min(b, high)) for a, b in exons if max(a, low) <= min(b, high)]
        first = (cds[0] if strand == "+" else cds[-1]) if cds else (0, 9)
        phase = rng.randrange(0, min(3, first[1] - first[0] + 2))
        out[f"t{k}"] = {"chrom": chrom, "strand": strand, "exons": exons, "cds": cds, "phase": phase if cds else 0}
    return out


def segments_of(found):
    rows = []
    for name, m in found.items():
        rows += [(name, "g" + name, "any", m["chrom"], m["strand"], "exon", a, b, 0) for a, b in m["exons"]]
        rows += [(name, "g" + name, "any", m["chrom"], m["strand"], "CDS", a, b, m["phase"] if (a, b) == (m["cds"][0] if m["strand"] == "+" else m["cds"][-1]) else 0) for a, b in m["cds"]]
    return rows


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(5)
    genomes = {c: "".join(rng.choice("ACGT") for _ in range(12000)) for c in ("chr1", "chr2", "chrM")}
    genomes["chr2"] = genomes["chr2"][:700] + "N" + genomes["chr2"][701:]
    found = models(rng, genomes)
    variants = set()
    for m in found.values():
        edges = [x for e in m["exons"] + m["cds"] for x in e]
        for _ in range(60):
            pos = max(2, rng.choice(edges) + rng.randrange(-12, 13) if rng.random() < 0.6 else rng.randrange(m["exons"][0][0], m["exons"][-1][1] + 1))
            size = rng.choice([1, 1, 1, 2, 3, 4, 7, 40])
            ref = genomes[m["chrom"]][pos - 1 : pos - 1 + size]
            alt = rng.choice([ref[0], ref[0] + "".join(rng.choice("ACGT") for _ in range(rng.choice([1, 3, 6]))), "".join(rng.choice("ACGT") for _ in ref)])
            if ref != alt:
                variants.add((m["chrom"], pos, ref, alt))
    reference = fasta.chunked(spark.createDataFrame(sorted(genomes.items()), "contig string, seq string"))
    return genomes, found, sorted(variants), reference, spark.createDataFrame(segments_of(found), SEGMENTS)


def test_against_a_plain_walk(spark, made):
    genomes, found, variants, reference, segments = made
    got = consequence.consequences(spark.createDataFrame(variants, VARIANTS), segments, reference).collect()
    told = {(r.chrom, r.pos, r.ref, r.alt, r.transcript): (r.consequence, r.amino_acids) for r in got}
    assert len(told) == len(got)
    expected = {}
    for v in variants:
        for name, m in found.items():
            if m["chrom"] == v[0] and (what := plain(genomes[v[0]], m, *v[1:])) is not None:
                expected[(*v, name)] = what
    wrong = [(k, told.get(k), expected.get(k)) for k in sorted(told.keys() | expected.keys()) if told.get(k) != expected.get(k)]
    assert not wrong, (len(wrong), len(expected), wrong[:5])
    kinds = {t for c, _ in expected.values() for t in c.split("&")}
    assert kinds == set(consequence.SEVERITY)


def test_the_most_severe_is_told(spark, made):
    _, _, variants, reference, segments = made
    rows = spark.createDataFrame(variants, VARIANTS)
    every = consequence.consequences(rows, segments, reference).collect()
    best = {}
    for r in every:
        key = (r.chrom, r.pos, r.ref, r.alt)
        best[key] = min(best.get(key, (99, "")), (consequence.SEVERITY.index(r.consequence.split("&")[0]), r.transcript))
    out = consequence.annotate(rows.withColumn("gene", F.lit(1)).unionByName(rows.withColumn("gene", F.lit(2))), segments, reference).collect()
    assert len(out) == 2 * len(variants)
    for r in out:
        assert r.transcript == best.get((r.chrom, r.pos, r.ref, r.alt), (0, None))[1]


def test_alleles_that_have_none(spark, made):
    _, _, _, reference, segments = made
    rows = [("chr1", 50, None, "A"), (None, 50, "A", "C"), ("chr1", None, "A", "C"), ("chr1", 50, "A", "<DEL>"), ("chr1", 50, "A", "*"), ("chr1", 50, "A", "a"), ("chr9", 50, "A", "C"), ("chr1", 50, "", "C")]
    df = spark.createDataFrame(rows, VARIANTS)
    assert consequence.consequences(df, segments, reference).count() == 0
    assert [r.consequence for r in consequence.annotate(df, segments, reference).collect()] == [None] * len(rows)
    assert consequence.consequences(df.limit(0), segments, reference).count() == 0
    assert consequence.consequences(df, segments.limit(0), reference).count() == 0


GFF = """##gff-version 3
##sequence-region   1 1 5000
chr1\tsrc\tchromosome\t1\t5000\t.\t.\t.\tID=chromosome:1
chr1\tsrc\tgene\t100\t400\t.\t+\t.\tID=gene:G1;Name=ABC;biotype=protein_coding
chr1\tsrc\tmRNA\t100\t400\t.\t+\t.\tID=transcript:T1;Parent=gene:G1;Name=ABC-1;biotype=protein_coding
chr1\tsrc\tmRNA\t100\t400\t.\t+\t.\tID=transcript:T2;Parent=gene:G1;biotype=nonsense
###
chr1\tsrc\texon\t100\t200\t.\t+\t.\tParent=transcript:T1,transcript:T2;Name=E1
chr1\tsrc\texon\t300\t400\t.\t+\t.\tParent=transcript:T1
chr1\tsrc\tCDS\t150\t200\t.\t+\t0\tID=CDS:P1;Parent=transcript:T1
chr1\tsrc\tCDS\t300\t330\t.\t+\t2\tID=CDS:P1;Parent=transcript:T1
chr1\tsrc\tgene\t900\t950\t.\t-\t.\tID=gene:G2;biotype=lncRNA
chr1\tsrc\tlnc_RNA\t900\t950\t.\t-\t.\tID=transcript:T3;Parent=gene:G2;biotype=lncRNA
chr1\tsrc\texon\t900\t950\t.\t-\t.\tParent=transcript:T3

chr1\tsrc\texon\t990\t999\t.\t-\t.\tParent=transcript:T4
"""


def test_gene_models(spark, tmp_path):
    (tmp_path / "a.gff3").write_text(GFF)
    rows = sorted(tuple(r) for r in gff.read_gff(spark, str(tmp_path / "a.gff3")).fillna("-").collect())
    assert rows == [
        ("T1", "ABC", "protein_coding", "chr1", "+", "CDS", 150, 200, 0),
        ("T1", "ABC", "protein_coding", "chr1", "+", "CDS", 300, 330, 2),
        ("T1", "ABC", "protein_coding", "chr1", "+", "exon", 100, 200, 0),
        ("T1", "ABC", "protein_coding", "chr1", "+", "exon", 300, 400, 0),
        ("T2", "ABC", "nonsense", "chr1", "+", "exon", 100, 200, 0),
        ("T3", "G2", "lncRNA", "chr1", "-", "exon", 900, 950, 0),
        ("T4", "-", "-", "chr1", "-", "exon", 990, 999, 0),
    ]
