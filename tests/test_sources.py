import pytest
from pyspark.sql import functions as F

from locusloom.functions import alleles, swap
from locusloom.operators import filters, ld, manhattan, score, tables
from locusloom.operators.munge import munge
from locusloom.sources import chain, fasta, text, vcf


def write(path, content):
    path.write_text(content)
    return str(path)


def test_summary_text(spark, tmp_path):
    path = write(tmp_path / "a.txt", "# a comment\n#CHROM POS SNP A1 A2 FRQ_U_35191 OR P -\n# more\n23 100 rs1 1 2 .5 2.0 3.2e-400 x\n1 200 NA D g NA 1.0 0\nZ 1 rs 1 2 .1 1 1\n")
    raw = text.read_summary(spark, path)
    assert raw.columns == ["CHROM", "POS", "SNP", "A1", "A2", "FRQ_U", "OR", "P"]
    codes = {"chrom": "CHR", "pos": "BP", "snp": "SNP", "a1": "A1", "a2": "A2", "frq_u": "FRQ", "or": "OR", "p": "P"}
    a, b = munge(raw, codes, ["chr1", "chrX"]).orderBy("pos").collect()
    assert (a.chrom, a.pos, a.id, a.ref, a.alt, a.af) == ("chrX", 100, "rs1", "C", "A", 0.5)
    assert a.lp == pytest.approx(399.494850, abs=1e-6) and a.es == pytest.approx(0.693147, abs=1e-6)
    assert (b.chrom, b.id, b.alt, b.ref, b.af, b.lp) == ("chr1", None, "<D>", "G", None, float("inf"))


@pytest.mark.parametrize("head,names", [("A\tB C\tD", ["A", "B C", "D"]), ("A,B,C", ["A", "B", "C"]), ("A  B C", ["A", "B", "C"])])
def test_delimiters(head, names):
    assert text.header_fields(head)[0] == names


def test_synonyms(tmp_path):
    assert text.synonyms("plink2")["log10_p"] == "LP" and text.synonyms("GWAS-SSF") == text.synonyms("SSF")
    path = write(tmp_path / "s", "Chrom\tCHR\nOdd\tNOTHING\n")
    assert text.synonyms(path=path) == {"chrom": "CHR"}
    with pytest.raises(ValueError):
        text.synonyms(path=write(tmp_path / "t", "no tab here\n"))
    with pytest.raises(ValueError):
        text.synonyms("unknown")


def test_lists(spark, tmp_path):
    assert text.listed(spark, write(tmp_path / "l", "b.tsv\n\na.tsv\n")) == ["b.tsv", "a.tsv"]
    assert text.sample_choice("^s1,s2") == (["s1", "s2"], True) and text.sample_choice("s1") == (["s1"], False)


def test_reference_fetch(spark, tmp_path):
    path = write(tmp_path / "f.fa", ">c1 text\nACGTR\nacgta\n>c2\nTTTT\n")
    seqs = fasta.read_fasta(spark, path, chunk=4, overlap=3)
    rows = spark.createDataFrame([(1, "c1", 4, 4), (2, "c1", 8, 4), (3, "c2", 1, 4), (4, "c9", 1, 1), (5, "c1", 5, 2)], "k int, chrom string, pos long, n int")
    got = {r.k: r.s for r in fasta.with_reference(rows, seqs, F.col("pos"), F.col("n"), "s", chunk=4).collect()}
    assert got == {1: "TNAC", 2: None, 3: "TTTT", 4: None, 5: "NA"}


def test_harmonised_rows(spark):
    seqs = fasta.chunked(spark.createDataFrame([("chr1", "ACGTTTT")], "contig string, seq string"))
    raw = spark.createDataFrame([("1", "1", "a", "A", "C"), ("1", "2", "b", "A", "C"), ("1", "3", "c", "A", "C"), ("1", "4", "d", "T", "TT")], "CHR string, BP string, SNP string, A1 string, A2 string").withColumn("BETA", F.lit("0.1")).withColumn("FRQ", F.lit("0.3")).withColumn("AC", F.lit("30")).withColumn("N", F.lit("50")).withColumn("DIRE", F.lit("+-?"))
    got = {r.id: r for r in munge(raw, {c.lower(): c for c in raw.columns}, ["chr1"], seqs).collect()}
    a = got["a"]
    assert (a.ref, a.alt, a.es, a.af, a.ac, a.ed, a.filters) == ("A", "C", -0.1, 0.7, 70, "-+?", [])
    assert (got["b"].ref, got["b"].alt, got["b"].es) == ("C", "A", 0.1)
    assert got["c"].filters == ["REF_MISMATCH"] and got["d"].filters == ["IFFY"]


def test_contigs(spark):
    get = lambda raw, known: spark.range(1).select(alleles.resolve_contig(F.lit(raw), known)).first()[0]
    assert [get("23", ["chrX"]), get("chr1", ["1"]), get("MT", ["chrM"]), get("1", ["chr1"]), get("PAR1", ["X"]), get("26", ["MT"]), get("7", ["1"])] == ["chrX", "1", "chrM", "chr1", "X", "MT", None]


def test_strand(spark):
    get = lambda a: spark.range(1).select(alleles.strand_flip(F.lit(a))).first()[0]
    assert [get("ACg"), get("<DEL>"), get("*"), get("N[chr"), get("R")] == ["cGT", "<DEL>", "*", get("N[chr"), "Y"]


def test_chain_file(spark, tmp_path):
    path = write(tmp_path / "c.chain", "chain 100 chr1 1000 + 10 200 chrA 2000 + 50 240 7\n50 1 1\n30 20 10\n40 0 20\n20\n\nchain 90 chr1 1000 + 300 310 chrB 1000 - 5 15 7\n10\n\nchain 80 chr2 500 + 0 9 chrB 1000 - 100 109 0\n9\n")
    chains, blocks = chain.read_chains(spark, path)
    assert chains.count() == 3 and chain.first_chains(chains).count() == 2
    got = [(r.chain_ind, r.t_start, r.q_start, r.size, r.t_start_gap, r.t_end_gap, r.q_start_gap, r.q_end_gap) for r in blocks.orderBy("chain_ind", "t_start").collect()]
    assert got[:3] == [(0, 0, 0, 81, -1, 20, -1, 10), (0, 101, 91, 40, 20, 0, 10, 20), (0, 141, 151, 20, 0, -1, 20, -1)]
    placed = chain.placed_blocks(chains, blocks).orderBy("chain_ind", "b_start").collect()
    assert [(r.b_chrom, r.b_start, r.b_end, r.b_q, r.q_strand) for r in placed] == [("chr1", 10, 90, 50, 0), ("chr1", 111, 150, 141, 0), ("chr1", 151, 170, 201, 0), ("chr2", 0, 8, 100, 1)]


def test_vcf_round_trip(spark, tmp_path):
    schema = "chrom string, pos long, id string, ref string, alt string, filters array<string>, study string, es double, se double, ed string"
    rows = [("chr2", 5, "rs1", "A", "C", ["X"], "s1", 0.5, 0.25, "+-"), ("chr2", 5, "rs1", "A", "C", [], "s2", None, 0.125, None), ("chr1", 9, None, "G", "T", [], "s2", 1.5, None, "?")]
    path = f"{tmp_path}/v"
    vcf.write_vcf(spark.createDataFrame(rows, schema), path, ["s1", "s2"], ["es", "se", "ed"], {"chr1": 10, "chr2": 10})
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0] == "##fileformat=VCFv4.2" and vcf.samples_of(spark, path) == ["s1", "s2"]
    got = {(r.chrom, r.study): r for r in vcf.read_associations(spark, path).collect()}
    assert len(got) == 4 and got["chr2", "s1"].es == 0.5 and got["chr2", "s2"].es is None and got["chr2", "s2"].filters == ["X"] and got["chr1", "s2"].ed == "?" and got["chr1", "s1"].es is None and got["chr1", "s2"].id is None


def test_swap_twice_is_nothing(spark):
    df = spark.createDataFrame([([3, 4], [1.0, 2.0, 3.0], [1, 2, 3, 4, 5, 6], [0.2, 0.3], s) for s in (0, 1, 2)], "gt array<int>, r array<double>, g array<int>, af array<double>, s int")
    s = F.col("s")
    again = df
    for _ in range(2):
        again = again.withColumn("r", swap.per_allele(F.col("r"), s)).withColumn("g", swap.per_genotype(F.col("g"), F.lit(3), s)).withColumn("gt", swap.allele_codes(F.col("gt"), s)).withColumn("af", swap.complement(F.col("af"), s, F.lit(1.0)))
    for a, b in zip(df.orderBy("s").collect(), again.orderBy("s").collect(), strict=True):
        assert (a.r, a.g, a.gt) == (b.r, b.g, b.gt) and b.af == pytest.approx(a.af)


def test_rules():
    tags = {"AC": "A", "ES": "A", "XX": "G", "YY": "1"}
    assert swap.assign_rules(tags) == {"AC": "AC", "ES": "ES", "XX": "AGR"}
    assert swap.assign_rules(tags, {"DROP": ("YY", "AC")})["AC"] == "DROP"


def test_names_and_numbers(spark):
    assert score.display_name("/a/b/x.tsv.gz") == "x" and score.c_general(1.5) == "1.50000" and score.c_general(123456789.0) == "1.23457e+08"
    assert score.choose_field(["sample", "gt", "ap1", "ap2"]) == "AP" and score.choose_field(["gt", "ds", "gp"]) == "DS"
    with pytest.raises(ValueError):
        filters.select_samples(spark.createDataFrame([("a",)], "sample string"), ["b"], known=["a"])


def test_score_matrix_file(spark, tmp_path):
    df = spark.createDataFrame([("s2", 1.0, None), ("s1", 0.5, 1e-9)], "sample string, p double, q double")
    score.write_matrix(df, f"{tmp_path}/m")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/m").collect()]
    assert lines == ["SAMPLE\tp\tq", "s1\t0.500000\t1.00000e-09", "s2\t1.00000\tnan"]


def test_plot_contigs(spark):
    rows = spark.createDataFrame([("chrX", 1, 20.0, "missense&x"), ("chr2", 5, 3.0, None)], "chrom string, pos long, lp double, consequence string")
    lengths = spark.createDataFrame([("1", 100), ("2", 50), ("X", 10)], "chrom string, length long")
    got = {r.chrom: r for r in manhattan.plot_rows(rows, lengths, spacing=0).collect()}
    assert got["chr2"].x == 105 and got["chrX"].x == 151 and got["chrX"].coding and got["chrX"].height == pytest.approx(13.0103, abs=1e-4)


def test_exchange_and_order(spark):
    rows = spark.createDataFrame([("chrX", 2, "A", "C", None, 0.5, 3.0), ("chrM", 1, "A", "C", 0.1, 0.5, 2.0)], "chrom string, pos long, ref string, alt string, es double, se double, lp double")
    got = [tuple(r) for r in tables.exchange_format(tables.in_order(rows, ["chrX", "chrM"])).collect()]
    assert got[0][:7] == ("23", 2, "C", "A", "NA", "0.5", "NA") and got[1][0] == "25" and float(got[0][7]) == pytest.approx(1e-3)
    told = tables.exchange_format(rows.withColumn("af", F.lit(0.25))).collect()
    assert {r.effect_allele_frequency for r in told} == {"0.25"}


GENOTYPES = """##fileformat=VCFv4.2
##INFO=<ID=AF,Number=A,Type=Float,Description="f">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
##FORMAT=<ID=DS,Number=A,Type=Float,Description="d">
##FORMAT=<ID=GP,Number=G,Type=Float,Description="p">
##FORMAT=<ID=AS,Number=1,Type=Integer,Description="a">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
c\t5\trs1\tA\tC\t.\tPASS\tAF=0.5;DB\tGT:DS:GP:AS\t0|1:1.2:0,1,0:-1\t./.:.:.:.
c\t9\t.\tAT\tA,<DEL>\t3\tq1;q2\t.\tGT:DS\t2/1:0.5,1\t0:.,.
"""


def test_genotypes(spark, tmp_path):
    (tmp_path / "g.vcf").write_text(GENOTYPES)
    one, two = vcf.read_genotypes(spark, f"file://{tmp_path}/g.vcf").orderBy("pos").collect()
    assert one.alleles == ["A", "C"] and one.id == "rs1" and one.filters == [] and one["info"] == {"AF": "0.5", "DB": ""}
    assert [s.asDict() for s in one.samples] == [
        {"sample": "s1", "gt": [0, 1], "ds": [1.2], "gp": [0.0, 1.0, 0.0], "as_": -1},
        {"sample": "s2", "gt": [None, None], "ds": None, "gp": None, "as_": None},
    ]
    assert two.alleles == ["AT", "A", "<DEL>"] and two.id is None and two.filters == ["q1", "q2"]
    assert [(s.gt, s.ds, s.gp) for s in two.samples] == [([2, 1], [0.5, 1.0], None), ([0], [None, None], None)]


def test_scores_from_files(spark, tmp_path):
    """Genotypes and associations, both read from text, down to scores."""
    (tmp_path / "g.vcf").write_text(GENOTYPES)
    rows = [("c", 5, "A", "C", "x", 2.0, 3.0, ["HIGH"]), ("c", 9, "AT", "A", "x", 1.0, None, [])]
    schema = "chrom string, pos long, ref string, alt string, study string, es double, lp double, filters array<string>"
    stats = spark.createDataFrame(rows, schema).withColumn("id", F.lit(None).cast("string"))
    vcf.write_vcf(stats, f"file://{tmp_path}/a", ["x"], ["es", "lp"], {"c": 10})
    vcf.check_associations(spark, f"file://{tmp_path}/a", sizes_given=True)
    with pytest.raises(ValueError):
        vcf.check_associations(spark, f"file://{tmp_path}/a")
    markers = vcf.read_associations(spark, f"file://{tmp_path}/a").withColumnRenamed("study", "prs")
    genotypes = vcf.read_genotypes(spark, f"file://{tmp_path}/g.vcf")
    got = score.score(genotypes, markers, "DS", association=True, counts=True).collect()
    assert [(r["sample"], r.score, r.n) for r in got] == [("s1", 2.4, 1)]  # the second record has another alternative too
    assert [r.score for r in score.score(genotypes, markers, "DS", (0.01, 1e-9), association=True).collect()] == [2.4]


def test_ld_table(spark, tmp_path):
    names = "".join(f"##INFO=<ID={k},Number=1,Type=Float,Description=\"x\">\n" for k in vcf.LD_FIELDS)
    body = "c\t5\t.\tA\tC\t.\t.\tAA=1;AF=0.25;LD_block=3;LD_node=0;LD_diagonal=1.5;LD_neighbors=1,4;LD_weights=-0.5,0.25\nc\t6\t.\tA\tG\t.\t.\tAA=0;AF=0.5;LD_block=3;LD_node=1;LD_diagonal=0.5\n"
    (tmp_path / "l.vcf").write_text(f"##fileformat=VCFv4.2\n{names}#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n{body}")
    good, bad = ld.checked(vcf.read_ld(spark, f"file://{tmp_path}/l.vcf", "EUR"))
    assert tuple(good.first()) == ("EUR", "c", 5, "A", "C", 1, 0.25, 3, 0, 1.5, [1, 4], [-0.5, 0.25])
    assert [(r.pos, r.ld_neighbors) for r in bad.collect()] == [(6, [])]
    (tmp_path / "m.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n")
    with pytest.raises(ValueError, match="LD_weights"):
        vcf.read_ld(spark, f"file://{tmp_path}/m.vcf", "EUR")


def test_wrong_lengths_are_told(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "s int, X array<double>")
    two = F.lit(3)
    assert [r.X for r in swap.with_swapped(df.where("s = 0"), {"X": "A"}, F.col("s"), two, strict=True).collect()] == [[1.0]]
    with pytest.raises(Exception, match="not as many values"):
        swap.with_swapped(df, {"X": "A"}, F.col("s"), two, strict=True).collect()
    dropped = swap.with_swapped(df, {"X": "A"}, F.col("s"), two, {"DROP": ("X",)}, strict=True)
    assert [r.X for r in dropped.orderBy("s").collect()] == [[1.0], None]


def test_numbers_of_tags_are_mended(spark):
    df = spark.createDataFrame([(3, 0.5, [0.1, 0.2, 0.7]), (None, 0.25, None)], "AC int, DS double, GP array<double>")
    out, tags = swap.fix_numbers(df, {"AC": "1", "DS": "A", "GP": "3", "NS": "1"})
    assert tags == {"AC": "A", "DS": "A", "GP": "G", "NS": "1"}
    assert [(r.AC, r.DS) for r in out.collect()] == [([3], 0.5), (None, 0.25)]


def test_strict_numbers(spark):
    codes = {"chr": "CHR", "bp": "BP", "a1": "A1", "a2": "A2", "beta": "BETA"}
    rows = lambda *r: spark.createDataFrame([("1", p, "A", "C", b) for p, b in r], "CHR string, BP string, A1 string, A2 string, BETA string")
    fine = munge(rows(("5", ".5"), ("6", "NAN?"), ("7", "."), ("8", None)), codes, ["1"], strict=True)
    assert [r.es for r in fine.orderBy("pos").collect()] == [0.5, None, None, None]
    assert [r.es for r in munge(rows(("5", "junk")), codes, ["1"]).collect()] == [None]
    for bad in (("5", "junk"), ("5.5", "1")):
        with pytest.raises(Exception, match="not a"):
            munge(rows(bad), codes, ["1"], strict=True).collect()


def test_files_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(f"chr{k % 3}", (k * 37) % 101, "A", "C") for k in range(60)], "chrom string, pos int, ref string, alt string")
    tables.write_in_order(rows, f"{tmp_path}/sorted")
    back = spark.read.parquet(f"{tmp_path}/sorted")
    assert sorted(map(tuple, back.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    held = back.withColumn("f", F.input_file_name()).select("f", "pos").collect()
    assert all(a.pos <= b.pos for a, b in zip(held, held[1:], strict=False) if a.f == b.f)
