import random

import pytest

from locusloom.operators import tables
from locusloom.operators.intervals import in_regions
from locusloom.sources import chain, fasta


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of some kilobytes."""
    names = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_fasta_in_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    seqs = {f"c{k}": "".join(rng.choice("ACGTNacgtR") for _ in range(n)) for k, n in enumerate([0, 1, 59, 60, 61, 30_000, 7, 12_345])}
    with open(tmp_path / "x.fa", "w") as f:
        for name, seq in seqs.items():
            f.write(f">{name} some text\n" + "".join(seq[i : i + 60] + "\n" for i in range(0, len(seq), 60)) + ("\n" if name == "c3" else ""))
    path = f"file://{tmp_path}/x.fa"
    assert spark.read.text(path).rdd.getNumPartitions() > 5
    clean = {k: "".join(b if b in "ACGT" else "N" for b in s.upper()) for k, s in seqs.items()}
    for chunk, overlap in ((1000, 100), (64, 64), (100_000, 10)):
        got = {(r.contig, r.chunk): r.seq for r in fasta.read_fasta(spark, path, chunk, overlap).collect()}
        assert got == {(k, i // chunk): s[i : i + chunk + overlap] for k, s in clean.items() for i in range(0, len(s), chunk)}


def chains(n=40, seed=2):
    rng = random.Random(seed)
    out, text = [], ["# a comment"]
    for k in range(n):
        sizes = [(rng.randint(1, 90), rng.randint(0, 5), rng.randint(0, 5)) for _ in range(rng.randint(0, 120))] + [(rng.randint(1, 50), 0, 0)]
        t, q = sum(s + d for s, d, _ in sizes), sum(s + d for s, _, d in sizes)
        t0, q0 = rng.randint(0, 1000), rng.randint(0, 1000)
        text.append(f"chain {1000 - k} chr{k % 3} 200000 + {t0} {t0 + t} q{k % 3} 200000 {'+-'[k % 2]} {q0} {q0 + q} {k + 1}")
        text += [f"{s}\t{d}\t{e}" for s, d, e in sizes[:-1]] + [str(sizes[-1][0]), ""]
        at, to = 0, 0
        for s, d, e in sizes:
            out.append((k, at, to, s))
            at, to = at + s + d, to + s + e
    return out, text


def test_chains_in_splits(spark, tmp_path, small_splits):
    want, text = chains()
    (tmp_path / "x.chain").write_text("\n".join(text))
    heads, blocks = chain.read_chains(spark, f"file://{tmp_path}/x.chain", max_gap=-1, strict=True)
    assert spark.read.text(f"file://{tmp_path}/x.chain").rdd.getNumPartitions() > 3
    assert sorted((r.chain_ind, r.t_start, r.q_start, r.size) for r in blocks.collect()) == sorted(want)
    assert sorted((r.chain_ind, r.score, r.id, r.q_strand) for r in heads.collect()) == [(k, 1000 - k, k + 1, k % 2) for k in range(40)]


@pytest.mark.parametrize(
    ("old", "new", "told"),
    [("200000 + ", "200000 - ", "isn't one"), (" q0 200000 + ", " q0 200000 x ", "isn't one"), ("\t", "\tz", "isn't one"), (" 200000 ", " 20 ", "don't make up"), ("chain 1000 ", "chain 1000 extra extra ", "isn't one")],
)
def test_bad_chains(spark, tmp_path, old, new, told):
    _, text = chains(3)
    (tmp_path / "x.chain").write_text("\n".join(text).replace(old, new, 1))
    with pytest.raises(ValueError, match=told):
        chain.read_chains(spark, f"file://{tmp_path}/x.chain", strict=True)
    chain.read_chains(spark, f"file://{tmp_path}/x.chain")


def test_chains_that_lack_lines(spark, tmp_path):
    _, text = chains(3)
    for cut in (text[:-4], text[:3] + text[4:], ["5\t1\t1", *text]):
        (tmp_path / "x.chain").write_text("\n".join(cut))
        with pytest.raises(ValueError):
            chain.read_chains(spark, f"file://{tmp_path}/x.chain", strict=True)


def test_index_prunes_files(spark, tmp_path):
    rng = random.Random(4)
    rows = spark.createDataFrame([(f"chr{rng.randint(1, 5)}", rng.randint(1, 100_000), "A" * rng.choice([1, 1, 1, 50]), "C", i) for i in range(3000)], "chrom string, pos long, ref string, alt string, k long")
    path = f"file://{tmp_path}/t"
    tables.write_indexed(rows, path, files=24)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(map(tuple, rows.collect()))
    regions = spark.createDataFrame([("chr2", 5_000, 9_000), ("chr4", 50_000, 50_010), ("chr9", 1, 10)], "r_chrom string, r_start long, r_end long")
    for overlap in (0, 1, 2):
        got = tables.read_regions(spark, path, regions, overlap)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, in_regions(rows, regions, overlap=overlap).collect())) and got.count() > 10
    assert len(got.inputFiles()) <= 6 < 20 <= len(spark.read.parquet(path).inputFiles())
    assert tables.read_regions(spark, path, regions.where("r_chrom = 'chr9'")).count() == 0
