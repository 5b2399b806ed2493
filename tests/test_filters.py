import pytest

from locusloom.operators import filters, intervals


@pytest.mark.parametrize("overlap,kept", [(0, [2, 3]), (1, [1, 2, 3, 4]), (2, [1, 2, 3])])
def test_region_overlap(spark, overlap, kept):
    rows = spark.createDataFrame([(1, "c", 98, "ACGT", "A"), (2, "c", 100, "A", "C"), (3, "c", 200, "A", "AC"), (4, "c", 97, "ACGT", "A"), (5, "c", 90, "ACG", "A"), (6, "d", 150, "A", "C"), (7, "c", 201, "A", "T")], "k int, chrom string, pos long, ref string, alt string")
    regions = spark.createDataFrame([("c", 100, 200), ("c", 150, 160), ("d", 5, 4)], "r_chrom string, r_start long, r_end long")
    if overlap == 2:
        rows = rows.where("k <> 4 and k <> 3").union(rows.where("k = 3").selectExpr("k", "chrom", "pos - 1", "ref", "alt"))
    assert sorted(r.k for r in intervals.in_regions(rows, regions, overlap=overlap).collect()) == kept
    assert sorted(r.k for r in intervals.in_regions(rows, regions, exclude=True, overlap=overlap).collect()) == sorted({r.k for r in rows.collect()} - set(kept))


def test_many_intervals_shuffle(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BROADCAST_BINS", 1)
    rows = spark.range(0, 1000, 7).selectExpr("id as k", "'c' as chrom", "id as pos", "'A' as ref", "'C' as alt")
    regions = spark.range(0, 1000, 100).selectExpr("'c' as r_chrom", "id as r_start", "id + 20 as r_end")
    assert sorted(r.k for r in intervals.in_regions(rows, regions, overlap=0).collect()) == [k for k in range(0, 1000, 7) if k % 100 <= 20]


def test_expressions(spark):
    df = spark.createDataFrame([(1, 0.5, "PASS"), (2, None, "x"), (3, -1.0, "PASS")], "k int, es double, f string")
    ids = lambda **a: sorted(r.k for r in filters.select_rows(df, **a).collect())
    assert ids(include="FORMAT/ES > 0 || f = 'x'") == [1, 2] and ids(include='INFO/ES>0 && f="PASS"') == [1] and ids(exclude="FMT/ES > 0") == [2, 3] and ids() == [1, 2, 3]
    with pytest.raises(ValueError):
        filters.select_rows(df, "es > 0", "es < 0")


def test_conditions(spark):
    rows = spark.createDataFrame([(1, "A|B", 2.0, ["A", "C"], [1, 2]), (2, "A&B", 3.0, ["A", "C", "G"], [0, None])], "k int, FILTER string, ES double, alleles array<string>, AC array<int>")
    kept = lambda e: sorted(r.k for r in filters.select_rows(rows, e).collect())
    assert kept('FILTER=="A|B"') == [1] and kept("FILTER='A&B' | FORMAT/ES<2.5") == [1, 2] and kept('FMT/ES>1 && FILTER!="A&B"') == [1]
    assert kept("N_ALT > 1") == [2] and kept("SUM(INFO/AC) >= 3") == [1]
