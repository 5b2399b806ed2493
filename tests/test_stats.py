"""Statistics against the error function and published numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusloom.functions import stats
from locusloom.operators import meta

# Published rows of a three-study analysis: effect, standard error, -log10 p, I2, -log10 p of Q.
IVW = [(0.135859, 0.0202669, 10.6914, 74.0672, 1.67469), (0.112246, 0.0200544, 7.6616, 46.4042, 0.810315), (0.124542, 0.0200248, 9.30184, 65.343, 1.25312)]
SZW = [(6.85292, 11.1405), (5.69396, 7.90614), (5.53209, 7.4997)]


def column(spark, values, c):
    return [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "x double").select(c).collect()]


def test_two_sided_lp(spark):
    zs = [0.0, 0.1, 1.0, 1.96, 2.4999, 2.5, 2.5001, 5.0, 8.0, 20.0, 37.0]
    for z, lp in zip(zs, column(spark, zs, stats.two_sided_lp("x")), strict=True):
        assert lp == pytest.approx(-math.log10(math.erfc(z / math.sqrt(2))), rel=1e-10, abs=1e-12)
    far = column(spark, [100.0, 1000.0], stats.two_sided_lp("x"))
    assert far[0] == pytest.approx(2173.5705, rel=1e-6) and far[1] > 217_000


def test_published_rows(spark):
    lps = column(spark, [e / s for e, s, *_ in IVW], stats.two_sided_lp("x"))
    assert [f"{x:.4g}" for x in lps] == [f"{r[2]:.4g}" for r in IVW]
    lps = column(spark, [z for z, _ in SZW], stats.two_sided_lp("x"))
    assert lps == pytest.approx([lp for _, lp in SZW], rel=1e-5)
    for *_, i2, cq in IVW:
        q = 2 / (1 - i2 / 100)
        got = spark.createDataFrame([(q, math.sqrt(q), 2)], "q double, _root double, d int").select(stats.chi2_lp("q", "d")).first()[0]
        assert got == pytest.approx(cq, rel=1e-4)


def test_quantile_inverts_the_tail(spark):
    lps = [0.0, 1e-6, 0.3, 1.0, 5.0, 7.3, 50.0, 300.0, 5000.0]
    df = stats.with_abs_z(spark.createDataFrame([(x,) for x in lps], "lp double"), "lp", "z")
    for r in df.withColumn("again", stats.two_sided_lp("z")).collect():
        assert r.again == pytest.approx(r.lp, rel=1e-9, abs=1e-9)


def test_chi2_tails(spark):
    for d in range(1, 12):
        for x in (0.01, 0.5, 3.0, 20.0, 150.0):
            got = spark.createDataFrame([(x, math.sqrt(x), d)], "x double, _root double, d int").select(stats.chi2_lp("x", "d")).first()[0]
            # By integrating the density numerically.
            t = np.linspace(0, 400, 4_000_001)[1:] + x
            log_density = (d / 2 - 1) * np.log(t) - t / 2 - d / 2 * math.log(2) - math.lgamma(d / 2)
            tail = np.exp(log_density).sum() * 1e-4
            assert got == pytest.approx(-math.log10(tail), rel=2e-3, abs=2e-4)


def test_missing_and_bad_arguments(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (float("inf"),)], "lp double")
    assert [r.z for r in stats.with_abs_z(df, "lp", "z").collect()] == [None] * 4


def test_truncated_correlation():
    rng = np.random.default_rng(1)
    for rho in (0.1, 0.5, 0.8):
        z = rng.standard_normal((2_000_000, 2))
        a, b = z[:, 0], rho * z[:, 0] + math.sqrt(1 - rho * rho) * z[:, 1]
        own = (np.abs(a) < 1) & (np.abs(b) < 1)
        assert stats.correlation_from_truncated(float((a * b)[own].mean())) == pytest.approx(rho, abs=0.02)
    assert stats.correlation_from_truncated(-0.1) == 0.0 == stats.correlation_from_truncated(float("nan"))


def studies(spark, rows):
    return spark.createDataFrame(rows, "vid long, study int, es double, se double, ns double")


def test_overlap_without_correlation_is_the_plain_combination(spark):
    rng = np.random.default_rng(3)
    rows = [(v, s, float(rng.normal()), float(rng.uniform(0.1, 1)), float(rng.integers(50, 500))) for v in range(30) for s in range(4) if rng.random() < 0.8]
    df = studies(spark, rows)
    plain = {r.vid: r for r in meta.combine(df, "ivw", het=True, key=["vid"]).collect()}
    other = {r.vid: r for r in meta.combine_overlapping(df, np.eye(4), "ivw", het=True, key=["vid"]).collect()}
    assert plain.keys() == other.keys()
    for v, r in plain.items():
        for c in ("es", "se", "lp", "i2", "cq"):
            assert other[v][c] == pytest.approx(r[c], rel=1e-9, abs=1e-9) if r[c] is not None else other[v][c] is None


def even_overlap(rows, own, shared):
    """{vid: (es, se, ne)} where all correlations are the same, so that the inverse of own I + shared J is known."""
    out = {}
    for v in {r[0] for r in rows}:
        es, se, n = np.array([r[2:] for r in rows if r[0] == v]).T
        form = lambda x, y: ((x * y).sum() - shared / (own + shared * len(x)) * x.sum() * y.sum()) / own
        weight = form(1 / se, 1 / se)
        out[v] = (form(es / se, 1 / se) / weight, weight**-0.5, form(np.sqrt(n), np.sqrt(n)))
    return out


def test_overlap_of_many_studies(spark):
    """A hundred studies, a pattern of its own for nearly each variant."""
    rng = np.random.default_rng(11)
    k = 100
    rho = np.full((k, k), 0.1) + np.diag(np.full(k, 0.9))
    rows = [(v, s, float(rng.normal()), float(rng.uniform(0.1, 1)), float(rng.integers(50, 500))) for v in range(120) for s in range(k) if v < 5 or rng.random() < 0.3]
    want = even_overlap(rows, 0.9, 0.1)
    got = {r.vid: (r.es, r.se, r.ne) for r in meta.combine_overlapping(studies(spark, rows), rho, "ivw", key=["vid"]).collect()}
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v], rel=1e-9) for v in want)
    means = {(r.a, r.b): (r.mean, r.n) for r in meta.truncated_products(studies(spark, rows), ["vid"], "ivw").collect()}
    z = {}
    for v, s, es, se, _ in rows:
        if abs(es / se) <= 1:
            z.setdefault(v, {})[s] = es / se
    pairs = {}
    for x in z.values():
        for a in x:
            for b in x:
                if a < b:
                    pairs.setdefault((a, b), []).append(x[a] * x[b])
    assert means.keys() == pairs.keys() and len(pairs) > 3000
    assert all(means[k] == (pytest.approx(np.mean(p)), len(p)) for k, p in pairs.items())


def test_overlap_of_odd_rows(spark):
    rows = [(1, 0, 0.3, 0.1, 100.0), (1, 1, 0.1, 0.1, None), (2, 0, None, 0.1, 5.0), (2, 1, 0.2, 0.0, 5.0), (3, 0, 0.3, 0.2, 10.0), (3, 1, 0.3, 0.2, 10.0)]
    got = {r.vid: r for r in meta.combine_overlapping(studies(spark, rows), np.ones((2, 2)), "ivw", key=["vid"]).collect()}
    assert set(got) == {1, 3} and got[1].ne is None
    assert got[3].es == pytest.approx(0.3) and got[3].se == pytest.approx(0.2) and got[3].ne == pytest.approx(10)
    none = studies(spark, rows).where("vid < 0")
    assert meta.combine_overlapping(none, np.eye(2), "ivw", het=True, key=["vid"]).count() == 0 and meta.truncated_products(none, ["vid"], "ivw").count() == 0


def test_identical_studies(spark):
    r = meta.combine(studies(spark, [(1, s, 0.3, 0.1, 100.0) for s in range(4)]), "ivw", het=True, n_studies=5, key=["vid"]).first()
    assert (r.es, r.se, r.ns) == (pytest.approx(0.3), pytest.approx(0.05), 400) and r.i2 == 0 and r.cq == pytest.approx(0, abs=1e-9) and r.ed == "++++?"


def test_missing_contributors(spark):
    r = meta.combine(studies(spark, [(1, 0, 0.3, 0.1, 100.0), (1, 1, 0.1, 0.1, None), (1, 2, None, 0.1, 50.0)]), "ivw", key=["vid"]).first()
    assert r.ns is None and r.es == pytest.approx(0.2)


def test_output_fields():
    one, two = {"es", "se", "ns", "af"}, {"es", "se", "ns"}
    assert meta.output_fields([one, two], "ivw", het=True) == ["es", "se", "lp", "ns", "ne", "i2", "cq"]
    assert meta.output_fields([one, one], "szw", overlap=True) == ["ez", "lp", "af", "ne"]


def test_binomial(spark):
    for a, b in ((0, 0), (0, 10), (3, 9), (40, 60), (7, 7)):
        n, low = a + b, min(a, b)
        p = min(1.0, 2 * sum(math.comb(n, k) for k in range(low + 1)) / 2**n)
        got = spark.range(1).select(stats.binomial_lp(F.lit(a), F.lit(b))).first()[0]
        assert got == pytest.approx(-math.log10(p), abs=1e-9)


def test_order_of_z(spark):
    df = spark.createDataFrame([(1, 5.0, -0.4, 0.2, 2.0), (2, None, -0.4, 0.2, 2.0), (3, None, -0.4, None, 2.0), (4, None, 0.0, None, 2.0), (5, None, None, 0.2, 2.0)], "k int, ez double, es double, se double, lp double")
    told = lambda scheme: [None if r.z is None else round(r.z, 4) for r in meta.with_z(df, scheme).orderBy("k").collect()]
    assert told("szw") == [5.0, -2.5758, -2.5758, 2.5758, None] and told("ivw") == [-2.0, -2.0, None, None, None]
    assert told("blup") == [5.0, -2.0, -2.5758, 2.5758, None]
