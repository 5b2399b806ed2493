import numpy as np
import pandas as pd
import pytest

from locusloom.operators import gibbs, ld

NODES = "ld_block long, pop string, ld_node int, aa int, af double, ld_diagonal double, z double, n double"
EDGES = "ld_block long, pop string, i int, j int, w double"


def block(seed, size=12, pops=1):
    rng = np.random.default_rng(seed)
    nodes, edges = [], []
    for p in range(pops):
        for k in range(size):
            seen = rng.random() < 0.7
            nodes.append((seed, f"P{p}", k, int(rng.integers(0, 2)), float(rng.uniform(0.05, 0.95)), float(rng.uniform(2, 4)), float(rng.normal() * 3) if seen else None, float(rng.integers(500, 2000)) if seen else None))
        for k in range(size - 1):
            edges.append((seed, f"P{p}", k, k + 1, float(rng.uniform(-0.8, 0.8))))
            if k + 3 < size:
                edges.append((seed, f"P{p}", k, k + 3, float(rng.uniform(-0.2, 0.2))))
    return nodes, edges


def frames(rows, edges):
    return pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")]), pd.DataFrame(edges, columns=[c.split()[0] for c in EDGES.split(", ")])


def dense(b):
    n = len(b.d)
    p = np.diag(b.d)
    for i, j, w in zip(b.i, b.j, b.w, strict=True):
        p[i, j] += w
        p[j, i] += w
    sigma = np.array([b.covariance(e) for e in np.eye(n)])
    return p, sigma


def dense_blup(b):
    p, sigma = dense(b)
    s = b.seen
    p11 = p[np.ix_(s, s)] - p[np.ix_(s, ~s)] @ np.linalg.inv(p[np.ix_(~s, ~s)]) @ p[np.ix_(~s, s)] if (~s).any() else p
    y = np.zeros(len(s))
    y[s] = p11 @ b.alpha_hat[s]
    return sigma @ np.linalg.solve(sigma + p / b.mean_n[:, None], y)


@pytest.mark.parametrize(("pops", "task_rows"), [(1, ld.TASK_ROWS), (2, ld.TASK_ROWS), (2, 0)])  # 0: all blocks are spread
def test_conjugate_gradients_against_dense_algebra(spark, pops, task_rows):
    nodes, edges = [], []
    for seed in range(3):
        a, b = block(seed, pops=pops)
        nodes += a
        edges += b
    got = ld.blup(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), beta_cov=0.02, cross_corr=0.7, tolerance=1e-14 if task_rows else 1e-10, task_rows=task_rows).collect()
    got = {(r.ld_block, r.pop, r.ld_node): r.es for r in got}
    n = 0
    for seed in range(3):
        b = ld.Block(*frames(*block(seed, pops=pops)), -0.5, 0.02, 0.7, 1e-14)
        for r in b.effects(dense_blup(b)).itertuples():
            assert got[r.ld_block, r.pop, r.ld_node] == pytest.approx(r.es, rel=1e-6, abs=1e-10)
            n += 1
    assert n == len(got)


def test_large_blocks_are_spread_and_others_not(spark):
    nodes, edges = (a + b for a, b in zip(block(1, 6), block(2, 14), strict=True))
    nodes.append((1, "P0", 6, 0, 0.0, 2.0, 1.0, 100.0))  # no frequency to scale by
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    read = lambda df: {(r.ld_block, r.ld_node): r.es for r in df.collect()}
    plain, mixed = read(ld.blup(n, e, beta_cov=0.02, tolerance=1e-13)), read(ld.blup(n, e, beta_cov=0.02, tolerance=1e-9, task_rows=30))
    assert plain.keys() == mixed.keys() and {b for b, _ in plain} == {1, 2}
    assert all(mixed[k] == pytest.approx(v, rel=1e-5, abs=1e-8) for k, v in plain.items())
    with pytest.raises(ValueError):
        ld.blup(n, e.withColumn("j", e.j + 1), beta_cov=0.02, task_rows=30).collect()
    assert ld.blup(n.where("ld_block > 9"), e.where("ld_block > 9")).count() == 0


def test_unknown_neighbour_is_an_error():
    nodes, edges = frames(*block(1))
    edges.loc[0, "j"] = 99
    with pytest.raises(ValueError):
        ld.Block(nodes, edges, -0.5, 1e-2, 0.9, 1e-9)


def test_gibbs_is_seeded_and_burn_in_only_is_blup(spark):
    nodes, edges = block(5, 20)
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    read = lambda df: sorted((r.ld_node, r.es) for r in df.collect())
    args = {"beta_cov": 1e-3, "max_alpha2": 0.05, "herit_per_marker": 1e-3, "iterations": 8}
    one, two, other = (read(gibbs.pgs(n, e, seed=s, **args)) for s in (3, 3, 4))
    assert one == two and one != other
    plain = read(ld.blup(n, e, beta_cov=1e-3, tolerance=1e-10))
    assert read(gibbs.pgs(n, e, beta_cov=1e-3, iterations=2, burn_in=2)) == plain
    none = read(gibbs.pgs(n, e, beta_cov=1e-3, iterations=4, herit_per_marker=0.0))
    assert [x for _, x in none] == pytest.approx([x for _, x in plain], rel=1e-5, abs=1e-9)


def test_large_effect_is_found(spark):
    nodes, edges = block(9, 20)
    nodes = [(*r[:6], 15.0 if r[2] == 7 else 0.1, 1000.0) for r in nodes]
    args = {"beta_cov": 1e-7, "max_alpha2": 0.2, "herit_per_marker": 1e-3, "iterations": 12}
    got = {r.ld_node: abs(r.es) for r in gibbs.pgs(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), **args).collect()}
    assert max(got, key=got.get) == 7 and got[7] > 0.1
    weights = {r.ld_node: r.gw for r in gibbs.pgs(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), record_weights=True, **args).collect()}
    assert weights[7] == 1.0 and sum(weights.values()) < 5


def test_bayes_factors_are_normal_densities():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sd, n = rng.uniform(0.2, 0.7, 3), rng.integers(50, 500, 3).astype(float)
        e, s2, c = rng.normal(size=3) / 10, 0.05, 0.6
        base = np.diag(1 / n)
        more = base + s2 * np.outer(sd, sd) * np.where(np.eye(3) > 0, 1, c)
        log = lambda v: -0.5 * (np.linalg.slogdet(v)[1] + e @ np.linalg.solve(v, e))  # noqa: B023, E731
        assert gibbs.joint_log_bayes_factor(sd, e, n, s2, c, np.zeros(3, int))[0] == pytest.approx(log(more) - log(base), rel=1e-9)
        one = gibbs.log_bayes_factor(sd[:1], e[:1], n[:1], s2)[0]
        v = 1 / n[0] + s2 * sd[0] ** 2
        assert one == pytest.approx(-0.5 * (np.log(v * n[0]) + e[0] ** 2 / v - e[0] ** 2 * n[0]), rel=1e-9)


def test_first_association_represents_a_node(spark):
    ldgm = spark.createDataFrame([("c", 1, "A", "C", 0, 5, "P"), ("c", 2, "A", "C", 0, 5, "P"), ("c", 3, "A", "C", 0, 6, "P")], "chrom string, pos long, ref string, alt string, ld_block int, ld_node int, pop string")
    stats = spark.createDataFrame([("c", 2, "A", "C", 1.5, 10.0), ("c", 1, "A", "C", 2.0, None)], "chrom string, pos long, ref string, alt string, z double, n double")
    got = {r.ld_node: (r.pos, r.z) for r in ld.with_association(ldgm, stats).collect()}
    assert got == {5: (2, 1.5), 6: (3, None)}


def test_output_names():
    assert ld.output_name("s", "blup", 1, -0.5, 1e-7) == "s_blup_a0.5_b1e-07" and ld.output_name("s", "pgs", 2) == "s_pgsx"
    s2, w = gibbs.prior_grid()
    assert list(s2) == [0.001, 0.0005] and list(w) == pytest.approx([5e-5, 1e-4])
