import math

import numpy as np
import pytest

from locusloom.llm import embdup
from tests.llm.helpers import components


def expected(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, pairs = dict.fromkeys(range(len(good)), 0), []
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    comp = components(range(len(good)), pairs)
    name = {c: min(good[k][0] for k in comp if comp[k] == c) for c in set(comp.values())}
    out = [(good[k][0], links[k], name[comp[k]], good[k][0] == name[comp[k]]) for k in range(len(good))]
    return sorted(out + [(i, 0, i, True) for i, v in rows if i not in {g[0] for g in good}])


def vectors(seed=4, n=250, dim=24):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        base = rng.standard_normal(dim)
        out.append((len(out), base.astype(np.float32).tolist()))
        for _ in range(int(rng.integers(0, 4))):
            out.append((len(out), (base + rng.standard_normal(dim) * rng.choice([0.05, 0.2, 0.3, 0.34])).astype(np.float32).tolist()))
    return out


@pytest.mark.parametrize("block", [8, 1024])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embdup, "BLOCK", block)
    rows = vectors()
    k = len(rows)
    rows += [(k, None), (k + 1, []), (k + 2, [0.0] * 24), (k + 3, [float("nan")] * 24), (k + 4, [float("inf")] + [1.0] * 23), (k + 5, [None] + [1.0] * 23), (k + 6, [1.0, 2.0]), (k + 7, [1e-30, 2e-30]), (k + 8, [1e30, 2e30]), (k + 9, [-0.0, 1.0]), (k + 10, [0.0, 1.0])]
    rows += [(k + 11 + j, rows[0][1]) for j in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as cid", "'x' as component", "3 as _h", "4 as copies")
    assert sorted(map(tuple, embdup.near_duplicate_vectors(df).collect())) == expected(rows)


def test_estimate_is_unbiased_and_bounded(monkeypatch):
    """The codes' estimates of inner products, over many random rotations."""
    rng = np.random.default_rng(8)
    dim, errors, outside = 64, [], 0
    for _ in range(300):
        o, q = embdup._unit(rng.standard_normal((2, dim)))
        q = embdup._unit((0.8 * o + 0.6 * q)[None])[0]
        turn = np.linalg.qr(rng.standard_normal((256, 256)))[0][:dim], rng.random(256)
        monkeypatch.setattr(embdup, "_rotation", lambda d, turn=turn: turn)
        own = embdup._codes(np.stack([o, q]))
        own |= {c: np.ascontiguousarray(own[c]).view(np.uint64) for c in ("code", "planes")}
        estimate, bound = embdup._estimate(own, np.array([0, 1]), np.array([1, 0]))
        errors += (estimate - o @ q).tolist()
        outside += (np.abs(estimate - o @ q) > bound).sum()
    assert abs(np.mean(errors)) < 4 * np.std(errors) / math.sqrt(len(errors)) and outside == 0 and np.std(errors) < 0.06


def test_mixed_lengths(spark):
    """Vectors of very different lengths, also such as are equal modulo 1024, never meet."""
    rng = np.random.default_rng(2)
    rows = []
    for dim in (1, 2, 3, 64, 1027, 1088):
        base = rng.standard_normal(dim)
        rows += [(len(rows) + k, (base + 0.05 * k * rng.standard_normal(dim)).astype(np.float32).tolist()) for k in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embdup.near_duplicate_vectors(df).collect())) == expected(rows)


@pytest.mark.parametrize(("listed", "pairs", "block"), [(0, 64, 16), (8, 1 << 17, 64), (10**9, 100, 16)])
def test_tight_clusters(spark, monkeypatch, listed, pairs, block):
    """A third of the rows nearly alike: cells are listed or recomputed in place, never both."""
    for name, value in (("LISTED", listed), ("PAIRS", pairs), ("BLOCK", block)):
        monkeypatch.setattr(embdup, name, value)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(32)
    rows = [(i, (base + 0.17 * rng.standard_normal(32)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(150 + i, rng.standard_normal(32).astype(np.float32).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    assert sorted(map(tuple, embdup.near_duplicate_vectors(df).collect())) == expected(rows)


def test_recall_of_the_bands():
    """Pairs at the threshold and a little above share a band, for several lengths."""
    rng = np.random.default_rng(9)
    for dim in (2, 3, 16, 64, 300):
        x = embdup._unit(rng.standard_normal((2000, dim)))
        y = embdup._unit(rng.standard_normal((2000, dim)))
        y = embdup._unit(y - (x * y).sum(axis=1, keepdims=True) * x)
        y = 0.951 * x + math.sqrt(1 - 0.951**2) * y
        met = (embdup._words(x, 50_000, 0.95) == embdup._words(y, 50_000, 0.95)).any(axis=1)
        assert met.mean() >= 0.999, (dim, met.mean())


def test_empty(spark):
    assert embdup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
