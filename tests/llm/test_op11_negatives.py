import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusloom.llm import negatives

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id long, embedding array<float>, label int, row string, anchor int, whole string, score int"


def expected(rows, anchor, positives=5, most=5, low=80, high=100):
    used = [(i, [min(max(math.floor(256 * float(x)), -(1 << 22)), 1 << 22) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(used):
        if not anchor(i):
            continue
        met = [(sum(p * q for p, q in zip(v, w, strict=True)), j, z) for b, (j, w, z) in enumerate(used) if b != a and len(v) == len(w)]
        met.sort(key=lambda r: (-r[0], r[1]))
        for score, j, _ in [r for r in met if r[2] == y][:positives]:
            fit = [r for r in met if r[2] != y and low * score <= 100 * r[0] <= high * score][:most]
            out += [(i, j, k, r[1], score, r[0]) for k, r in enumerate(fit, 1)]
    return sorted(out)


def vectors(n=300, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((6, dim))
    return [(i, (centre[i % 6] + 0.6 * rng.standard_normal(dim)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]


def odd(rows):
    nan, inf, one = float("nan"), float("inf"), rows[0][1]
    extra = [(1000, None, 1), (1010, one, None), (1020, [nan, *one[1:]], 1), (1030, [inf, *one[1:]], 1), (1040, [None, *one[1:]], 1), (None, one, 1)]
    extra += [(1050, [], 1), (1060, [], 2), (1060, [], 1), (1070, [1.0, 2.0], 1), (1080, [1.0, 2.0], 2), (1090, [2.0, 1.0], 1), (1100, [1e30, -1e30], 3), (1110, [1e30, 1.0], 3), (1120, [1e30, 0.5], 2), (1130, [0.0, 0.0], 2)]
    return rows + extra + [(0, one, 1), (0, one, 1), (7, one, 2), (7, one, 2), (10, one, rows[0][2]), (3, one, (rows[0][2] + 1) % 4)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("bytes_", [2_000, 64 << 20])
def test_against_brute_force(spark, monkeypatch, bytes_):
    monkeypatch.setattr(negatives, "PASS_BYTES", bytes_)
    rows = odd(vectors())
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)
    want = expected(rows, lambda i: i % 10 == 0)
    assert got.columns == list(COLUMNS) and len(want) > 300
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("turned", [True, False])
def test_slices_and_thresholds(monkeypatch, turned):
    """Small slices, and thresholds that the slices prove, against brute force; the first components do discard."""
    for name, value in {"ANCHORS": 7, "ROWS": 50, "MANY": 1, "PAIRS": 11}.items():
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(400, 32, 5)
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in rows]
    columns = {"row": range(len(rows)), "vec_id": [r[0] for r in rows], "label": [r[2] for r in rows], "whole": pa.array(whole, pa.list_(pa.int32()))}
    batch = pa.RecordBatch.from_pydict(columns)
    x = np.array(whole, float)
    turns = {32: np.linalg.eigh(x.T @ x)[1][:, ::-1]} if turned else {}
    asked = [(i, i, rows[i][2], whole[i], []) for i in range(0, 400, 20)]
    seen = []
    products = negatives._products
    monkeypatch.setattr(negatives, "_products", lambda x, y, i, j: (seen.append(len(i)), products(x, y, i, j))[1])

    def best(anchors, slots, meet):
        told = [r for b in negatives._pass(SimpleNamespace(value=anchors), turns, slots, meet)([batch]) for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        by = {}
        for a, s, _, other, score in sorted(told, key=lambda r: (-r[4], r[3])):
            by.setdefault((a, s), []).append((other, score))
        return {k: v[:5] for k, v in by.items()}

    first = best(asked, 0, negatives._meet_positives(5))
    found = best([(*a[:4], [s for _, s in first[a[0], 0]]) for a in asked], 5, negatives._meet_negatives(5, 80, 100))
    got = [(a, first[a, 0][s][0], k, other, first[a, 0][s][1], score) for (a, s), v in found.items() for k, (other, score) in enumerate(v, 1)]
    assert sorted(got) == expected(rows, lambda i: i % 20 == 0)
    assert sum(seen) < (0.5 if turned else 0.9) * 2 * 20 * 400


def test_empty(spark):
    assert negatives.hard_negatives(frame(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.hard_negatives(frame(spark, [(1, [1.0], 1)]), F.col("vec_id") == 1).collect() == []
