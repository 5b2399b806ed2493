import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from locusloom.llm import resample
from tests.llm.helpers import LOWER, documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def expected(rows, items, n=1, buckets=10_000, percent=10, min_words=20):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    own, wanted = (Counter(crc(f) for r in part for f in features(r[1], n)[0]) for part in (rows, items))
    s, t = sum(own.values()), sum(wanted.values())
    gain = lambda k: math.floor(1000 * math.log((wanted[k] + 1) * (s + buckets) / ((own[k] + 1) * (t + buckets))))
    out = []
    for r in rows:
        found, words = features(r[1], n)
        weight = sum(gain(crc(f)) for f in found) // len(found) if found else 0
        h = int(sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= min_words])
    out.sort(key=lambda r: (not r[4], -r[3], r[0] is None, r[0] or 0))
    drawn = percent * sum(r[4] for r in out) // 100
    return sorted([(*r[:4], k if k <= drawn else None) for k, r in enumerate(out, 1)], key=str)


def corpus(n=150, seed=2):
    rng = np.random.default_rng(seed)
    vocabulary = [f"word{i}" for i in range(80)] + ["Éclair", "été", "A-B", "x_y", "42", "中文", "ſt"]
    text = lambda: " ".join(rng.choice(vocabulary, int(rng.integers(0, 60))))
    rows = [(i, text()) for i in range(n)]
    rows += [(900, None), (901, ""), (902, "... --"), (5, rows[5][1]), (5, rows[5][1]), (None, " ".join(["word1"] * 30)), (903, "word2 " * 50_000), (-4, "Word3 " * 25)]
    return rows, [(i, " ".join(rng.choice(vocabulary[:30], 40))) for i in range(20)] + [(100, None), (None, "word1 word2")]


@pytest.mark.parametrize(("n", "buckets", "broadcast"), [(1, 10_000, 1_000_000), (3, 64, 1_000_000), (2, 500, 10)])
def test_against_brute_force(spark, monkeypatch, n, buckets, broadcast):
    monkeypatch.setattr(resample, "BROADCAST_BUCKETS", broadcast)
    rows, items = corpus()
    target = spark.createDataFrame(items, "item_id long, text string")
    got = resample.importance(documents(spark, rows).repartition(7), target, n=n, buckets=buckets, percent=30)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, items, n, buckets, 30)


def test_drawn_rows_keep_their_columns(spark):
    rows, items = corpus()
    rows += [(5, "another text of the same document " * 9), (9, rows[9][1])]
    docs = documents(spark, rows).selectExpr("*", "1 as `a.b`", "map('k', 1) as `my-col`", "'r' as rank", "0 as _rank", "0 as _own", "0 as _copy", "0 as n_words", "0 as bucket", "0 as gain")
    got = resample.resampled(docs, spark.createDataFrame(items, "item_id long, text string"), percent=60)
    assert got.columns == [*docs.columns, "__rank"]
    drawn = [(r[0], r[4]) for r in expected(rows, items, percent=60) if r[4]]
    assert sorted([(r["doc_id"], r["__rank"]) for r in got.collect()], key=str) == sorted(drawn, key=str)
    texts = {(r[0], r[1]) for r in rows}
    assert all((r["doc_id"], r["text"]) in texts and r["a.b"] == 1 and r["rank"] == "r" for r in got.collect())


def test_empty(spark):
    none, items = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resample.importance(documents(spark, []), items).collect() == []
    assert len(resample.importance(documents(spark, [(1, "a b c")]), none, min_words=1, percent=100).collect()) == 1
    assert resample.resampled(documents(spark, []), none).collect() == []


def test_native(spark, small):
    from locusloom.llm.queries import op13_importance_resampling as query

    df = query(spark, small)
    plan = df._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
