import hashlib

import numpy as np
import pytest

from locusloom.llm import linededup
from tests.llm.helpers import LOWER, documents


def expected(rows, least=10):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    last = float("inf")
    by = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            by.setdefault(key(line), set()).add(last if r[0] is None else r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= least and len(by[key(x)]) > 1 and min(by[key(x)]) != (last if r[0] is None else r[0]))]
        out.append((r[0], len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def texts(n=200, seed=8):
    rng = np.random.default_rng(seed)
    shared = ["A line that many hold", "  a LINE that many hold\t", "tiny", "éééééééééé", "ééééééééé", "Été long enough here", "été long enough here", "", " \v\f\r ", "nine char", "ten chars!"]
    own = lambda i: "\n".join(str(rng.choice(shared)) if rng.random() < 0.6 else f"own line {i} number {rng.integers(0, 5)}" for _ in range(int(rng.integers(1, 12))))
    rows = [(i, own(i)) for i in range(n)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (3, "A line that many hold\nonce more in three"), (4, "once more in three"), (503, "one two three four\n" * 20_000), (504, "x" * 300_000), (505, "X" * 300_000)]
    return rows + [(None, "a line that many hold\nonly nulls hold this"), (None, "only nulls hold this"), (7, rows[7][1]), (-9, "TEN CHARS!\r")]


@pytest.mark.parametrize(("keys", "shard"), [(4_000_000, 1 << 16), (4_000_000, 3), (0, 3), (0, 1 << 16)])
def test_against_brute_force(spark, monkeypatch, keys, shard):
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", keys)
    monkeypatch.setattr(linededup, "SHARD_KEYS", shard)
    rows = texts()
    got = linededup.digests(documents(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_own_columns_stay(spark):
    rows = [(1, "a line that two hold\nx"), (2, "a line that two hold\ny"), (3, None)]
    docs = documents(spark, rows).selectExpr("*", "1 as `a.b`", "map('k', 1) as `my-col`", "'q' as n_lines", "'own' as own")
    got = linededup.deduplicated(docs)
    assert got.columns == [*docs.columns, "_n_lines", "n_dropped"]
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["_n_lines"], r["n_dropped"], r["a.b"], r["my-col"], r["lang"]) for r in got.collect()} == {
        1: ("a line that two hold\nx", "q", 2, 0, 1, {"k": 1}, "en"),
        2: ("y", "q", 2, 1, 1, {"k": 1}, "en"),
        3: (None, "q", 1, 0, 1, {"k": 1}, "en"),
    }


def test_empty(spark):
    assert linededup.digests(documents(spark, [])).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5_000, 100_000])
def test_hash_is_minimal_and_perfect(n):
    a, b = np.random.default_rng(n).integers(0, 1 << 63, (2, n), dtype=np.uint64) * np.uint64(2)
    _, words, index = linededup.build(a, b)
    assert sorted(index) == list(range(n))
    assert len(words) * 64 <= 5 * n + 64 * 20


def test_unknown_keys_are_refused():
    a, b = np.random.default_rng(1).integers(0, 1 << 63, (2, 3_000), dtype=np.uint64)
    rows, of = [], 4
    import pyarrow as pa

    for k in range(of):
        own = np.flatnonzero(a[:2000].view(np.int64) % of == k)
        table = pa.table({"shard": np.full(len(own), k, np.int32), "a": a[own].view(np.int64), "b": b[own].view(np.int64), "doc": own, "n": own})
        rows += linededup._shard(table).to_pylist()
    index = linededup.Index(rows, of)
    at = index.find(a, b)
    assert (at[2000:] == -1).all() and (index.owners[at[:2000]] == np.arange(2000)).all() and (index.counts[at[:2000]] == np.arange(2000)).all()
