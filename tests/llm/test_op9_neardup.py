import random

import numpy as np
import pyarrow as pa
import pytest

from locusloom.llm import neardup
from tests.llm.helpers import components, documents, words


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def expected(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    comp = components(range(len(rows)), links)
    name = {}
    for k, c in comp.items():
        name[c] = min(name.get(c, rows[k][0]), rows[k][0])
    return sorted((rows[k][0], len(sets[k]), name[comp[k]], rows[k][0] == name[comp[k]]) for k in range(len(rows)))


def corpus(seed, n=60, edits=(0, 1, 2, 4, 8, 16)):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(300)]
    rows = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice(edits)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy)))
    return rows


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_against_brute_force(spark, width, percent):
    rows = corpus(width)
    k = len(rows)
    rows += [(k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, "one"), (k + 4, "ONE"), (k + 5, "one two"), (k + 6, "long word " * 20_000)]
    got = neardup.near_duplicates(documents(spark, rows), width, percent).collect()
    assert sorted(map(tuple, got)) == expected(rows, width, percent)


def test_large_buckets(spark, monkeypatch):
    """Many different copies of one text, in buckets beyond the size that is joined with itself."""
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(7)
    rows = []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(80)]
        for _ in range(70):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(80)] = f"x{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(copy)))
    got = neardup.near_duplicates(documents(spark, rows), 3, 85).collect()
    assert sorted(map(tuple, got)) == expected(rows, 3, 85)


def passages(n):
    """Texts that differ but for a passage that all have, and near copies of some of them."""
    rng = random.Random(13)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for g in range(n):
        base = common + [f"g{g}w{k}" for k in range(60)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.choice([0, 0, 1, 2])):
            rows.append((len(rows), " ".join(base[:-2] + [f"x{rng.randrange(10_000)}" for _ in range(2)])))
    return rows


def test_crowded_buckets(spark, monkeypatch):
    """Buckets beyond DEEP are dealt by two and by three bands; copies are found all the same."""
    for name, value in {"SMALL": 2, "BLOCK": 8, "DEEP": 12}.items():
        monkeypatch.setattr(neardup, name, value)
    dealt = []
    deeper = neardup._dealt_deeper
    monkeypatch.setattr(neardup, "_dealt_deeper", lambda *a: dealt.append(1) or deeper(*a))
    rows = passages(90)
    got = neardup.near_duplicates(documents(spark, rows), 3, 85).collect()
    assert sorted(map(tuple, got)) == expected(rows, 3, 85)
    assert len(dealt) >= 2


def one_band(width, features=neardup._features):
    """Features whose first band all texts share, and no other band any two."""

    def run(batches):
        for batch in features(width)(batches):
            keys = batch.column("f1").to_numpy()[:, None] + np.arange(neardup.BANDS)
            keys[:, 0] = 7
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, neardup.BANDS), pa.int32()), keys.reshape(-1))
            yield batch.set_column(batch.schema.get_field_index("bands"), "bands", bands)

    return run


def test_crowded_buckets_lose_no_pair(spark, monkeypatch):
    """Pairs that share one band only, with a crowded bucket, are found by rare shingles."""
    for name, value in {"SMALL": 2, "BLOCK": 8, "DEEP": 12}.items():
        monkeypatch.setattr(neardup, name, value)
    monkeypatch.setattr(neardup, "_features", one_band)
    rows = passages(60)
    got = neardup.near_duplicates(documents(spark, rows), 3, 85).collect()
    assert sorted(map(tuple, got)) == expected(rows, 3, 85)


def test_paths_of_bands():
    assert [neardup._path(c) for c in (0, 20, 64, (20 + 1) * 64 + 3, ((5 + 1) * 64 + 7 + 1) * 64 + 9)] == [[0], [20], [0, 0], [20, 3], [5, 7, 9]]


def test_repeated_rows_and_ids(spark):
    rows = [(5, "a b c d e f g h"), (5, "a b c d e f g h"), (3, "a b c d e f g h"), (5, "other text of five words"), (9, None), (9, "")]
    got = neardup.near_duplicates(documents(spark, rows), 3, 85).collect()
    assert sorted(map(tuple, got)) == sorted([(5, 6, 3, False), (5, 6, 3, False), (3, 6, 3, True), (5, 3, 5, True), (9, 0, 9, True), (9, 0, 9, True)])
    null = neardup.near_duplicates(documents(spark, [(None, "a b c"), (4, "a b c"), (None, "x y z")]), 3, 85).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in null), key=str) == sorted([(None, 4, False), (4, 4, True), (None, None, True)], key=str)


def test_deduplication_keeps_columns(spark):
    rows = corpus(11)
    docs = documents(spark, rows)
    out = neardup.deduplicate(docs, 5, 80)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [i for i, _, _, kept in expected(rows, 5, 80) if kept]


def test_empty(spark):
    assert neardup.near_duplicates(documents(spark, [(1, "a")]).limit(0)).count() == 0
