import math
from collections import Counter

import numpy as np
import pytest

from locusloom.llm import lm
from tests.llm.helpers import documents, held_out, words

ROWS = [(i, f"the cat number{i % 7} sat on the mat and the dog {i % 3} ran Away" + " far" * (i % 4)) for i in range(60)]
ROWS += [(100, None), (101, ""), (102, " \t\n"), (103, "Zürich zürich ÉCOLE école unseen" + "x" * 100), (None, "the cat"), (5, ROWS[5][1]), (104, "word " * 3000)]


def expected(rows):
    train = [words(t) for i, t in rows if not held_out(i, 5)]
    c = Counter(w for ws in train for w in ws)
    ends = len(train)
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    p = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    return [(i, held_out(i, 5), len(words(t)) + 1, sum(w in c for w in words(t)) + (ends > 0), n, p(ends) + sum(p(c[w]) for w in words(t))) for i, t in rows]


def test_counts_and_base_scores(spark):
    got = lm.score(documents(spark, ROWS)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for g, e in zip(sorted(map(tuple, got), key=key), sorted(expected(ROWS), key=key), strict=True):
        assert g[:5] == e[:5]
        assert g[5] == pytest.approx(e[5], rel=1e-9)
        assert g[6] < 0 and math.isfinite(g[6])


def test_learns(spark, small):
    """Held-out texts of the corpus are likelier than by single tokens."""
    df = lm.score(spark.read.parquet(f"{small}/documents.parquet"))
    base, score = df.where("held_out").selectExpr("sum(base_score)", "sum(score)").first()
    assert score > base
    assert 0 < df.where("n_tokens > 100").agg({"bits_per_byte": "max"}).first()[0] < 8


def test_probabilities_of_words_add_up_to_at_most_one(spark):
    """Two-token texts with every word of the vocabulary and one that isn't in it."""
    rows = [(5 * k, t) for k in range(1, 40) for t in (f"a b c{k % 3}", "a a b")]
    rows = [r for r in rows if not held_out(r[0], 5)]
    vocabulary = sorted({w for _, t in rows for w in words(t)} | {"zz"})
    asked = [(i, w) for i, w in zip((n for n in range(10_000) if held_out(n, 5)), vocabulary)]
    out = {r.doc_id: r.score for r in lm.score(documents(spark, rows + asked)).collect() if r.held_out}
    assert sum(10**s for s in out.values()) < 1.0


def test_no_training_documents_and_empty(spark):
    only = [(n, "a b") for n in range(200) if held_out(n, 5)]
    got = lm.score(documents(spark, only)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == pytest.approx(0.0) and math.isfinite(r.score) for r in got)
    assert lm.score(documents(spark, ROWS).limit(0)).count() == 0


def test_tables_grow_with_the_corpus():
    grown = [lm.sizes(10**k) for k in range(13)]
    assert grown[0] == (1024, 20) and sorted(grown) == grown and grown[-1] == (1 << 20, 24) and len(set(grown)) > 6 and lm.sizes(3_000_000)[0] == 2048


def test_very_long_texts_and_counts(spark):
    """A text of many pieces' length, and counts that float32 couldn't go on with."""
    rows = [(5 * k, "one two three " * 40_000) for k in range(3)] + [(1, "one two three")]
    out = {r.doc_id: r for r in lm.score(documents(spark, rows)).collect()}
    assert out[0].n_tokens == 120_001 and out[1].score > out[1].base_score
    mixer = lm.Mixer(2)
    mixer.seen[:] = 2.0**24
    mixer.learn(np.array([[0], [5]]), np.ones(1, np.int64), np.ones(1))
    assert mixer.seen[1][0] == 2**24 + 1


def test_long_words_are_spelled_whole(spark, monkeypatch):
    """Texts of one word that begin alike are told apart by what follows, however far in, and in whatever pieces."""
    ids = [n for n in range(1000) if held_out(n, 5)]
    rows = [(5 * k, f"some ab{'ab' * k} words") for k in range(40) if not held_out(5 * k, 5)]
    rows += [(ids[0], "ab" * 300), (ids[1], "ab" * 150 + "q7" * 150), (ids[2], "ab" * 150 + "Q7" * 150), (ids[3], "ab" * 299 + "zx")]
    told = lambda: {r.doc_id: r.bits_per_byte for r in lm.score(documents(spark, rows)).collect()}
    whole = told()
    assert whole[ids[0]] < whole[ids[3]] < whole[ids[1]] == whole[ids[2]]
    speller = lm.Learned(len(lm.ORDERS), lm.SLOT_BITS, {})
    spelled = lm._spelled([b"ab" * 300, b"x", b"", b"ab" * 299 + b"zx"], speller)
    monkeypatch.setattr(lm, "SPELL_BYTES", 7)
    assert lm._spelled([b"ab" * 300, b"x", b"", b"ab" * 299 + b"zx"], speller) == pytest.approx(spelled, rel=1e-9)
