import hashlib
import random
import re

import pytest

from locusloom.llm import mixing
from tests.llm.helpers import documents


def divide(total, children):
    """Water-filling, one child after the other. children: name -> (capacity, weight)."""
    got, left, open_ = dict.fromkeys(children, 0.0), total, {k for k, (c, w) in children.items() if w > 0}
    while open_:
        weight = sum(children[k][1] for k in open_)
        full = {k for k in open_ if children[k][0] <= left * children[k][1] / weight + 1e-9}
        if not full:
            for k in open_:
                got[k] = left * children[k][1] / weight
            break
        for k in full:
            got[k] = children[k][0]
            left -= children[k][0]
        open_ -= full
    return got


def domain(source):
    m = re.search(r"([0-9]+)$", source)
    return f"domain{int(m[1]) % 4}" if m else "other"


def expected(rows, weights, fraction, epochs, seed):
    tokens = [len((t or "").split()) for _, t, *_ in rows]
    leaves = {}
    for (i, t, lang, source), n in zip(rows, tokens, strict=True):
        leaves.setdefault((domain(source or ""), lang or "", source or ""), []).append((i, t, n))
    weight = lambda level, name: weights.get(level, {}).get(name, 1.0)
    cap = lambda path: sum(n for k, v in leaves.items() if k[: len(path)] == path for *_, n in v) * epochs
    given = {(): sum(tokens) * fraction}
    for depth, level in enumerate(mixing.LEVELS):
        new = {}
        for parent, total in given.items():
            names = {k[: depth + 1] for k in leaves if k[:depth] == parent}
            new |= divide(total, {p: (cap(p), weight(level, p[-1])) for p in names})
        given = new
    out = []
    for leaf, members in leaves.items():
        size, budget = sum(n for *_, n in members), int(given[leaf] + 1e-6)
        e = budget // size if size else 0
        left, at = budget - e * size, 0
        key = lambda m: hashlib.md5(f"{seed}:{e}:{'null' if m[0] is None else m[0]}".encode()).hexdigest()  # noqa: B023, E731
        for m in sorted(members, key=key):
            copies = e + (at < left and m[2] > 0)
            at += m[2]
            if copies:
                out.append((m[0], *leaf, m[2], copies))
    return sorted(out, key=str)


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(rng.randint(0, 40))) + f" t{i}", rng.choice(["en", "de", None]), rng.choice(["src1", "src1", "src1", "src2", "src5", "blog", None])) for i in range(n)]


@pytest.mark.parametrize("fraction,epochs", [(1.0, 3.0), (0.3, 1.5), (2.5, 2.0), (9.0, 2.0)])
def test_against_brute_force(spark, fraction, epochs):
    rows, weights = corpus(), {"domain": {"domain1": 3.0, "other": 0.0}, "lang": {"de": 2.0}}
    got = mixing.mixture(documents(spark, rows), weights, fraction, epochs, 7).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, weights, fraction, epochs, 7)


def test_rows_are_repeated_whole(spark):
    rows = corpus(60)
    docs = documents(spark, rows)
    out = mixing.mixed(docs, {}, 2.0, 3.0, 1)
    assert out.columns == docs.columns
    copies = {r[0]: r[-1] for r in expected(rows, {}, 2.0, 3.0, 1)}
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, c in copies.items() for _ in range(c))


def test_degenerate_inputs(spark):
    assert mixing.mixture(documents(spark, corpus(1)).limit(0), {}).count() == 0
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b c"), (3, "a b c")]
    out = mixing.mixture(documents(spark, rows), {}, 1.0, 2.0, 3).collect()
    assert sorted((r.doc_id or 0, r.copies) for r in out if r.n_tokens) == [(0, 1), (3, 1), (3, 1)]
    with pytest.raises(ValueError):
        mixing.mixture(documents(spark, rows), {"lang": {"en": -1.0}})


def test_seed_changes_the_selection(spark):
    docs = documents(spark, corpus())
    a, b, c = (sorted(r.doc_id for r in mixing.mixture(docs, {}, 0.3, 2.0, s).collect()) for s in (1, 2, 1))
    assert a == c and a != b
