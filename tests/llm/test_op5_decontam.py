import hashlib
import random
import re

from locusloom.llm import decontam
from tests.llm.helpers import LOWER, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(rows, items, window=10):
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = []
    for i, t, *_ in rows:
        w, hit, found = split(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= {str(x) for x in own if x is not None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(50)] + ["Éa", "éa", "Straße", "İx", "a1"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".", "\n"]) for _ in range(n))
    items = [(k, text(rng.choice([3, 9, 10, 11, 30]))) for k in range(40)] + [(90, None), (91, ""), (92, "..."), (93, "W1"), (10, "w1 w2"), (2, "w3 W4"), (None, "w5 w6 w7")]
    rows = []
    for i in range(150):
        t = text(rng.randint(0, 60))
        if i % 3 == 0:
            part = split(items[rng.randrange(40)][1])
            t += " " + " ".join(p.upper() if p.isascii() else p for p in part[: rng.randint(1, 14)]) + "! " + text(5)
        rows.append((i, t))
    return rows + [(500, None), (501, ""), (502, "--"), (7, rows[7][1]), (7, "another text w1"), (None, "w1 w2"), (503, "w9 " * 20000)], items


def test_against_brute_force(spark):
    rows, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as words", "1 as doc_id", "2 as fingerprint")
    got = decontam.contamination(documents(spark, rows), bench).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, items)


def test_shuffled_when_the_benchmark_is_large(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 3)
    rows, items = corpus(9)
    got = decontam.contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, items)


def test_empty_tables(spark):
    rows, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.contamination(documents(spark, rows).limit(0), bench).count() == 0
    assert sorted(map(tuple, decontam.contamination(documents(spark, rows), bench.limit(0)).collect()), key=str) == expected(rows, [])


def test_removal(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven")]
    rows = [(1, "Keep this. One two three four five six seven eight nine ten, and that."), (2, "one two three"), (3, None)]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    spans = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, mode="span").collect()}
    assert spans == {1: "Keep this. , and that.", 2: "one two three", 3: None}


def test_no_python_on_the_main_path(spark):
    rows, items = corpus()
    plan = decontam.contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
