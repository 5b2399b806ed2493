import random

from locusloom.llm import toxicity as tox
from tests.llm.helpers import documents, held_out

CLEAN = "garden river mountain window table winter summer bread letter morning evening kitchen forest station market".split()
BAD = "dreckhead wurmbrain slimeface".split()


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(CLEAN) for _ in range(rng.randint(10, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def scores(spark, rows, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {(r.doc_id, i): r for i, r in enumerate(tox.toxicity(documents(spark, rows), known).orderBy("doc_id", "score").collect())}


def test_held_out_accuracy_and_misspellings(spark):
    rows, labels = corpus()
    asked = [(1001, "river morning dreckhaed window"), (1002, "market w0rmbrain slimefaced bread"), (1003, "garden river table"), (1004, None), (1005, ""), (None, "river")]
    got = {r.doc_id: r for r in scores(spark, rows + asked + [rows[0]], labels).values()}
    wrong = [i for i, _, t in labels if got[i].predicted != t]
    assert not wrong
    assert got[1001].score > 0.5 and got[1002].score > 0.5
    assert got[1003].predicted == got[1004].predicted == got[1005].predicted == got[None].predicted == 0
    assert got[1].held_out == held_out(1, 3) and got[None].held_out is False


def test_quotation_counts_less(spark):
    model = tox.Model({"=wurmbrain": 5.0}, frozenset(), None)
    matcher = tox.Matcher(model.lexicon)
    said, quoted = matcher.kinds("you wurmbrain go away"), matcher.kinds('they wrote "wurmbrain" on the wall')
    assert said[0] > 0 and said[3] > 0 and quoted[0] == 0 and quoted[2] > 0 and quoted[3] == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_the_edit_distance():
    rng = random.Random(3)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 11))) for _ in range(60)]
    matcher = tox.Matcher({"=" + t: 1.0 for t in terms})
    for _ in range(3000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(2, 12)))
        near = any(distance(w, t) <= tox.Matcher.allowed(t) for t in terms)
        assert (matcher._near(w) is not None) == near
        assert (matcher.find(w) is not None) == near  # the pieces lose nothing


def test_copies_teach_nothing(spark):
    """Words of a toxic document that is copied often don't become terms."""
    rows, labels = corpus()
    copy = " ".join(f"odd{k}word" for k in range(20)) + " dreckhead"
    rows += [(5000 + i, copy) for i in range(60)]
    labels += [(5000 + i, 1, 1) for i in range(60)]
    model = tox.learn(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert not any("odd" in t for t in model.lexicon) and "=dreckhead" in model.lexicon


def test_words_of_their_own(spark):
    rows, labels = corpus()
    rows = [(i, t + " wurmtrain" if i % 4 else t) for i, t in rows]
    model = tox.learn(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "wurmtrain" in model.own


def test_degenerate_inputs(spark):
    rows, labels = corpus(40)
    known = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int")
    none = tox.toxicity(documents(spark, rows), known([])).collect()
    assert len(none) == 40 and all(r.score == 0.0 or r.score < 1e-9 for r in none)
    clean = tox.toxicity(documents(spark, rows), known([(i, 1, 0) for i in range(40)] + [(None, 1, 1), (3, 1, None)])).collect()
    assert all(r.predicted == 0 for r in clean)
    assert tox.toxicity(documents(spark, rows).limit(0), known(labels)).count() == 0


def test_rejection_keeps_columns(spark):
    rows, labels = corpus()
    docs = documents(spark, rows)
    out = tox.reject_toxic(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [i for i, _, t in labels if not t]


def test_copies_veto_nothing(spark):
    """A term of independent toxic documents stays one when a copied toxic document holds it too."""
    rows, labels = corpus()
    rng = random.Random(8)
    for i in range(45):
        text = [rng.choice(CLEAN) for _ in range(30)]
        text.insert(rng.randrange(1, 29), "grimmzahn")
        rows.append((6000 + i, " ".join(text)))
    rows += [(7000 + i, "river grimmzahn table " + " ".join(f"odd{k}word" for k in range(20))) for i in range(600)]
    labels += [(i, 1, 1) for i, _ in rows[400:]]
    model = tox.learn(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "=grimmzahn" in model.lexicon and not any("odd" in t for t in model.lexicon)


def test_every_significant_term_is_kept(spark):
    terms = [a + b + c + "xozug" for a in "bdfgklmn" for b in "aeiou" for c in "prst"]
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        text = [rng.choice(CLEAN) for _ in range(40)] + [terms[(i // 4 * 20 + k) % len(terms)] for k in range(20)] * toxic
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    model = tox.learn(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert not [t for t in terms if "=" + t not in model.lexicon]


def test_beginnings_of_long_words():
    matcher = tox.Matcher({"idiot": 3.0, "=" + "wurm" * 10: 2.0})
    assert matcher.find("idiot" * 20) == (3.0, None) and matcher.find("garden" * 20) is None
    assert matcher.find("wurm" * 10 + "x") == (2.0, True) and matcher.find("wurm" * 11) is None


def test_apostrophes_are_no_quotation():
    matcher = tox.Matcher({"=wurmbrain": 3.0})
    plain = matcher.kinds("you're a wurmbrain and that's it")
    assert matcher.kinds("you’re a wurmbrain and that’s it") == plain and plain[0] > 0 and plain[2] == 0
    assert matcher.kinds("so „wurmbrain“ it was")[2] > 0 and matcher.kinds("an ‘old wurmbrain’ of sorts")[2] > 0
    assert matcher.kinds("» wurmbrain «")[2] > 0 and matcher.kinds('" wurmbrain ”')[2] == 0


def test_terms_of_weight_zero_are_found():
    assert tox.Matcher({"=wurmbrain": 0.0, "=wurmbraim": -1.0})._near("wurmbrains") == 0.0


def test_very_long_texts(spark):
    rows, labels = corpus(200)
    asked = [(1001, "river " * 200_000 + "wurmbrain dreckhead slimeface " * 3), (1002, "x" * 1_000_000), (1003, "wurmbrain " * 100_000)]
    got = {r.doc_id: r for r in scores(spark, rows + asked, labels).values()}
    assert got[1003].predicted == 1 and 0 <= got[1001].score <= 1 and got[1002].predicted == 0
