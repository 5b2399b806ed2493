"""Toxicity scores from a learned lexicon, Levenshtein automata and context windows.

The lexicon is learned from labelled documents: whole words, and beginnings of words, that occur in
significantly more toxic than clean documents. Whole words make a trie; the Levenshtein automaton of a
document's word is run along the trie's branches, which finds all terms within its distance and so catches
misspellings. Each hit is looked at in its context window: a hit in quotation marks or after a verb
of reporting counts as quoted, an address to a person as abuse. A logistic model, fitted to the
labels, turns the sums of the hits' weights by kind into a score.

Learning takes at most ``fit_rows`` labelled documents, chosen by a hash of doc_id, and each of their texts
once, so that copies neither teach nor veto a term; every document is scored as a whole. Texts alone make the score.

Defined results: null and empty texts score as texts without hits; repeated rows get equal
scores; labels that are null, or whose documents are missing, are ignored, and of contradicting labels
of a document or a text the greater counts; without labelled documents of both kinds every score is the share of toxic labels
(0 if there are none); further columns are ignored by :func:`toxicity` and kept by :func:`reject_toxic`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from locusloom.llm.common import own_columns

#: Words, with the marks that hide letters inside them.
WORD = re.compile(r"[^\W_]+(?:[@$!*][^\W_]+)*")
LEET = str.maketrans("013457@$!", "oieastasi")
#: Marks that open a quotation, each with those that close it; between letters they are apostrophes.
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’"}
APOSTROPHE = re.compile(r"(?<=\w)[‘’](?=\w)")
#: Verbs and nouns of reporting in the four languages: what follows is told, not said.
REPORTS = frozenset("said says wrote writes called quote quoted dit écrit cite citation sagte schrieb zitat dijo escribió cita".split())
#: Words that address a person.
ADDRESS = frozenset("you your u tu toi vous du dich ihr sie usted ustedes vos eres".split())
WINDOW = 6
PREFIXES = range(4, 8)
KINDS = 9
MIN_G2 = 26.0
#: Least share of toxic documents among those with a whole word, or with a beginning.
MIN_PRECISION, MIN_START_PRECISION = 0.8, 0.8
CACHE = 500_000
#: Letters of a word that can be a term as a whole; longer ones are looked up by beginning and as misspelled terms.
LONG = 40


class Model(NamedTuple):
    """Terms with their weights, words that resemble terms but are words of their own, and the weights of kinds of hits."""

    lexicon: dict[str, float]
    own: frozenset[str]
    weights: list[float] | None


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of words ("=word") and beginnings of longer words, by label."""
    for batch in batches:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found: set[str] = set()
            for w in set(WORD.findall((text or "").lower())):
                found.update(["=" + w] * (len(w) <= LONG), (w[:n] for n in PREFIXES if n < len(w)))
            counts[1 if toxic else 0].update(found)
        terms = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (counts[1], counts[0]))]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "clean"])


def choose_terms(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """The lexicon, term to weight, among terms with their counts of toxic and clean documents."""
    counts = {t: (a, b) for t, a, b in rows}
    kept: dict[str, float] = {}
    extended: Counter = Counter()  # the most that one extension has of a beginning's toxic documents
    for t, (a, _) in counts.items():
        parent = t[1:-1] if t[0] == "=" else t[:-1]
        extended[parent] = max(extended[parent], a)
    for t in sorted(counts, key=lambda t: (len(t.lstrip("=")), t)):
        a, b = counts[t]
        word = t[0] == "="
        if word:
            if any(t[1 : n + 1] in kept and a < 0.5 * counts[t[1 : n + 1]][0] for n in PREFIXES):
                continue
        elif any(t[:n] in kept for n in range(min(PREFIXES), len(t))) or extended[t] >= 0.9 * a:
            continue
        kept[t] = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
    return kept


class Matcher:
    """Finds terms of the lexicon in words, exactly, by beginning or misspelled."""

    def __init__(self, lexicon: dict[str, float], own: frozenset[str] = frozenset()) -> None:
        """``own``: words that resemble a term but are words of their own."""
        self.own = own
        self.words = {t[1:]: w for t, w in lexicon.items() if t[0] == "="}
        self.starts = {t: w for t, w in lexicon.items() if t[0] != "="}
        self.lengths = sorted({len(t) for t in self.starts})
        self.trie: dict = {}
        # With at most d edits, one of d + 1 pieces of a term stands unchanged in the word, moved by d at most.
        self.pieces: dict[str, dict[int, set[str]]] = {}
        for term in self.words:
            d = self.allowed(term)
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            cuts = [i * len(term) // (d + 1) for i in range(d + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                at = self.pieces.setdefault(term[a:b], {})
                for i in range(max(0, a - d), a + d + 1):
                    at.setdefault(i, set()).add(term)
        self.longest = max((len(t) + self.allowed(t) for t in self.words), default=0)
        by_length: dict[int, set[int]] = {}
        for piece, places in self.pieces.items():
            by_length.setdefault(len(piece), set()).update(places)
        self.places = [(n, sorted(at)) for n, at in sorted(by_length.items())]
        self.cache: dict[str, tuple[float, bool | None] | None] = {}

    @staticmethod
    def allowed(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    def _near(self, word: str, trie: dict | None = None) -> float | None:
        """The greatest weight of a term within its distance: the word's automaton along the trie, or along a part of it.

        Bit i of level d is the state in which i letters of the word are read with d edits at most.
        """
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        last = 1 << len(word)
        whole = 2 * last - 1
        best = None
        stack = [(self.trie if trie is None else trie, 1, 3 & whole, 7 & whole)]
        while stack:
            node, r0, r1, r2 = stack.pop()
            term = node.get("")
            if term is not None and ((r0, r1, r2)[self.allowed(term)] & last):
                best = max(self.words[term], -math.inf if best is None else best)
            for c, child in node.items():
                if c == "":
                    continue
                m = at.get(c, 0)
                n0 = (r0 & m) << 1
                # A letter of the term is read, exchanged or left out; then letters of the word are skipped.
                n1 = ((r1 & m) << 1 | r0 << 1 | r0 | n0 << 1) & whole
                n2 = ((r2 & m) << 1 | r1 << 1 | r1 | n1 << 1) & whole
                if n2:
                    stack.append((child, n0, n1, n2))
        return best

    def _look_up(self, word: str) -> tuple[float, bool | None] | None:
        """(weight, whether misspelled; None for a beginning) or None."""
        if (w := self.words.get(word)) is not None:
            return w, False
        for n in self.lengths:
            if n < len(word) and (w := self.starts.get(word[:n])) is not None:
                return w, None
        if word in self.own or len(word) > self.longest:
            return None
        plain = word.translate(LEET)
        if plain != word and (w := self.words.get(plain)) is not None:
            return w, True
        trie: dict = {}  # of the terms that have a piece in the word
        for n, places in self.places:
            for a in places:
                for term in self.pieces.get(plain[a : a + n], {}).get(a, ()):
                    if abs(len(term) - len(plain)) <= self.allowed(term):
                        node = trie
                        for c in term:
                            node = node.setdefault(c, {})
                        node[""] = term
        return None if not trie or (w := self._near(plain, trie)) is None else (w, True)

    def find(self, word: str) -> tuple[float, bool | None] | None:
        if len(word) > LONG:  # rare, and too long to be kept
            return self._look_up(word)
        try:
            return self.cache[word]
        except KeyError:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = found = self._look_up(word)
            return found

    def kinds(self, text: str | None) -> list[float]:
        """Of plain, misspelled, quoted and addressed hits the weights' sums, the greatest and their density.

        Then the number and density of beginnings, and the length of a text that has any: clean
        texts hold some beginnings by chance, toxic ones many for their length.
        """
        out = [0.0] * KINDS
        if not text:
            return out
        text = text.lower()
        words = WORD.findall(text)
        if not any(self.find(w) for w in set(words)):
            return out
        spans = [m.span() for m in WORD.finditer(text)]
        marks = APOSTROPHE.sub("'", text)
        for i, w in enumerate(words):
            if (hit := self.find(w)) is None:
                continue
            weight, misspelled = hit
            if misspelled is None:
                out[6] += 1
                continue
            around = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            first, last = max(0, i - WINDOW), min(len(words), i + 1 + WINDOW)
            before = marks[spans[first - 1][1] if first else 0 : spans[i][0]]
            after = marks[spans[i][1] : spans[last][0] if last < len(words) else len(marks)]
            paired = any(o in before and any(c in after for c in ends) for o, ends in QUOTES.items())
            quoted = paired or any(x in REPORTS for x in words[first:i])
            out[2 if quoted else 1 if misspelled else 0] += weight
            out[3] += weight * any(x in ADDRESS for x in around) * (not quoted)
            out[4] = max(out[4], weight * (0.5 if quoted else 1))
        out[5] = 100 * sum(out[:3]) / max(len(words), 1)
        out[7] = 100 * out[6] / max(len(words), 1)
        out[8] = len(words) * (out[6] > 0)
        return [math.log1p(max(x, 0.0)) for x in out]


def _resembling(lexicon: dict[str, float]):
    """Those terms ("=word") that would count as misspelled terms of the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            words = [t[1:] for t in batch.column("term").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([w for w in words if (hit := matcher.find(w)) and hit[1]], pa.string())], names=["word"])

    return run


def _scored(model: Model):
    """Texts to scores, or, without weights, to their kinds of hits."""
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.lexicon, model.own)
        for batch in batches:
            x = np.array([matcher.kinds(t.as_py()) for t in batch.column("text")]).reshape(-1, KINDS)
            others = [c for c in batch.schema.names if c != "text"]
            if weights is None:
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, KINDS, dtype=np.int32), x.reshape(-1))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [lists], names=[*others, "kinds"])
            else:
                score = 1 / (1 + np.exp(-np.clip(x @ np.array(weights[1:]) + weights[0], -40, 40)))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(score)], names=[*others, "score"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Weights, the bias first, by damped Newton steps; none but the length's is negative.

    Misspelled hits are rare: their weight is drawn to that of plain ones, the others to 0.
    """
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    pull = np.diag(np.full(len(w), ridge))
    pull[0, 0] = 1e-3
    pull[1:3, 1:3] += [[ridge, -ridge], [-ridge, 0]]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - y) + pull @ w)
        w = w - 0.5 * step
        w[1:-1] = np.maximum(w[1:-1], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> Model:
    """The model of the labelled documents that aren't held out, ``fit_rows`` at most or so."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))
    rows = docs.select("doc_id", "text").join(known, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")).persist()
    by = {r[0]: r[1] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("t")).count().collect()}
    toxic, clean = by.get(1, 0), by.get(0, 0)
    if not toxic or not clean:
        rows.unpersist()
        share = toxic / max(toxic + clean, 1)
        return Model({}, frozenset(), [math.log(max(share, 1e-12)) - math.log(max(1 - share, 1e-12))] + [0.0] * KINDS)
    a, b, m = F.col("a").cast("double"), F.col("b").cast("double"), float(toxic + clean)
    told = rows.select("text", "toxic").mapInArrow(_terms, "term string, toxic long, clean long")
    counts = told.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    counts = counts.where((F.col("a") > 2) | F.startswith("term", F.lit("="))).persist()
    g2 = 2 * (a * F.log(a / ((a + b) * (toxic / m))) + F.when(b > 0, b * F.log(b / ((a + b) * (clean / m)))).otherwise(0.0))
    least = F.when(F.startswith("term", F.lit("=")), MIN_PRECISION).otherwise(MIN_START_PRECISION)
    chosen = counts.where((F.col("a") > 2) & (a / (a + b) > least)).withColumn("g2", g2).where(F.col("g2") >= MIN_G2)
    top = chosen.select("term", "a", "b").collect()  # significant terms of fit_rows documents at most
    lexicon = choose_terms([tuple(r) for r in top], toxic, clean)
    clean_words = counts.where(F.startswith("term", F.lit("=")) & (F.col("b") > 0) & (F.col("b") >= F.col("a"))).select("term")
    own = frozenset(r[0] for r in clean_words.mapInArrow(_resembling(lexicon), "word string").collect())  # words of the sample that are near a term
    sample = rows.select("toxic", "text").mapInArrow(_scored(Model(lexicon, own, None)), "toxic int, kinds array<double>").collect()  # fit_rows at most
    rows.unpersist()
    counts.unpersist()
    x, y = np.array([r[1] for r in sample]).reshape(-1, KINDS), np.array([float(r[0] > 0) for r in sample])
    return Model(lexicon, own, _logistic(x, y))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = 20_000) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""
    model = learn(docs, labels, fit_rows)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = 20_000) -> DataFrame:
    """``docs`` with its own columns, without the documents that score ``threshold`` or more."""
    # The text passes through the workers once and comes back with its score.
    names = docs.columns
    packed = docs.select(F.struct(*own_columns(names)).alias("_row"), F.col("text"))
    schema = StructType([packed.schema["_row"], StructField("score", DoubleType())])
    kept = packed.mapInArrow(_scored(learn(docs, labels, fit_rows)), schema).where(F.col("score") < threshold)
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in names])
