"""Language-model scores by online logistic context mixing.

A text is a sequence of tokens: its words, after A-Z is lower-cased, then one end. Each token is coded in
binary decisions. The most frequent words, the end and ``CLASSES`` classes of other
words are leaves of a Huffman tree of the training counts; for each step down the tree, predictors
in hashed contexts (none, one and two tokens before) give odds from the bits they have seen. The odds
are combined in the logistic domain by weights that the predictors' confidence gates, and an
adaptive probability map refines the result. A word of a class is then given by its discounted
share of the class; what the discount leaves is the probability of a word that was never seen, which
counts as one event for each class, so that scores compare with counts that are smoothed for one unknown
word. For the bits per byte such a word is spelled too: its bits are predicted by another mixer in
contexts of two and four bytes within the word. So the probabilities of all texts add up to no more than
one, and -log2 of it, divided by the text's bytes, is the bits per byte.

Tasks learn online: they predict a small batch, then adjust weights, map and counts by it. The learners'
counts are summed and their weights averaged, so all training documents take part. How many words have contexts of their own,
and the tables of contexts, grow with the square root of the training tokens (see :func:`sizes`). The vocabulary, with exact counts, grows with the corpus and is never sent
anywhere as a whole: tasks score blocks of documents as far as the ``KNOWN`` most frequent words go and
write what is left, the hashes of the block's rarer words and which tokens they are; a join by hash then
brings the blocks their counts. Texts are never shuffled.

Defined results: a null or blank text is one end; doc_ids whose crc32, as text, leaves 1 modulo 5 are held
out and never learned from, a null doc_id is learned from; repeated rows are learned repeatedly and
each answered; without training documents all counts are 0; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import shared_dir
from locusloom.llm.textcols import mix, span_hashes, word_spans

CLASSES = 16
#: Bytes before, within the word, that the contexts of its spelling hold.
ORDERS = (2, 4)
#: Bits of a table's slots at least, and bytes of training text that a task learns from.
SLOT_BITS, LEARN_BYTES = 20, 64 << 20
BATCH = 1 << 15
#: Words that are spelled at a time, texts whose runs of symbols are told apart at a time, and runs whose bits are coded at a time.
SPELLED, TEXTS, RUNS = 1 << 14, 1024, 1 << 15
BLOCK_BYTES = 4 << 20
#: Bytes, of one word or of many, whose spelling is told apart at a time.
SPELL_BYTES = 1 << 18
#: Most frequent words whose counts all tasks are given.
KNOWN = 1 << 16
#: Bits of a learner's memory of the words that it has spelled, and hashes that a task holds before it passes them on.
SPELLED_BITS, HELD = 23, 1 << 21
#: The hash that stands for the end of a text.
END = np.uint64(1)
LEVELS, CELLS = 4, 33


def sizes(tokens: int) -> tuple[int, int]:
    """The number of words with contexts of their own, and the bits of a table's slots, for so many training tokens."""
    bits = min(20, max(10, round(math.log2(max(tokens, 1)) / 2)))
    return 1 << bits, max(SLOT_BITS, min(24, bits + 7))


def _slots(hashes: list[np.ndarray], slot_bits: int) -> np.ndarray:
    """Rows of slots for bits, by the hashes of context and node together, in each context's table."""
    out = np.empty((len(hashes), len(hashes[0])), np.int64)
    for i, h in enumerate(hashes):
        np.add((h >> np.uint64(64 - slot_bits)).view(np.int64), i << slot_bits, out=out[i])
    return out


def _odds(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.log((one + np.float32(0.4)) / (zero + np.float32(0.4)))


def _level(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How sure a slot is of its odds."""
    return np.minimum(np.log2(1 + zero + one) / 2, LEVELS - 1)


def _mixed(odds: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability that the gated odds of all contexts give, and its cell of the map."""
    x = weights[0][gate] * odds[0]
    for w, o in zip(weights[1:], odds[1:], strict=True):
        x += w[gate] * o
    np.clip(x, -12, 12, out=x)
    return 1 / (1 + np.exp(-x)), gate * CELLS + np.rint((np.clip(x, -8, 8) + 8) * ((CELLS - 1) / 16)).astype(np.intp)


class Mixer:
    """Bit predictors in hashed contexts, their gated mixing and its adaptive refinement, as they learn."""

    def __init__(self, contexts: int, slot_bits: int = SLOT_BITS) -> None:
        self.k, self.slot_bits = contexts, slot_bits
        #: Both counts of a slot stand side by side, as one number's parts, so that they are fetched together.
        self.pairs = np.zeros(contexts << slot_bits, np.complex128)
        self.seen = self.pairs.view(np.float64).reshape(-1, 2).T
        self.weights = np.full((LEVELS * LEVELS, contexts), 1.2 / contexts)
        self.map = np.zeros((2, LEVELS * LEVELS * CELLS))
        self.bits = 0.0

    def learn(self, slots: np.ndarray, bits: np.ndarray, times: np.ndarray) -> None:
        counts = self.pairs.view(np.float64)
        for i in range(0, len(bits), BATCH):
            s, b, t = slots[:, i : i + BATCH], bits[i : i + BATCH], times[i : i + BATCH].astype(np.float64)
            seen = self.pairs[s]
            zero, one = seen.real.astype(np.float32), seen.imag.astype(np.float32)
            odds, level = _odds(zero, one), _level(zero[-2:], one[-2:]).astype(np.intp)
            gate = level[0] * LEVELS + level[1]
            p, cell = _mixed(odds, gate, self.weights.T.astype(np.float32))
            error = (b - p) * t
            total = np.bincount(gate, t, len(self.weights)) + 1e-9
            # A step of the size that the curvature of the coding cost allows.
            curved = total + np.bincount(gate, t * (odds * odds).sum(axis=0), len(self.weights)) / 4
            rate = 0.5 * np.minimum(total / 256, 1) / curved
            for k in range(self.k):
                self.weights[:, k] += rate * np.bincount(gate, error * odds[k], len(self.weights))
            cells = self.map.shape[1]
            self.map += np.bincount(cell + b * cells, t, 2 * cells).reshape(2, cells)
            for row in s:
                np.add.at(counts, 2 * row + b, t)
            self.bits += t.sum()

    def rows(self, name: str) -> list[tuple[str, int, bytes]]:
        """The tables in pieces that can be added up."""
        flat = np.concatenate([self.seen.ravel(), self.map.ravel(), (self.weights * self.bits).ravel(), [self.bits]])
        return [(name, i, flat[i : i + (1 << 16)].astype(np.float32).tobytes()) for i in range(0, len(flat), 1 << 16)]


class Learned:
    """The sum of learners' tables, to predict by: each slot's odds and how sure it is of them."""

    def __init__(self, contexts: int, slot_bits: int, pieces: dict[int, bytes]) -> None:
        self.slot_bits = slot_bits
        new, n = Mixer(contexts, 0), contexts << slot_bits
        self.weights, counts = new.weights, new.map
        self.odds, self.level = np.zeros(n, np.float32), np.zeros(2 << slot_bits, np.uint8)
        if pieces:
            flat = np.concatenate([np.frombuffer(pieces[i], np.float32) for i in sorted(pieces)])
            zero, one, rest = flat[:n], flat[n : 2 * n], flat[2 * n :].astype(np.float64)
            self.odds = _odds(zero, one)
            self.level = _level(zero[-len(self.level) :], one[-len(self.level) :]).astype(np.uint8)
            counts = rest[: counts.size].reshape(counts.shape)
            if rest[-1] > 0:
                self.weights = rest[counts.size : -1].reshape(self.weights.shape) / rest[-1]
        self.ups, self.weights = counts[1].astype(np.float32), self.weights.T.astype(np.float32)
        self.all = (counts[0] + counts[1] + 16).astype(np.float32)

    def log10(self, slots: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """log10 of the probability of each bit."""
        out = np.empty(slots.shape[1])
        before = (len(slots) - 2) << self.slot_bits
        for i in range(0, len(out), BATCH):
            s, b = slots[:, i : i + BATCH], bits[i : i + BATCH]
            level = self.level[s[-2:] - before]
            p, cell = _mixed(self.odds[s], (level[0] * np.uint8(LEVELS) + level[1]).astype(np.intp), self.weights)
            p = np.clip((p + (self.ups[cell] + 16 * p) / self.all[cell]) / 2, np.float32(1e-6), np.float32(1 - 1e-6))
            out[i : i + BATCH] = np.log10(np.where(b, p, 1 - p))
        return out


_SUM_SCHEMA = "name string, at long, data binary"


def _added(learned: DataFrame, contexts: dict[str, tuple[int, int]]) -> dict[str, Learned]:
    """Add up the learners' pieces; the sums have the size of one learner's tables."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("data"):
                part = np.frombuffer(x.as_py(), np.float32).astype(np.float64)
                total = part if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int64()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["name", "at", "data"])

    pieces: dict[str, dict[int, bytes]] = {name: {} for name in contexts}
    for r in learned.groupBy("name", "at").applyInArrow(add, _SUM_SCHEMA).collect():  # of the size of the tables
        pieces[r[0]][r[1]] = bytes(r[2])
    return {name: Learned(k, bits, pieces[name]) for name, (k, bits) in contexts.items()}


def _word_class(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of a word: by its first two bytes."""
    first = data[starts].astype(np.uint64)
    second = np.where(ends - starts > 1, data[np.minimum(starts + 1, len(data) - 1)], 0).astype(np.uint64) if len(starts) else first
    fold = lambda x: np.where((x >= 65) & (x <= 90), x + np.uint64(32), x)
    return (mix(fold(first) * np.uint64(256) + fold(second)) % np.uint64(CLASSES)).astype(np.int64)


class Code:
    """The Huffman tree of symbols: the most frequent words, then the classes, then the end."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        """``counts``: of each word of ``hashes``, of the classes and of the end."""
        order = np.argsort(hashes)
        self.sorted, self.order = hashes[order], order
        self.first_class = len(hashes)
        self.end = len(hashes) + CLASSES
        n = self.end + 1
        heap = [(float(c) + 1, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}
        node = n
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            up[x], up[y] = (node, 0), (node, 1)
            heapq.heappush(heap, (a + b, node))
            node += 1
        nodes, bits, self.length = [], [], np.zeros(n, np.int64)
        for s in range(n):
            path, x = [], s
            while x in up:
                path.append(up[x])
                x = up[x][0]
            nodes += [p[0] for p in reversed(path)]
            bits += [p[1] for p in reversed(path)]
            self.length[s] = len(path)
        self.nodes, self.bits = mix(np.array(nodes, np.uint64) + np.uint64(77)), np.array(bits, np.int64)
        self.alone = mix(self.nodes)
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]])

    def symbols(self, hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return self.first_class + classes
        i = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[i] == hashes, self.order[i], self.first_class + classes)

    def steps(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the symbols' codes one after the other: index of the symbol, node, its hash without context, and bit."""
        length = self.length[symbols]
        of = np.repeat(np.arange(len(symbols)), length)
        at = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length) + self.begin[symbols][of]
        return of, self.nodes[at], self.alone[at], self.bits[at]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most ``TEXTS`` rows and about ``BLOCK_BYTES`` bytes; a longer text is a piece of its own."""
    size = batch.column("bytes").to_numpy()
    at = 0
    while at < len(size):
        n = max(1, int(np.searchsorted(np.cumsum(size[at : at + TEXTS]), BLOCK_BYTES, "right")))
        yield batch.slice(at, n)
        at += n


def _tokens(spans: tuple, code: Code):
    """Symbols of all tokens, ends included, the words' hashes and each row's first token."""
    data, starts, ends, at = spans
    hashes = span_hashes(data, starts, ends)
    of_words = code.symbols(hashes, _word_class(data, starts, ends))
    n = len(at) - 1
    place = np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(at))
    symbols = np.full(len(hashes) + n, code.end)
    symbols[place] = of_words
    all_hashes = np.full(len(symbols), END)
    all_hashes[place] = hashes
    return symbols, all_hashes, at + np.arange(n + 1)


def _runs(symbols: np.ndarray, code: Code) -> np.ndarray:
    """Each token's run of three symbols, as a number.

    The ends of other texts stand before a text's first token.
    """
    n = len(code.length) + 1
    before = np.concatenate([[code.end], symbols[:-1]])
    before2 = np.where(before == code.end, code.end, np.concatenate([[code.end, code.end], symbols[:-2]])[: len(symbols)])
    return (before2 * n + before) * n + symbols


def _steps(runs: np.ndarray, code: Code, slot_bits: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the runs, each with its bits' slots, the bits and the run that a bit is of."""
    n = len(code.length) + 1
    for i in range(0, len(runs), RUNS):
        part = runs[i : i + RUNS]
        of, node, alone, bits = code.steps(part % n)
        one = mix((part // n % n).astype(np.uint64) + np.uint64(1 << 20))
        two = mix(one + (part // (n * n)).astype(np.uint64) + np.uint64(1 << 40))
        yield slice(i, i + len(part)), _slots([alone, mix(one[of] + node), mix(two[of] + node)], slot_bits), bits, of


def _spelling(words: list[bytes], slot_bits: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of the words' bytes, each word followed by a zero byte, the distinct ones with what stands before them, in pieces.

    Slots, bits and the distinct byte that a bit is of; how often each occurs; for all bytes, which
    of the distinct ones they are and the word that they are of. A piece may begin within a word.
    """
    length = np.array([len(w) + 1 for w in words], np.int64)
    ends, flat = np.cumsum(length), np.frombuffer(b"\0".join([*words, b""]), np.uint8)
    for i in range(0, len(flat), SPELL_BYTES):
        at = np.arange(i, min(i + SPELL_BYTES, len(flat)))
        owner = np.searchsorted(ends, at, "right")
        place, byte = at - (ends - length)[owner], flat[at].astype(np.uint64)
        h, contexts = np.zeros(len(at), np.uint64), []
        for d in range(1, max(ORDERS) + 1):
            h = mix(h + np.where(place >= d, flat[np.maximum(at - d, 0)] + np.uint64(1), np.uint64(0)) + np.uint64(d << 10))
            if d in ORDERS:
                contexts.append(h)
        _, first, inverse, times = np.unique(mix(h + byte + np.uint64(1 << 50)), return_index=True, return_inverse=True, return_counts=True)
        contexts, byte = [c[first] for c in contexts], byte[first]
        slots, bits, node = [], [], np.ones(len(first), np.uint64)
        for bit in range(7, -1, -1):
            b = (byte >> np.uint64(bit)) & np.uint64(1)
            of_node = mix(node)
            slots.append(_slots([mix(c + of_node) for c in contexts], slot_bits))
            bits.append(b.astype(np.int64))
            node = node * np.uint64(2) + b
        yield np.concatenate(slots, axis=1), np.concatenate(bits), np.tile(np.arange(len(first)), 8), times, inverse, owner


def _words_at(spans: tuple, at: np.ndarray) -> list[bytes]:
    data, starts, ends, _ = spans
    text = data.tobytes().lower()  # of bytes: A-Z only
    return [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]


def _learned(code: Code, slot_bits: int):
    """Texts to the tables of a learner: of symbols, and of the spelling of each rarer word that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, speller, met = Mixer(3, slot_bits), Mixer(len(ORDERS)), np.zeros(1 << SPELLED_BITS, bool)
        waiting: list[bytes] = []

        def spell() -> None:
            for i in range(0, len(waiting), SPELLED):
                for slots, bits, of, times, _, _ in _spelling(waiting[i : i + SPELLED], speller.slot_bits):
                    speller.learn(slots, bits, times[of])
            waiting.clear()

        for batch in batches:
            for piece in _slices(batch):
                spans = word_spans(piece.column("text"))
                symbols, hashes, _ = _tokens(spans, code)
                runs, times = np.unique(_runs(symbols, code), return_counts=True)
                for at, slots, bits, of in _steps(runs, code, slot_bits):
                    mixer.learn(slots, bits, times[at][of])
                is_word = hashes != END
                rare = np.flatnonzero(symbols[is_word] >= code.first_class)
                values, first = np.unique(hashes[is_word][rare], return_index=True)
                cell = (values >> np.uint64(64 - SPELLED_BITS)).astype(np.int64)
                new = ~met[cell]
                met[cell] = True
                waiting += _words_at(spans, rare[first[new]])
                if len(waiting) >= SPELLED or sum(map(len, waiting)) > BLOCK_BYTES:
                    spell()
        if waiting:
            spell()
        rows = [r for m, name in ((mixer, "symbols"), (speller, "spelling")) if m.bits for r in m.rows(name)]
        if rows:
            names, places, data = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(places, pa.int64()), pa.array(data, pa.binary())], names=["name", "at", "data"])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (h, c, class), counted as far as a task can hold them."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, c, k = (np.concatenate(x) for x in zip(*held, strict=True))
        values, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return values, np.bincount(inverse, c, len(values)).astype(np.int64), k[first]

    def out() -> pa.RecordBatch:
        h, c, k = summed()
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(k.astype(np.int32), pa.int32())], names=["h", "c", "class"])

    for batch in batches:
        for piece in _slices(batch):
            data, starts, ends, _ = word_spans(piece.column("text"))
            if not len(starts):
                continue
            values, first, c = np.unique(span_hashes(data, starts, ends), return_index=True, return_counts=True)
            held.append((values, c, _word_class(data, starts[first], ends[first])))
            if sum(len(x[0]) for x in held) > HELD:
                held[:] = [summed()]
                if len(held[0][0]) > HELD // 2:
                    yield out()
    if held:
        yield out()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


class Shares:
    """What counts tell of a rarer word: its share of its class, and what is left for words not seen."""

    def __init__(self, in_class: list[int], kinds: list[int], discount: float) -> None:
        size = np.array(in_class, float)
        self.size, self.discount = size, min(discount, 0.9)
        self.left = np.where(size > 0, (self.discount * np.array(kinds, float) + 1) / (size + 1), 1.0)

    def log10(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return np.log10(np.where(counts > 0, np.maximum(counts - self.discount, 1 - self.discount) / (self.size[classes] + 1), self.left[classes]))


_BLOCK = """block long, doc_id array<long>, train array<boolean>, bytes array<long>, n_tokens array<int>, n_known array<int>, base array<double>, told array<double>,
    words array<long>, class array<int>, spelling array<binary>, token array<int>, tokens_at array<int>"""


def _begun(code: Code, mixer: Learned, known: tuple[np.ndarray, np.ndarray], ends: int, denominator: float, shares: Shares):
    """Documents to blocks: scores as far as known words go, and the rarer words, with their letters and the tokens that they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        hashes_known, counts_known = known
        for batch in batches:
            for piece in _slices(batch):
                spans = word_spans(piece.column("text"))
                symbols, hashes, at = _tokens(spans, code)
                runs, inverse = np.unique(_runs(symbols, code), return_inverse=True)
                told = np.zeros(len(runs))
                for part_of, slots, bits, of in _steps(runs, code, mixer.slot_bits):
                    told[part_of] = np.bincount(of, mixer.log10(slots, bits), part_of.stop - part_of.start)
                told = told[inverse]
                is_word = hashes != END
                c = np.full(len(hashes), ends, np.int64)
                found = np.minimum(np.searchsorted(hashes_known, hashes), max(len(hashes_known) - 1, 0))
                have = is_word & (hashes_known[found] == hashes) if len(hashes_known) else np.zeros(len(hashes), bool)
                c[have] = counts_known[found[have]]
                known_class = have & (symbols >= code.first_class)
                told[known_class] += shares.log10(c[known_class], symbols[known_class] - code.first_class)
                open_ = is_word & ~have
                base = np.where(open_, 0.0, np.log10((c + 0.5) / denominator))
                sure = ~open_ & (c > 0)
                own = np.flatnonzero(open_)
                values, first, token = np.unique(hashes[own], return_index=True, return_inverse=True)
                words = _words_at(spans, (np.cumsum(is_word) - 1)[own[first]])
                sums = lambda x: np.add.reduceat(x, at[:-1])  # noqa: B023, E731  each text has its end at least
                lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x))
                columns = [
                    pa.array([part], pa.int64()), lists(piece.column("doc_id")), lists(piece.column("train")), lists(piece.column("bytes")), lists(np.diff(at).astype(np.int32)), lists(sums(sure.astype(np.int32)).astype(np.int32)),
                    lists(sums(base)), lists(sums(told)), lists(values.view(np.int64)), lists((symbols[own[first]] - code.first_class).astype(np.int32)), lists(pa.array(words, pa.binary())), lists(token.astype(np.int32)), lists(np.searchsorted(own, at).astype(np.int32)),
                ]
                part += 1
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _BLOCK.replace("\n", " ").split(",")])

    return run


def _spelled(words: list[bytes], mixer: Learned) -> np.ndarray:
    """log10 of the probability of each word's spelling."""
    out = np.zeros(len(words))
    for slots, bits, of, times, inverse, owner in _spelling(words, mixer.slot_bits):
        told = np.bincount(of, mixer.log10(slots, bits), len(times))
        out += np.bincount(owner, told[inverse], len(words))
    return out


def _ended(n_all: int, denominator: float, shares: Shares, speller: Learned):
    """Blocks with the counts (pos, c) of their rarer words to documents. Words that were never seen are spelled."""

    def run(blocks: pa.Table, entries: pa.Table) -> pa.Table:
        flat = lambda name: blocks.column(name).combine_chunks().flatten()  # noqa: E731  one block
        array = lambda name: flat(name).to_numpy(zero_copy_only=False)
        classes = array("class")
        c = np.zeros(len(classes), np.int64)
        c[entries.column("pos").to_numpy()] = entries.column("c").to_numpy()
        token, at = array("token"), array("tokens_at")
        of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        sums = lambda x: np.bincount(of, x[token], len(at) - 1)
        base = array("base") + sums(np.log10((c + 0.5) / denominator))
        told = array("told") + sums(shares.log10(c, classes))
        new, spelled = np.flatnonzero(c == 0), np.zeros(len(classes))
        words = flat("spelling")
        for i in range(0, len(new), SPELLED):
            spelled[new[i : i + SPELLED]] = _spelled(words.take(pa.array(new[i : i + SPELLED])).to_pylist(), speller)
        bits = -(told + sums(spelled)) * math.log2(10)
        size = array("bytes")
        return pa.table({
            "doc_id": flat("doc_id"), "held_out": pa.array(~array("train").astype(bool)), "n_tokens": flat("n_tokens").cast(pa.int64()), "n_known": pa.array(array("n_known") + sums((c > 0).astype(float)).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(size), n_all)), "base_score": pa.array(base), "score": pa.array(told), "bits_per_byte": pa.array(np.where(size > 0, bits / np.maximum(size, 1), 0.0)),
        })

    return run


def score(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    root = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("train", ~held_out(F.col("doc_id"))).withColumn("bytes", F.octet_length("text").cast("long"))
    train = rows.where("train").select("text", "bytes")
    found = train.mapInArrow(_counts, "h long, c long, class int").groupBy("h").agg(F.sum("c").alias("c"), F.first("class").alias("class"))
    found.write.option("compression", "zstd").parquet(f"{root}/vocabulary")
    vocabulary = spark.read.parquet(f"{root}/vocabulary")
    ends, train_bytes = train.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    n_words, v_words, ones, twos = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    known = vocabulary.where("c > 1").orderBy(F.desc("c"), "h").limit(max(KNOWN, 4 * sizes(n_words + ends)[0])).select("h", "c", "class").toArrow()
    symbols, slot_bits = sizes(n_words + ends)
    top = known.slice(0, symbols)
    in_class, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in vocabulary.groupBy("class").agg(F.sum("c"), F.count("*")).collect():
        in_class[r[0]], kinds[r[0]] = r[1], r[2]
    np.subtract.at(in_class, top.column("class").to_numpy(), top.column("c").to_numpy())
    np.subtract.at(kinds, top.column("class").to_numpy(), 1)
    code = Code(top.column("h").to_numpy().view(np.uint64), np.array([*top.column("c").to_pylist(), *in_class, ends], float))
    learners = train.coalesce(max(1, -(-train_bytes // LEARN_BYTES)))
    learned = learners.mapInArrow(_learned(code, slot_bits), _SUM_SCHEMA)
    mixers = _added(learned, {"symbols": (3, slot_bits), "spelling": (len(ORDERS), SLOT_BITS)})
    shares = Shares(in_class.tolist(), kinds.tolist(), ones / (ones + 2 * twos) if ones + twos else 0.5)
    n_all, denominator = n_words + ends, n_words + ends + 0.5 * (v_words + (ends > 0) + 1)
    order = np.argsort(known.column("h").to_numpy().view(np.uint64))
    table = known.column("h").to_numpy().view(np.uint64)[order], known.column("c").to_numpy()[order]
    begun = rows.mapInArrow(_begun(code, mixers["symbols"], table, ends, denominator, shares), _BLOCK)
    begun.write.option("compression", "zstd").parquet(f"{root}/blocks")
    blocks = spark.read.parquet(f"{root}/blocks")
    entries = blocks.select("block", F.posexplode("words").alias("pos", "h")).join(vocabulary.select("h", "c"), "h").select(F.col("block").alias("of"), "pos", "c")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return blocks.drop("words").groupBy("block").cogroup(entries.groupBy("of")).applyInArrow(_ended(n_all, denominator, shares, mixers["spelling"]), schema)
