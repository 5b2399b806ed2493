"""Hard negatives for contrastive training, by an orthogonal PCA rotation.

Vectors are made whole numbers, floor(``scale`` * x), and a row's score is its inner product with the anchor. An anchor's
positives are the best ``positives`` other rows of its label; the negatives of a positive are the best ``negatives`` rows of other labels whose
score lies between ``low`` and ``high`` hundredths of the positive's.

A rotation by the principal axes of the whole vectors leaves inner products as they are but puts most of them in the leading
components. A task multiplies those of a block of anchors and a slice of rows first; what the others can add is bounded
by the product of the norms of what is left, and rounding by a slack in proportion to the whole norms. Rows whose upper bound falls short
of what the slice itself proves to be reached (the k-th best lower bound) or of what the task has found before, or whose
bounds miss all windows, are discarded; the others take more components and are bounded again, and the survivors are
verified by products of whole numbers. So results are exact whatever the rotation is: it is fitted on the first ``FIT_ROWS``
rows, for the ``FIT_LENGTHS`` most frequent lengths among them.

The rows are never shuffled: anchors go to all tasks in passes of at most ``PASS_BYTES``, and each pass streams all rows past
them. A task tells the best few of each anchor, which are then ranked over all tasks.

Defined results: rows with a null id, label or vector, or any null or non-finite component take no part; vectors of different lengths
never meet; an empty vector scores 0 with others; components saturate at +-``MOST`` after scaling, so that products fit into 64 bits; rows
that repeat are rows of their own, and an anchor's own row alone is no partner of it; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusloom.llm.common import cut

FIT_ROWS, FIT_LENGTHS, FIT_DIM = 20_000, 4, 1024
PASS_BYTES = 64 << 20
#: Anchors and rows that meet at a time, and pairs that are verified at a time.
ANCHORS, ROWS, PAIRS = 256, 4096, 1 << 16
MOST = 1 << 22
#: Pairs of an anchor, window and slice from which on it is worth looking for a better threshold.
MANY = 16
#: Rounding of single-precision sums, for each component and unit of the norms: eight times what it can be.
SLACK = 2.0**-21

_BEST = "anchor long, slot int, other long, other_id long, score long"


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole vectors -> the sum of their outer products, for each of the most frequent lengths."""
    sums: dict[int, np.ndarray] = {}
    seen: dict[int, int] = {}
    for batch in batches:
        for dim, at in _lengths(batch.column("whole")):
            if dim and dim <= FIT_DIM and (dim in sums or len(sums) < 16 * FIT_LENGTHS):
                x = _matrix(batch.column("whole"), at, dim).astype(np.float64)
                sums[dim] = sums.get(dim, 0) + x.T @ x
                seen[dim] = seen.get(dim, 0) + len(x)
    for dim in sorted(sums, key=lambda d: -seen[d])[:FIT_LENGTHS]:
        columns = [pa.array([dim], pa.int32()), pa.array([sums[dim].tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["dim", "moments"])


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """The principal axes of the first rows, leading ones first, by length."""
    found = rows.select("whole").limit(FIT_ROWS).mapInArrow(_moments, "dim int, moments binary").collect()  # one task, FIT_LENGTHS rows
    out = {}
    for r in found:
        out[r["dim"]] = np.linalg.eigh(np.frombuffer(r["moments"]).reshape(r["dim"], -1))[1][:, ::-1]
    return out


def _lengths(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """The lengths of a list column and the rows that have each."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dim in np.unique(n):
        yield int(dim), np.flatnonzero(n == dim)


def _matrix(column: pa.Array, at: np.ndarray, dim: int) -> np.ndarray:
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(at), dim)


class Side:
    """Vectors of one length with what the bounds need."""

    def __init__(self, row: np.ndarray, ident: np.ndarray, label: np.ndarray, whole: np.ndarray, turn: np.ndarray | None) -> None:
        self.row, self.ident, self.label, self.whole = row, ident, label, whole
        self.scores = self.has = np.zeros((len(row), 0), np.int64)  # of anchors' positives
        x = whole.astype(np.float64)
        x = x if turn is None else x @ turn
        self.turned = x.astype(np.float32)
        # Norms of what is left from each component on, and of the whole.
        squares = np.concatenate([np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1)
        self.left = np.sqrt(squares)
        self.norm = np.sqrt(squares[:, :1])


def _steps(dim: int) -> tuple[int, int]:
    """Components that all pairs take, and that the first survivors take."""
    return -(-dim // 4), -(-dim // 2)


def _rest(x: Side, y: Side, k: int) -> np.ndarray:
    """What the components from ``k`` on and rounding can add to the products of all pairs."""
    slack = (x.whole.shape[1] + 8) * SLACK
    left = np.concatenate([x.left[:, k : k + 1], slack * x.norm], axis=1) @ np.concatenate([y.left[:, k : k + 1], y.norm], axis=1).T
    return (left + 1e-3).astype(np.float32)


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each line, -inf where it has fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf, np.float32)
    return np.partition(values, -k, axis=1)[:, -k]


def _products(x: Side, y: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    parts = [np.einsum("ij,ij->i", x.whole[i[s : s + PAIRS]], y.whole[j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _longer(x: Side, y: Side, i: np.ndarray, j: np.ndarray, product: np.ndarray, k: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs' products with the components from ``k`` to ``to``, and what the others can add."""
    more = [np.einsum("ij,ij->i", x.turned[i[s : s + PAIRS], k:to], y.turned[j[s : s + PAIRS], k:to]) for s in range(0, len(i), PAIRS)]
    slack = (x.whole.shape[1] + 8) * SLACK * x.norm[i, 0] * y.norm[j, 0]
    return product + (np.concatenate(more) if more else 0), x.left[i, to] * y.left[j, to] + slack + 1e-3


def _top(x: Side, y: Side, i: np.ndarray, j: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of pairs, the places of the best ``most`` of each anchor."""
    order = np.lexsort((y.row[j], y.ident[j], -score, i))
    first = np.searchsorted(i[order], i[order])
    return order[np.arange(len(order)) - first < most]


def _told(x: Side, y: Side, i: np.ndarray, j: np.ndarray, score: np.ndarray, slot: int) -> pa.RecordBatch:
    columns = [x.row[i], np.full(len(i), slot, np.int32), y.row[j], y.ident[j], score]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _BEST.split(", ")])


def _reached(x: Side, i: np.ndarray, score: np.ndarray, most: int, floor: np.ndarray) -> None:
    """Raise ``floor`` to the worst of the best ``most`` of those anchors that have so many."""
    full = np.flatnonzero(np.bincount(i, minlength=len(x.row)) == most)
    worst = np.full(len(x.row), np.iinfo(np.int64).max)
    np.minimum.at(worst, i, score)
    floor[full] = np.maximum(floor[full], worst[full])


def _positives(x: Side, y: Side, most: int, floor: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The best rows of each anchor's label in this slice."""
    first, then = _steps(x.whole.shape[1])
    same = (x.label[:, None] == y.label[None, :]) & (x.row[:, None] != y.row[None, :])
    product, rest = x.turned[:, :first] @ y.turned[:, :first].T, _rest(x, y, first)
    proven = np.maximum(_kth(np.where(same, product - rest, -np.inf), most), floor[:, 0])
    i, j = np.nonzero(same & (product + rest >= proven[:, None]))
    longer, left = _longer(x, y, i, j, product[i, j], first, then)
    near = longer + left >= proven[i]
    i, j = i[near], j[near]
    score = _products(x, y, i, j)
    best = _top(x, y, i, j, score, most)
    i, j, score = i[best], j[best], score[best]
    _reached(x, i, score, most, floor[:, 0])
    if len(i):
        yield _told(x, y, i, j, score, 0)


def _negatives(x: Side, y: Side, most: int, floor: np.ndarray, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """The best rows of other labels in each positive's window in this slice."""
    first, then = _steps(x.whole.shape[1])
    other = x.label[:, None] != y.label[None, :]
    product, rest = x.turned[:, :first] @ y.turned[:, :first].T, _rest(x, y, first)
    upper, lower = product + rest, product - rest
    least, proven, maybe = x.scores * (low / 100) - 1e-3, [], np.zeros(other.shape, bool)
    largest = x.scores * (high / 100) + 1e-3
    for s in range(x.scores.shape[1]):
        some = x.has[:, s]
        floors = np.where(some, np.maximum(least[:, s], floor[:, s]), np.inf)
        window = other & (upper >= floors[:, None]) & (lower <= largest[:, s, None])
        if window.sum() > MANY * max(some.sum(), 1):
            inside = window & (lower >= least[:, s, None]) & (upper <= largest[:, s, None])
            floors = np.maximum(floors, _kth(np.where(inside, lower, -np.inf), most))
            window &= upper >= floors[:, None]
        proven.append(floors)
        maybe |= window
    i, j = np.nonzero(maybe)
    longer, left = _longer(x, y, i, j, product[i, j], first, then)
    near = np.zeros(len(i), bool)
    for s, floors in enumerate(proven):
        near |= (longer + left >= floors[i]) & (longer - left <= largest[i, s])
    i, j = i[near], j[near]
    score = _products(x, y, i, j)
    for s in range(x.scores.shape[1]):
        own = x.scores[i, s]
        fits = np.flatnonzero(x.has[i, s] & (low * own <= 100 * score) & (100 * score <= high * own))
        best = fits[_top(x, y, i[fits], j[fits], score[fits], most)]
        _reached(x, i[best], score[best], most, floor[:, s])
        if len(best):
            yield _told(x, y, i[best], j[best], score[best], s)


def _sides(batch: pa.RecordBatch, turns: dict[int, np.ndarray]) -> Iterator[tuple[int, Side]]:
    column = batch.column("whole")
    for dim, at in _lengths(column):
        own = [batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ("row", "vec_id", "label")]
        yield dim, Side(*own, _matrix(column, at, dim), turns.get(dim))


def _anchored(rows: list[tuple], turns: dict[int, np.ndarray], slots: int) -> dict[int, list[Side]]:
    """Blocks of anchors by length; ``has`` tells which of their slots have a positive."""
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r[3]), []).append(r)
    out: dict[int, list[Side]] = {}
    for dim, own in by.items():
        for s in range(0, len(own), ANCHORS):
            part = own[s : s + ANCHORS]
            whole = np.array([r[3] for r in part], np.int64).reshape(len(part), dim)
            columns = [np.array([r[k] for r in part], np.int64) for k in range(3)]
            side = Side(*columns, whole, turns.get(dim))
            side.scores = np.array([[*r[4], *[0] * (slots - len(r[4]))] for r in part], np.int64).reshape(len(part), slots)
            side.has = np.array([[True] * len(r[4]) + [False] * (slots - len(r[4])) for r in part], bool).reshape(len(part), slots)
            out.setdefault(dim, []).append(side)
    return out


def _pass(anchors: Broadcast, turns: dict[int, np.ndarray], slots: int, meet: Callable) -> Callable:
    """Rows -> the best of each slice for the anchors of one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _anchored(anchors.value, turns, slots)
        floors = {(dim, b): np.full((len(x.row), max(slots, 1)), np.iinfo(np.int64).min) for dim, own in blocks.items() for b, x in enumerate(own)}
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                for dim, y in _sides(batch.slice(s, ROWS), turns):
                    for b, x in enumerate(blocks.get(dim, ())):
                        yield from meet(x, y, floors[dim, b])

    return run


def _passes(anchors: DataFrame, rows: DataFrame, turns: dict[int, np.ndarray], slots: int, meet: Callable) -> DataFrame:
    """The rows that ``meet`` tells, over all passes of anchors (row, vec_id, label, whole, scores)."""
    size = anchors.agg(F.count("*"), F.coalesce(F.sum(F.size("whole") * 12 + 64), F.lit(0))).first()
    n = -(-size[1] // PASS_BYTES)
    parts = []
    for k in range(n):
        own = anchors.where(F.pmod(F.xxhash64("row"), F.lit(n)) == k).collect()  # PASS_BYTES or so
        told = anchors.sparkSession.sparkContext.broadcast([tuple(r) for r in own])
        parts.append(cut(rows.mapInArrow(_pass(told, turns, slots, meet), _BEST)))
    return reduce(DataFrame.unionByName, parts, anchors.sparkSession.createDataFrame([], _BEST))


def _whole(x: Column, scale: int) -> Column:
    return F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int")


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """For each anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label (a whole number); ``anchor`` tells which rows are anchors.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    used = vectors.withColumn("_anchor", F.coalesce(anchor, F.lit(False)))
    used = used.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", "_anchor")
    used = used.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & finite)
    used = used.repartition(max(spark.sparkContext.defaultParallelism, used.rdd.getNumPartitions()))
    rows = cut(used.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform(e, lambda x: _whole(x, scale)).alias("whole"), "_anchor"))
    turns = rotations(rows)
    asked, rows = rows.where("_anchor").drop("_anchor"), rows.drop("_anchor")
    none = F.array().cast("array<long>")
    met = _passes(asked.withColumn("scores", none), rows, turns, 0, _meet_positives(positives))
    best = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "other_id", "other")
    first = met.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= positives)
    found = cut(first.select("anchor", (F.col("_k") - 1).alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # A row for each anchor, with ``positives`` scores at most.
    scores = found.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    again = cut(asked.join(scores, asked["row"] == scores["anchor"]).select("row", "vec_id", "label", "whole", "scores"))
    met = _passes(again, rows, turns, positives, _meet_negatives(negatives, low, high))
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = again.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = ranked.join(found, ["anchor", "slot"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _meet_positives(most: int) -> Callable:
    return lambda x, y, floor: _positives(x, y, most, floor)


def _meet_negatives(most: int, low: int, high: int) -> Callable:
    return lambda x, y, floor: _negatives(x, y, most, floor, low, high)
