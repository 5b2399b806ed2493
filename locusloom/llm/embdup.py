"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector o is turned by a random rotation into at least ``CODE`` dimensions; its code holds the signs, that is the
corner x of the cube [-1/sqrt(D), 1/sqrt(D)]^D nearest to it, and its correction factor is <x, o>. For another unit vector q,
<x, q> / <x, o> estimates <o, q> without bias. q's turned coordinates are kept in four bits, rounded by a random
dither, so that the estimate is a sum of bit counts. Its error is below e * sqrt(((1 - <x, o>^2) / (D - 1) + step^2 / 6) / <x, o>^2)
but for a chance that falls as exp(-e^2 / 2). Only codes and factors travel to where candidates meet: pairs whose
estimate plus this bound (e = ``ERROR``) reaches the threshold get their vectors and are recomputed in
double precision; the others cannot be links.

Which pairs are looked at is decided by cross-polytope hashes: of a vector's coordinates under a further rotation, the
largest one and its sign. Some of these make a band, and vectors that share a band meet. Their number in a band grows with the
logarithm of the number of vectors, and the number of bands is such that a pair at the threshold misses all of
them with a chance of ``MISS``. Equal vectors are one class and never expanded into pairs. Large buckets are
dealt out in pairs of blocks, and a pair counts in the first band that it shares. A cell of blocks with many pairs above the bound
isn't listed as pairs: the vectors of its members follow them there, and the task returns sums and a spanning forest.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links;
vectors of different lengths never link; a component's name is the least vec_id in it; repeated
rows link with each other and are each answered; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import cut
from locusloom.llm.components import connected_components

ERROR, MISS, BLOCK = 5.0, 1e-4, 1024
#: Dimensions of a code at least, and coordinates that a hash compares at most.
CODE, COMPARED = 256, 64
#: Bits of the coordinates of the other vector of a pair.
PLANES = 4
#: A cell with more pairs than this for each member gets its members' vectors instead of a list.
LISTED = 8
#: Pairs estimated at a time, and rows that are hashed at a time.
PAIRS, ROWS = 1 << 17, 1 << 10
#: Shared buckets that all tasks are given; beyond, the join shuffles.
BROADCAST_BUCKETS = 2_000_000


@lru_cache(maxsize=64)
def plan_bands(n: int, dim: int, threshold: float) -> tuple[int, int, int]:
    """(coordinates that a hash compares, hashes in a band, bands) for n vectors."""
    compared = min(dim, COMPARED)
    rng = np.random.Generator(np.random.PCG64(11))
    unit = lambda: _unit(rng.standard_normal((20_000, dim)))
    one, other = unit(), unit()
    other = _unit(other - (other * one).sum(axis=1, keepdims=True) * one) if dim > 1 else one
    other = threshold * one + math.sqrt(1 - threshold**2) * other if dim > 1 else one
    hit = (_largest(one[:, None, :compared]) == _largest(other[:, None, :compared])).mean()
    bits = min(32, max(8, math.ceil(math.log2(max(n, 2))) + 4))
    hashes = max(1, math.ceil(bits / math.log2(2 * compared)))
    together = min(hit, 1.0) ** hashes
    return compared, hashes, 1 if together >= 1 - MISS else math.ceil(math.log(MISS) / math.log1p(-together))


def _largest(x: np.ndarray) -> np.ndarray:
    """Of rows of coordinates, in the last axis, which is the largest by size, with its sign."""
    at = np.abs(x).argmax(axis=-1)
    return 2 * at + (np.take_along_axis(x, at[..., None], -1)[..., 0] < 0)


@lru_cache(maxsize=2)
def _rotation(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes' rotation and the dither of their coordinates."""
    rng = np.random.Generator(np.random.PCG64([dim, 7]))
    size = max(CODE, -(-dim // 64) * 64)
    return np.linalg.qr(rng.standard_normal((size, size)))[0][:dim], rng.random(size)


@lru_cache(maxsize=2)
def _directions(dim: int, compared: int, hashes: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64([dim, 8]))
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, compared)))[0] for _ in range(hashes)], axis=1).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _fixed(column: pa.Array | pa.ChunkedArray, dtype: type) -> np.ndarray:
    """A binary column whose values have equal lengths, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _words(x: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """The band hashes (32 bits each) of unit vectors."""
    dim = x.shape[1]
    compared, hashes, bands = plan_bands(n, dim, threshold)
    turned = x.astype(np.float32) @ _directions(dim, compared, hashes * bands)
    found = _largest(turned.reshape(len(x), bands, hashes, compared)).astype(np.uint64)
    key = np.full((len(x), bands), dim, np.uint64)
    for k in range(hashes):
        key = (key ^ (found[:, :, k] + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return (key >> np.uint64(16)).astype(np.uint32)


def _codes(x: np.ndarray) -> dict[str, np.ndarray]:
    """Of unit vectors: code, its factor, and coordinates in ``PLANES`` bits with what turns them back."""
    turn, dither = _rotation(x.shape[1])
    turned = x @ turn
    size = turned.shape[1]
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / ((1 << PLANES) - 2), 1e-12)
    level = np.floor((turned - low[:, None]) / step[:, None] + dither).astype(np.uint8)
    planes = [np.packbits((level >> j) & 1, axis=1) for j in range(PLANES)]
    return {
        "code": np.packbits(turned >= 0, axis=1),
        "planes": np.concatenate(planes, axis=1),
        "factor": np.abs(turned).sum(axis=1) / math.sqrt(size),
        "low": low,
        "step": step,
        "total": size * low + step * level.sum(axis=1, dtype=np.int64),
    }


def _estimate(own: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of pairs of rows, estimated by bit counts, and the bound of their error."""
    code = own["code"][a]
    size = code.shape[1] * 64
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
    planes = own["planes"][b].reshape(len(b), PLANES, -1)
    counts = np.bitwise_count(planes & code[:, None, :]).sum(axis=2, dtype=np.int64)
    step, factor = own["step"][b], own["factor"][a]
    met = own["low"][b] * ones + step * (counts @ (1 << np.arange(PLANES)))
    estimate = (2 * met - own["total"][b]) / math.sqrt(size) / factor
    return estimate, ERROR * np.sqrt(np.maximum(1 - factor**2, 0) / (size - 1) + step**2 / 6) / factor


_CODED = "cid long, dim int, code binary, planes binary, factor double, low double, step double, total double, words binary, keys array<long>"


def _encode(n: int, threshold: float):
    """cid, dim, embedding -> the codes, and the keys of all bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binary = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                same = batch.filter(pa.array(dims == dim))
                for at in range(0, same.num_rows, ROWS):
                    own = same.slice(at, ROWS)
                    x = _unit(_matrix(own.column("embedding")))
                    codes, words = _codes(x), _words(x, n, threshold)
                    bands = words.shape[1]
                    keys = (np.arange(bands, dtype=np.int64) << 32) | words.astype(np.int64)
                    lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.reshape(-1))
                    numbers = [pa.array(codes[c]) for c in ("factor", "low", "step", "total")]
                    columns = [own.column("cid"), own.column("dim"), binary(codes["code"]), binary(codes["planes"]), *numbers, binary(words), lists]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _CODED.split(", ")])

    return run


_CELL = ("key", "i", "j")


def _in_cells(work):
    """Rows sorted by dim and cell -> ``work`` on tables of whole cells of one length of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            marks = np.stack([held.column(c).to_numpy() for c in ("dim", *_CELL)], axis=1)
            edges = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            if not len(edges):
                continue  # the cell goes on; a cell has 2 * BLOCK rows or little more
            ready, held = held.slice(0, edges[-1]), held.slice(edges[-1])
            yield from by_length(ready)
        if held is not None and held.num_rows:
            yield from by_length(held)

    def by_length(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        dims = rows.column("dim").to_numpy()
        edges = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            yield from work(rows.slice(s, e - s).combine_chunks())

    return run


def _cells(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the number of its cell, and the range of rows that it is paired with."""
    key, i, j, side = (rows.column(c).to_numpy() for c in (*_CELL, "side"))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    cell = np.cumsum(new) - 1
    ends = np.append(np.flatnonzero(new)[1:], len(key))[cell]
    n_left = np.bincount(cell, side == 0).astype(np.int64)
    first_right = np.flatnonzero(new)[cell] + n_left[cell]
    start = np.where(i == j, np.arange(len(key)) + 1, first_right)
    return cell, start, np.where((i == j) | (side == 0), ends, start)


def _pairs(start: np.ndarray, end: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each row with the rows of its range, about ``most`` at a time."""
    count = end - start
    sums = np.cumsum(count)
    at = 0
    while at < len(count):
        before = sums[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sums, before + most, "right")))
        c = count[at:to]
        if c.any():
            a = np.repeat(np.arange(at, to), c)
            yield a, start[a] + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
        at = to


def _first_shared(words: np.ndarray, band: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs share no earlier band than that of their cell."""
    shared = words[a] == words[b]
    return shared.argmax(axis=1) == band[a]


_FOUND = "listed boolean, a long, b long, dim int, key long, i int, j int, side int"


def _candidates(threshold: float, most: int, listed_each: int):
    """Cells of codes -> pairs that the bound doesn't exclude, or the members of cells that have many."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        own = {c: rows.column(c).to_numpy() for c in ("factor", "low", "step", "total")}
        own |= {"code": _fixed(rows.column("code"), np.uint64), "planes": _fixed(rows.column("planes"), np.uint64)}
        words, cid = _fixed(rows.column("words"), np.uint32), rows.column("cid").to_numpy()
        band = rows.column("key").to_numpy() >> 32
        cell, start, end = _cells(rows)
        left, right = [], []
        for a, b in _pairs(start, end, most):
            estimate, bound = _estimate(own, a, b)
            near = estimate + bound >= threshold
            a, b = a[near], b[near]
            first = _first_shared(words, band, a, b)
            left.append(a[first])
            right.append(b[first])
        a = np.concatenate(left) if left else np.zeros(0, np.int64)
        b = np.concatenate(right) if right else a
        n = int(cell[-1]) + 1
        many = np.bincount(cell[a], minlength=n) > listed_each * np.bincount(cell, minlength=n)
        met = np.zeros(len(cell), bool)
        met[a], met[b] = True, True
        member = np.flatnonzero(met & many[cell])
        listed = ~many[cell[a]]
        a, b = a[listed], b[listed]
        at = np.concatenate([a, member])
        columns = [pa.array(np.arange(len(at)) < len(a)), pa.array(cid[at]), pa.array(np.concatenate([cid[b], cid[member]]))]
        columns += [rows.column(c).combine_chunks().take(pa.array(at)) for c in ("dim", *_CELL, "side")]
        if len(at):
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _FOUND.split(", ")])

    return _in_cells(work)


def _exact(threshold: float):
    """Pairs with their vectors -> (cid, links, other) of those at or above the threshold, told from both ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                x, y = _unit(_matrix(rows.column("xa"))), _unit(_matrix(rows.column("xb")))
                rows = rows.filter(pa.array(np.einsum("ij,ij->i", x, y) >= threshold))
                a, b, ca, cb = (rows.column(c) for c in ("a", "b", "ca", "cb"))
                joined = [pa.concat_arrays(p) for p in ((a, b), (cb, ca), (b, a))]
                yield pa.RecordBatch.from_arrays(joined, names=["cid", "links", "other"])

    return run


def _dense(threshold: float, most: int):
    """Cells of vectors -> (cid, links, other): weights of partners found, and a spanning forest."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        x = _unit(_matrix(rows.column("embedding")))
        words, band = _fixed(rows.column("words"), np.uint32), rows.column("key").to_numpy() >> 32
        copies, cid = rows.column("copies").to_numpy(), rows.column("cid").to_numpy()
        _, start, end = _cells(rows)
        links, least, kept = np.zeros(len(x)), cid.copy(), []
        for a, b in _pairs(start, end, most):
            near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            a, b = a[near], b[near]
            first = _first_shared(words, band, a, b)
            a, b = a[first], b[first]
            links += np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
            kept.append((a, b))
        while True:
            before = least.copy()
            for a, b in kept:
                low = np.minimum(least[a], least[b])
                np.minimum.at(least, a, low)
                np.minimum.at(least, b, low)
            if (least == before).all():
                break
        has = links > 0
        columns = [pa.array(c) for c in (cid[has], links[has].astype(np.int64), least[has])]
        yield pa.RecordBatch.from_arrays(columns, names=["cid", "links", "other"])

    return _in_cells(work)


def _dealt(members: DataFrame) -> DataFrame:
    """Members (cid, dim, key, blocks) of shared buckets -> the cells (i, j, side) of pairs of blocks that they are in."""
    members = members.withColumn("_mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    mine = F.col("_mine")
    left = F.transform(every, lambda y: F.when(mine <= y, F.struct(mine.alias("i"), y.alias("j"), F.lit(0).alias("side"))))
    right = F.transform(every, lambda x: F.when(x < mine, F.struct(x.alias("i"), mine.alias("j"), F.lit(1).alias("side"))))
    cells = members.select("cid", "dim", "key", F.explode(F.array_compact(F.concat(left, right))).alias("_c"))
    return cells.select("cid", "dim", "key", "_c.i", "_c.j", "_c.side")


def _together(cells: DataFrame) -> DataFrame:
    return cells.repartition("dim", *_CELL).sortWithinPartitions("dim", *_CELL, "side")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """A row for each vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select("vec_id", "embedding")
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value
    zero = F.transform(e, lambda x: F.when(x == 0, F.abs(x)).otherwise(x))
    rows = rows.withColumn("embedding", F.when(good, zero)).withColumn("_h", F.xxhash64("embedding"))
    classes = rows.where(F.col("embedding").isNotNull()).groupBy("_h", "embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("dim", F.size("embedding")).withColumn("cid", F.monotonically_increasing_id()))
    n = classes.count()
    coded = cut(classes.select("cid", "dim", "embedding").mapInArrow(_encode(n, threshold), _CODED))
    members = coded.select("cid", "dim", F.explode("keys").alias("key"))
    shared = cut(members.groupBy("dim", "key").agg(F.count("*").alias("m")).where("m > 1").select("dim", "key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_BUCKETS else shared
    cells = _dealt(members.join(shared, ["dim", "key"]))
    codes = coded.drop("keys", "dim")
    found = cut(_together(cells.join(codes, "cid")).mapInArrow(_candidates(threshold, PAIRS, LISTED), _FOUND))
    side = lambda s: classes.select(F.col("cid").alias(s), F.col("embedding").alias(f"x{s}"), F.col("copies").alias(f"c{s}"))
    pairs = found.where("listed").select("a", "b", "dim").join(side("a"), "a").join(side("b"), "b")
    crowded = found.where("not listed").select(F.col("a").alias("cid"), "dim", *_CELL, "side")
    crowded = crowded.join(classes.select("cid", "embedding", "copies"), "cid").join(coded.select("cid", "words"), "cid")
    schema = "cid long, links long, other long"
    links = cut(pairs.mapInArrow(_exact(threshold), schema).unionByName(_together(crowded).mapInArrow(_dense(threshold, PAIRS), schema)))
    sums = links.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected_components(links.select(F.col("cid").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "cid")
    known = classes.select("cid", "_h", "embedding", "least_id", "copies").join(sums, "cid", "left").join(parts, "cid", "left")
    known = known.withColumn("component", F.coalesce("component", "cid"))
    names = known.groupBy("component").agg(F.min("least_id").alias("_name"))
    labels = known.join(names, "component").select("_h", F.col("embedding").alias("_e"), "_name", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_links"))
    out = rows.join(labels, (F.col("embedding") == F.col("_e")) & (rows["_h"] == labels["_h"]), "left")
    name = F.when(F.col("embedding").isNull(), F.col("vec_id")).otherwise(F.col("_name"))
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"), F.col("vec_id").eqNullSafe(name).alias("kept"))
