"""Near-duplicate documents by MinHash bands and odd sketches, confirmed on full shingle sets.

A document's set holds its distinct shingles of ``width`` words; documents are linked if the
Jaccard similarity of their sets is at least ``percent``/100. Equal sets are one class, known by a
128-bit fingerprint. Each class has ``ROWS`` times ``BANDS`` MinHash values; ``ROWS`` of them make a
band, and classes that share a band are candidates (a pair at 0.8 shares none with probability 3e-7).
The bottom-k MinHash sample of ``SAMPLES`` shingles is folded into a parity bitmap, the odd sketch.
The population count of two sketches' XOR is at most the number of sampled shingles that differ; pairs
that differ in more than the threshold allows (for sets that their samples hold whole: at all; else by
six standard deviations) are dropped. What is left is confirmed on the whole sets.

A bucket's classes are first compared with one centre. What the centre joins needs no further
links among itself, so only pairs of different components are compared afterwards: those of small
buckets by a join, those of large ones in blocks inside tasks, where a class names the closest few
of other components first and, where these don't join all, more of them in a next round, until none
is left. So no group is expanded into its pairs, and no link between components is missed. Buckets of
more than ``DEEP`` classes are first dealt by a further band that two classes share, and by a third if need be,
so that a passage of many different texts doesn't bring them all together. What this leaves apart, pairs that share fewer bands
and buckets that three bands leave crowded, is then compared by rare shingles: with shingles in one order, those of
fewest classes first, two similar sets share one among the first of both, as many as the threshold allows
to differ and one. So all similar pairs of the classes of crowded buckets are candidates, whatever bands they share.

Defined results: a null text or one without words has no shingles and no links, and is its own
component; a text with fewer words than ``width`` has one shingle; a component's name is the least
doc_id in it, null only if all its doc_ids are; repeated rows are each answered and belong to one
class; rows that share a doc_id but not a text are told apart; an empty table gives no rows;
further columns are ignored by :func:`near_duplicates` and kept by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import broadcast_if_small, cut, fresh
from locusloom.llm.components import connected_components
from locusloom.llm.textcols import mix, shingle_sets

ROWS, BANDS = 3, 21
SAMPLES, SKETCH_LONGS = 512, 16
#: Buckets up to this size are joined with themselves; the members of larger ones meet in blocks.
SMALL, BLOCK = 16, 4096
#: Buckets beyond this size are dealt by further bands, up to so many together; a path of bands is one number in this base.
DEEP, DEPTH, BASE = 16 * BLOCK, 3, 64
#: Stands for the band where a bucket holds the classes that share a rare shingle.
RARE = -1
FIRST_CLOSEST = 4
#: Tables of classes and pairs are broadcast up to this number of rows of 32 bytes at most.
BROADCAST_ROWS = 1_000_000
_MULTIPLY = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, ROWS * BANDS + 1001, dtype=np.uint64))


def _min_hashes(shingles: np.ndarray) -> np.ndarray:
    best = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048]
        np.minimum(best, (_MULTIPLY[:, None] * part[None, :] + _ADD[:, None]).min(axis=1), out=best)
    return mix(best + _ADD)


def _odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity bitmap of the least hashes of a sorted set."""
    bit = mix(shingles[:SAMPLES]) % np.uint64(64 * SKETCH_LONGS)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes, prints, samples = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64), np.zeros((n, ROWS * BANDS), np.uint64)
            sketches = np.zeros((n, SKETCH_LONGS), np.uint64)
            for i, s in enumerate(shingle_sets(batch.column("text"), width)):
                sizes[i] = len(s)
                if len(s):
                    prints[i] = np.bitwise_xor.reduce(mix(s + np.uint64(len(s)))), np.add.reduce(mix(~s))
                    samples[i], sketches[i] = _min_hashes(s), _odd_sketch(s)
            banded = samples.reshape(n, BANDS, ROWS)
            keys = mix(banded[:, :, 0] + mix(banded[:, :, 1] + mix(banded[:, :, 2])))
            fixed = lambda a, k: pa.ListArray.from_arrays(np.arange(0, k * n + 1, k, dtype=np.int32), a.reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("tk"), pa.array(sizes), pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64)), fixed(keys, BANDS), fixed(sketches, SKETCH_LONGS)],
                names=["doc_id", "tk", "n_shingles", "f1", "f2", "bands", "sketch"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f1, f2, sets = [], [], []
            for s in shingle_sets(batch.column("text"), width):
                f1.append(np.bitwise_xor.reduce(mix(s + np.uint64(len(s)))) if len(s) else np.uint64(0))
                f2.append(np.add.reduce(mix(~s)) if len(s) else np.uint64(0))
                sets.append(s.view(np.int64))
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), np.concatenate(sets) if sets else np.zeros(0, np.int64))
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([as_long(f1), as_long(f2), lists], names=["f1", "f2", "shingles"])

    return run


def _sketch_limit(a, b, percent: int, sqrt, whole):
    """The most that the sketches of sets of a >= b shingles may differ in, if they are similar enough.

    Sets within ``SAMPLES`` are sampled whole, so the bound is exact: the XOR counts no more than
    the sets' difference. Works on columns and on arrays.
    """
    t = percent / 100
    share = t * (a + b) / ((1 + t) * a)  # of the larger set, in both at the least
    mean = SAMPLES + whole(b <= SAMPLES, b, SAMPLES) - 2 * SAMPLES * share
    sampled = mean + 12 * sqrt(SAMPLES * share * (1 - share)) + 4
    return whole(a <= SAMPLES, (100 - percent) * (a + b) / (100.0 + percent) + 1e-6, sampled)


def _passes(percent: int):
    """Whether sizes and sketches of two classes (n, sketch; n2, sketch2) allow a link."""
    popcount = sum((F.bit_count(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("sketch2", F.lit(i)))) for i in range(SKETCH_LONGS)), F.lit(0))
    small, large = F.least("n", "n2"), F.greatest("n", "n2")
    limit = _sketch_limit(large, small, percent, lambda c: F.sqrt(F.greatest(c, F.lit(0.0))), lambda c, x, y: F.when(c, x).otherwise(y))
    return (small * 100 >= large * percent) & (popcount <= limit)


def _whole_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The shingles of the classes of ``ids`` (cid, distinct)."""
    wanted = broadcast_if_small(cut(classes.select("cid", "f1", "f2", "tk").join(broadcast_if_small(ids, BROADCAST_ROWS), "cid")), BROADCAST_ROWS)
    texts = docs.select(F.xxhash64("text").alias("tk"), "text").join(wanted.select("tk"), "tk", "left_semi")
    sets = texts.mapInArrow(_sets(width), "f1 long, f2 long, shingles array<long>")
    return cut(sets.join(wanted, ["f1", "f2"]).dropDuplicates(["cid"]).select("cid", "shingles"))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: classes) whose whole sets are similar enough."""
    sets = _whole_sets(cut(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "cid")), classes, docs, width)
    one = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("_sa"))
    two = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("_sb"))
    both = two.join(broadcast_if_small(pairs.select("a", "b"), BROADCAST_ROWS), "b").join(one, "a").withColumn("_both", F.size(F.array_intersect("_sa", "_sb")))
    return both.where(F.col("_both") * 100 >= percent * (F.size("_sa") + F.size("_sb") - F.col("_both"))).select("a", "b")


def _path(code: int) -> list[int]:
    """The bands by which a bucket was dealt, the last one last."""
    return [*_path(code // BASE - 1), code % BASE] if code >= BASE else [code]


def _cross_pairs(percent: int, closest: int):
    """In a block pair of a bucket: for each class the closest of other components.

    ``more`` tells that a class has further candidates.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left = group[group.side == 0]
        right = left if group.i.iloc[0] == group.j.iloc[0] else group[group.side == 1]
        out = []
        if len(left) and len(right):
            stack = lambda d, c: np.array(d[c].tolist(), np.int64)
            s2, n2, c2, id2, k2 = stack(right, "sketch").view(np.uint64), right.n.to_numpy(), right.component.to_numpy(), right.cid.to_numpy(), stack(right, "bands")
            k1, band = stack(left, "bands"), int(group.band.iloc[0])
            sure1, sure2 = left.sure.to_numpy(), right.sure.to_numpy()
            for i, (s, n, c, cid) in enumerate(zip(stack(left, "sketch").view(np.uint64), left.n, left.component, left.cid, strict=True)):
                small, large = np.minimum(n2, n), np.maximum(n2, n)
                j = np.flatnonzero((c2 != c) & (small * 100 >= large * percent))
                apart = np.bitwise_count(s2[j] ^ s).sum(axis=1)
                near = apart <= _sketch_limit(large[j], small[j], percent, lambda x: np.sqrt(np.maximum(x, 0)), np.where)
                j, apart = j[near], apart[near]
                if band == RARE:  # the rarest common shingle is a sure one of the smaller set
                    new = np.where(n2[j] > n, sure1[i], np.where(n2[j] < n, sure2[j], sure1[i] | sure2[j]))
                else:  # a pair is told where the path is that of the first bands that the two share
                    alike, path = k2[j] == k1[i], _path(band)
                    new = alike[:, path].all(axis=1) & (alike[:, : path[-1]].sum(axis=1) == len(path) - 1)
                j, apart = j[new], apart[new]
                by = np.argsort(apart, kind="stable")[:closest]
                out += [(min(cid, x), max(cid, x), len(j) > closest) for x in id2[j[by]]]
        return pd.DataFrame(out, columns=["a", "b", "more"]).astype({"a": "int64", "b": "int64", "more": "bool"})

    return run


def _opened(held: DataFrame) -> tuple[DataFrame, bool]:
    """Those rows of ``held`` whose bucket has several components and a sure row, with its size m; whether any bucket is beyond ``DEEP``."""
    sizes = held.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.bool_or("sure").alias("_sure"))
    sizes = cut(sizes.where("_lo <> _hi and _sure").select("band", "key", "m"))
    return held.join(broadcast_if_small(sizes, BROADCAST_ROWS), ["band", "key"]), not sizes.where(F.col("m") > DEEP).isEmpty()


def _dealt_deeper(held: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of crowded buckets, once for each later band of their class."""
    crowded = held.where(F.col("m") > DEEP).select("band", "key", "cid", "sure", "component").join(classes.select("cid", "bands"), "cid")
    finer = crowded.select("band", "key", "cid", "sure", "component", F.posexplode("bands").alias("_b", "_k")).where(F.col("_b") > F.col("band") % BASE)
    return finer.select(((F.col("band") + 1) * BASE + F.col("_b")).cast("int").alias("band"), F.xxhash64("key", "_k").alias("key"), "cid", "sure", "component")


def _of_components(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """``buckets`` with each class's component."""
    return buckets.join(broadcast_if_small(parts.withColumnRenamed("node", "cid"), BROADCAST_ROWS), "cid", "left").withColumn("component", F.coalesce("component", "cid"))


def _by_rare_shingles(crowded: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Buckets (band, key, cid, sure) in which all similar pairs of the classes ``crowded`` (cid) meet.

    With all shingles in one order, the first that two similar sets share is among the first n - ceil(t n) + 1
    of either, and among the first n - ceil(2 t n / (1 + t)) + 1, the sure ones, of the smaller.
    """
    each = _whole_sets(crowded, classes, docs, width).select("cid", F.explode("shingles").alias("key"))
    shared = cut(each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    by = F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "key")))
    ordered = each.join(broadcast_if_small(shared, BROADCAST_ROWS), "key", "left").groupBy("cid").agg(by.alias("_by"))
    n = F.size("_by")
    first, sure = n - F.ceil(percent * n / 100) + 1, n - F.ceil(2 * percent * n / (100 + percent)) + 1
    rows = ordered.select("cid", sure.alias("_n"), F.posexplode(F.slice("_by", 1, first.cast("int"))).alias("_i", "_x")).where("_x.c > 1")
    return cut(rows.select(F.lit(RARE).alias("band"), "_x.key", "cid", (F.col("_i") < F.col("_n")).alias("sure")))


def _across(classes: DataFrame, buckets: DataFrame, parts: DataFrame, percent: int, closest: int, rare: bool) -> tuple[DataFrame, bool]:
    """Candidate pairs (a, b, more) of different components that share a bucket; whether any is left to rare shingles.

    Small buckets are told with the first round only, as they are told in full.
    """
    held, crowded = _opened(_of_components(buckets, parts))
    held, deep = cut(held), crowded and not rare
    for _ in range(DEPTH - 1):
        if not deep:
            break
        finer, deep = _opened(cut(_dealt_deeper(held, classes)))
        held = cut(held.where(F.col("m") <= DEEP).unionByName(finer))
    if not rare:
        held = held.where(F.col("m") <= DEEP)
    known = classes.select("cid", "n", "sketch")
    pairs = None
    if closest == FIRST_CLOSEST:
        few = held.where(F.col("m") <= SMALL).select("band", "key", "cid", "component")
        pairs = few.join(few.toDF("band", "key", "cid2", "component2"), ["band", "key"]).where("cid < cid2 and component <> component2").select("cid", "cid2").distinct()
        pairs = pairs.join(known.toDF("cid2", "n2", "sketch2"), "cid2").join(known, "cid").where(_passes(percent)).select(F.col("cid").alias("a"), F.col("cid2").alias("b"), F.lit(False).alias("more"))
    many = held.where(F.col("m") > SMALL).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).join(classes.select("cid", "n", "sketch", "bands"), "cid")
    many = many.withColumn("_mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # A member of block x is in the left side of cells (x, y), y >= x, and in the right side of (x', x), x' < x.
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = F.transform(every, lambda y: F.when(F.col("_mine") <= y, F.struct(F.col("_mine").alias("i"), y.alias("j"), F.lit(0).alias("side"))))
    right = F.transform(every, lambda x: F.when(x < F.col("_mine"), F.struct(x.alias("i"), F.col("_mine").alias("j"), F.lit(1).alias("side"))))
    dealt = many.select("band", "key", "cid", "sure", "component", "n", "sketch", "bands", F.explode(F.array_compact(F.concat(left, right))).alias("_c"))
    dealt = dealt.select("band", "key", "cid", "sure", "component", "n", "sketch", "bands", "_c.i", "_c.j", "_c.side")
    told = dealt.groupBy("band", "key", "i", "j").applyInPandas(_cross_pairs(percent, closest), "a long, b long, more boolean")
    return (told if pairs is None else told.unionByName(pairs)).groupBy("a", "b").agg(F.max("more").alias("more")), crowded


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tk"), "text")
    schema = "doc_id long, tk long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>"
    features = cut(keyed.mapInArrow(_features(width), schema))
    first = F.min_by(F.struct("bands", "sketch"), "tk")
    classes = features.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("least_id"), F.min("tk").alias("tk"), F.min("n_shingles").alias("n"), first.alias("_x"))
    classes = cut(classes.select("f1", "f2", "least_id", "tk", "n", "_x.bands", "_x.sketch").withColumn("cid", F.monotonically_increasing_id()))
    buckets = classes.select("cid", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.min("cid").alias("centre"), F.count("*").alias("m")).where("m > 1").drop("m")
    buckets = cut(buckets.join(shared, ["band", "key"]))
    known = classes.select("cid", "n", "sketch")
    stars = (
        buckets.where("cid <> centre").select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct()
        .join(known.toDF("b", "n2", "sketch2"), "b").join(known.withColumnRenamed("cid", "a"), "a")
        .where(_passes(percent)).select("a", "b")
    )
    links = cut(_confirmed(cut(stars), classes, docs, width, percent))
    parts = connected_components(links)
    buckets, rare, closest, crowded = buckets.drop("centre").withColumn("sure", F.lit(True)), False, FIRST_CLOSEST, False
    while True:
        told, left = _across(classes, buckets, parts, percent, closest, rare)
        told, crowded, closest = cut(told), crowded or left, closest * 8
        if not told.isEmpty():
            links = links.unionByName(cut(_confirmed(told, classes, docs, width, percent)))
            parts = connected_components(links)
        if not told.where("more").isEmpty():
            continue
        if rare or not crowded:
            break
        held, _ = _opened(_of_components(buckets, parts))
        buckets = _by_rare_shingles(cut(held.where(F.col("m") > DEEP).select("cid").distinct()), classes, docs, width, percent)
        rare, closest = True, FIRST_CLOSEST
    named = classes.select("cid", "f1", "f2", "least_id").join(parts.withColumnRenamed("node", "cid"), "cid")
    names = named.groupBy("component").agg(F.min("least_id").alias("_name"))
    alone = classes.join(parts, F.col("cid") == F.col("node"), "left_anti").select("f1", "f2", F.col("least_id").alias("_name"))
    labels = named.join(names, "component").select("f1", "f2", "_name").unionByName(alone)
    rows = features.select("doc_id", "n_shingles", "f1", "f2").join(labels, ["f1", "f2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_name")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one with the least doc_id.

    Rows that repeat a doc_id are one document, which stays or goes as a whole; documents without
    words are kept.
    """
    (name,) = fresh(docs, "kept")
    kept = near_duplicates(docs, width, percent).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
