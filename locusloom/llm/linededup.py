"""Lines that many documents share, found by a sharded minimal perfect hash.

A line's key is the line without blanks (x20, x09-x0D) at its ends, A-Z lower-cased. Keys of ``min_chars`` code points at least
that two documents hold lose all their lines but those in the document with the smallest doc_id among them. Tasks
tell each key of a document once, by its 128-bit hash; one aggregation counts the documents of each hash and finds
their smallest. Hashes that two documents hold are dealt to shards of some ``SHARD_KEYS``, and a task builds
each shard's minimal perfect hash: in each of a few levels a key is put in a bit of its own, keys that collide go on to the
next, and a key's index is the number of bits set before its own. Arrays in the order of the indexes hold a fingerprint
(the other 64 bits of the hash), the number of documents and the owner: 20 bytes and some 4 bits a key, no text.

Documents probe the arrays in place: these are given to all tasks while they are ``BROADCAST_KEYS`` keys at most (counted), and
no line is shuffled. Beyond, lines' hashes go to the shards instead, dealt over ``SALTS`` copies of each so that
a line that every document holds is no single task's; rows are streamed past a shard, never gathered.

A line that no two documents hold is taken for one that they do with a chance of 2^-64.

Defined results: a null or empty text is one empty line and stays null or empty; ``\\n`` alone ends lines; rows that share a doc_id
are one document, and keep all their lines if it is the smallest; a null doc_id is a document after all others; an empty table gives
no rows; further columns come through, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from locusloom.llm.common import cut, fresh, own_columns
from locusloom.llm.textcols import mix

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
SHARD_KEYS, BROADCAST_KEYS, SALTS = 1 << 16, 4_000_000, 16
#: Rows that a task returns at a time.
ROWS = 1 << 16
#: Bits of a level for each key that is left.
SPARE = 1.5
NOBODY = np.iinfo(np.int64).max

_HASHED = "a long, b long, doc long"
_SHARD = "shard int, sizes binary, words binary, prints binary, owners binary, counts binary"


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key, or None where it is shorter than ``min_chars`` code points."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _docs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).fill_null(int(NOBODY)).to_numpy(zero_copy_only=False)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    """One text at a time, so that a batch is never held twice."""
    for value in batch.column("text").cast(pa.large_string()).cast(pa.large_binary()):
        yield value.as_py() or b""


def _hashed(min_chars: int) -> Callable:
    """Documents -> their distinct keys' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, owners, counts = [], [], []

        def told() -> pa.RecordBatch:
            a, b = _halves(digests)
            doc = np.repeat(np.array(owners, np.int64), counts)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (a.view(np.int64), b.view(np.int64), doc)], names=["a", "b", "doc"])

        for batch in batches:
            for doc, text in zip(_docs(batch, "doc_id"), _texts(batch), strict=True):
                own = {line_hash(line, min_chars) for line in text.split(b"\n")} - {None}
                digests += own
                owners.append(doc)
                counts.append(len(own))
                if len(digests) >= ROWS:
                    yield told()
                    digests, owners, counts = [], [], []
        if digests:
            yield told()

    return run


def _place(a: np.ndarray, b: np.ndarray, level: int, bits: np.ndarray | int) -> np.ndarray:
    """The bit of each key in a level of ``bits``."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mix(a ^ mix(b + salt)) % np.asarray(bits, np.uint64)).astype(np.int64)


def build(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimal perfect hash of distinct keys: bits of each level, the levels' words, and each key's index."""
    left, sizes, words = np.arange(len(a)), [], []
    where, start = np.zeros(len(a), np.int64), 0
    while len(left):
        if len(sizes) > 255:
            raise ValueError("keys aren't distinct")
        bits = -(-int(len(left) * SPARE + 1) // 64) * 64
        at = _place(a[left], b[left], len(sizes), bits)
        alone = np.bincount(at, minlength=bits)[at] == 1
        flags = np.zeros(bits, np.uint8)
        flags[at[alone]] = 1
        words.append(np.packbits(flags, bitorder="little").view(np.uint64))
        where[left[alone]] = start + at[alone]
        sizes.append(bits)
        start += bits
        left = left[~alone]
    words = np.concatenate(words) if words else np.zeros(0, np.uint64)
    return np.array(sizes, np.int64), words, _rank(words, _before(words), where)


def _before(words: np.ndarray) -> np.ndarray:
    """Bits set before each word."""
    ones = np.bitwise_count(words).astype(np.int64)
    return np.cumsum(ones) - ones


def _rank(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    return before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)


def _shard(rows: pa.Table) -> pa.Table:
    """The keys of one shard -> its row."""
    a, b = (rows.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
    sizes, words, index = build(a, b)
    arrays = []
    for values in (b, rows.column("doc").to_numpy(), np.minimum(rows.column("n").to_numpy(), 0xFFFFFFFF).astype(np.uint32)):
        placed = np.empty_like(values)
        placed[index] = values
        arrays.append(placed)
    values = [sizes, words, *arrays]
    columns = [pa.array([rows.column("shard")[0].as_py()], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in values]]
    return pa.Table.from_arrays(columns, names=[c.split()[0] for c in _SHARD.split(", ")])


class Index:
    """Some shards of the hash (all where ``of`` is their number), probed many keys at a time."""

    def __init__(self, shards: list[dict], of: int) -> None:
        shards = sorted(shards, key=lambda s: s["shard"])
        take = lambda name, kind: [np.frombuffer(s[name], kind) for s in shards]
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        sizes = take("sizes", np.int64)
        self.of, self.levels = of, max((len(s) for s in sizes), default=0)
        self.bits, self.start = np.zeros((of, self.levels), np.int64), np.zeros((of, self.levels), np.int64)
        at = 0
        for shard, size in zip(shards, sizes, strict=True):
            self.bits[shard["shard"], : len(size)] = size
            self.start[shard["shard"], : len(size)] = at + np.cumsum(size) - size
            at += int(size.sum())
        self.words = join(take("words", np.uint64), np.uint64)
        self.before = _before(self.words)
        self.prints, self.owners, self.counts = (join(take(c, k), k) for c, k in (("prints", np.uint64), ("owners", np.int64), ("counts", np.uint32)))

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each key's index in the arrays, -1 where they don't hold its fingerprint."""
        shard = a.view(np.int64) % self.of
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level in range(self.levels):
            left = left[self.bits[shard[left], level] > 0]
            if not len(left):
                break
            own = shard[left]
            at = self.start[own, level] + _place(a[left], b[left], level, self.bits[own, level])
            hit = (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[left[hit]] = _rank(self.words, self.before, at[hit])
            left = left[~hit]
        known = out >= 0
        known[known] = self.prints[out[known]] == b[known]
        return np.where(known, out, -1)

    def dropped(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether lines go: two documents hold them, and theirs isn't the smallest."""
        at = self.find(a, b)
        known = at >= 0
        known[known] = self.owners[at[known]] != doc[known]
        return known


_held: dict[int, Index] = {}


def _index(shards: Broadcast, of: int) -> Index:
    """A worker's index, made once."""
    key = shards._jbroadcast.id() if getattr(shards, "_jbroadcast", None) else id(shards.value)
    if key not in _held:
        _held.clear()
        _held[key] = Index(shards.value, of)
    return _held[key]


def _without(text: bytes, gone: np.ndarray) -> bytes:
    return b"\n".join(line for line, g in zip(text.split(b"\n"), gone, strict=True) if not g)


def _answer(batch: pa.RecordBatch, texts: list, lines: list[int], gone: list[int]) -> pa.RecordBatch:
    """``batch`` with its texts replaced and n_lines and n_dropped added."""
    texts = pa.array(texts, pa.binary()).cast(pa.string())
    columns = [texts if f == "text" else batch.column(f) for f in batch.schema.names]
    return pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=[*batch.schema.names, "n_lines", "n_dropped"])


def _probed(shards: Broadcast, of: int, min_chars: int) -> Callable:
    """Documents -> documents without lines that the arrays tell to drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shards, of)
        for batch in batches:
            # All lines of a batch are looked up together: 16 bytes a line, less than its text.
            digests, at, lines = [], [], []
            for text in _texts(batch):
                found = [line_hash(line, min_chars) for line in text.split(b"\n")]
                digests += [h for h in found if h is not None]
                at.append(np.flatnonzero([h is not None for h in found]))
                lines.append(len(found))
            a, b = _halves(digests)
            drop = index.dropped(a, b, np.repeat(_docs(batch, "doc_id"), [len(k) for k in at]))
            ends = np.cumsum([len(k) for k in at])
            texts, gone = [], []
            for text, null, n, k, end in zip(_texts(batch), batch.column("text").is_null().to_pylist(), lines, at, ends, strict=True):
                flags = np.zeros(n, bool)
                flags[k] = drop[end - len(k) : end]
                gone.append(int(flags.sum()))
                texts.append(None if null else _without(text, flags) if gone[-1] else text)
            yield _answer(batch, texts, lines, gone)

    return run


def _lines(min_chars: int) -> Callable:
    """Documents -> a row for each line that has a key, distinct hashes with their lines' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, name in zip(_docs(batch, "doc_id"), _texts(batch), batch.column("th").to_pylist(), strict=True):
                found = [line_hash(line, min_chars) for line in text.split(b"\n")]
                for first in range(0, len(found), ROWS):
                    at = [i for i in range(first, min(first + ROWS, len(found))) if found[i] is not None]
                    if at:
                        a, b = _halves([found[i] for i in at])
                        columns = [pa.array(np.full(len(at), doc, np.int64)), pa.array([name] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc", "th", "at", "a", "b"])

    return run


def _streamed(of: int) -> Callable:
    """Rows by shard and copy, each shard's arrays before its lines -> the lines that go."""
    names = [c.split()[0] for c in _SHARD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            arrays = batch.column("words").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (arrays[1:] != arrays[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                if arrays[i]:
                    now, index = shard[i], Index([batch.select(names).slice(i, 1).to_pylist()[0]], of)
                elif shard[i] == now:
                    part = batch.slice(i, j - i)
                    a, b = (part.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
                    yield part.filter(pa.array(index.dropped(a, b, part.column("doc").to_numpy()))).select(["doc", "th", "at"])

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the numbers of the lines that go -> documents without them."""
    for batch in batches:
        texts, lines, gone = [], [], []
        for text, null, drop in zip(_texts(batch), batch.column("text").is_null().to_pylist(), batch.column("gone"), strict=True):
            flags = np.zeros(text.count(b"\n") + 1, bool)
            flags[drop.as_py() or []] = True
            lines.append(len(flags))
            gone.append(int(flags.sum()))
            texts.append(None if null else _without(text, flags))
        yield _answer(batch.drop_columns(["gone"]), texts, lines, gone)


def _sharded(docs: DataFrame, min_chars: int) -> tuple[DataFrame, int, int]:
    """The shards' rows, their number and that of their keys."""
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_hashed(min_chars), _HASHED)
    counted = hashed.groupBy("a", "b").agg(F.min("doc").alias("doc"), F.max("doc").alias("_last"), F.count("*").alias("n"))
    shared = cut(counted.where("doc <> _last").select("a", "b", "doc", "n"))
    keys = shared.count()
    of = -(-keys // SHARD_KEYS) or 1
    shards = shared.withColumn("shard", F.pmod("a", F.lit(of)).cast("int")).groupBy("shard").applyInArrow(_shard, _SHARD)
    return cut(shards), of, keys


def deduplicated(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with its own columns, its texts without the lines that go, and n_lines and n_dropped."""
    spark = docs.sparkSession
    shards, of, keys = _sharded(docs, min_chars)
    others = [c for c in docs.columns if c.lower() != "text"]
    narrow = docs.select(F.struct(*own_columns(others)).alias("own"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = StructType([*narrow.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    if keys <= BROADCAST_KEYS:
        told = spark.sparkContext.broadcast([r.asDict() for r in shards.collect()])  # counted above
        out = narrow.mapInArrow(_probed(told, of, min_chars), schema)
    else:
        key = F.xxhash64("text").alias("th")
        lines = narrow.select("doc_id", key, "text").mapInArrow(_lines(min_chars), "doc long, th long, at long, a long, b long")
        lines = lines.withColumn("shard", F.pmod("a", F.lit(of)).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc", "at"), F.lit(SALTS)).cast("int"))
        copies = shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = copies.unionByName(lines, allowMissingColumns=True).repartition("shard", "salt")
        both = both.sortWithinPartitions("shard", "salt", F.col("words").isNull())
        gone = both.mapInArrow(_streamed(of), "doc long, th long, at long").groupBy("doc", "th").agg(F.collect_set("at").alias("gone"))
        keyed = narrow.select("*", key, F.coalesce("doc_id", F.lit(int(NOBODY))).alias("doc"))
        out = keyed.join(gone, ["doc", "th"], "left").select(*narrow.columns, "gone").mapInArrow(_removed, schema)
    names = fresh(docs, "n_lines", "n_dropped")
    own = [F.col("text").alias(c) if c.lower() == "text" else F.col("own")[c].alias(c) for c in docs.columns]
    return out.select(*own, F.col("n_lines").alias(names[0]), F.col("n_dropped").alias(names[1]))


def digests(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """A row for each document: doc_id, n_lines, n_dropped, kept_sha256."""
    out = deduplicated(docs.select("doc_id", "text"), min_chars)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
