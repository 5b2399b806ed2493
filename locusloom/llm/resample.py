"""Importance resampling towards a target distribution, with DataFrame functions only.

Words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is lower-cased; features are all runs of 1 to ``n``
consecutive words, joined by a space, and a feature's bucket is the crc32 of its bytes modulo ``buckets``. Each document's
features are rows of its own task: they are counted by bucket before anything is shuffled, so a shuffle holds ``buckets``
rows a task at most. What a bucket is worth is the logarithm of its smoothed share of the target over that of the
documents, in whole thousandths; this table has ``buckets`` rows and is broadcast while that is few. A document's weight is
the floored mean over its features, again summed up in its own task. Adding Gumbel noise that a digest of the
doc_id gives makes the highest scores a draw without replacement in proportion to the exponentials of the weights.

Ranks come from one sort over ranges: a row's place in its partition plus the rows of the partitions before it. The
sorted rows hold numbers only, never a text.

Defined results: a null, empty or wordless text has no features and weight 0; repeated rows are each scored and ranked, ties
in score and doc_id in any order (their rows don't differ in what is returned); a null doc_id draws its noise from an
empty name and ranks last among equal scores; an empty target gives every bucket the same smoothed share; empty tables give no rows;
further columns are ignored by :func:`importance` and kept, whatever their names, by :func:`resampled`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusloom.llm.common import ascii_lower, cut, fresh, own_columns

WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: Buckets' gains are given to all tasks up to this number; beyond, the same join shuffles.
BROADCAST_BUCKETS = 1_000_000
#: monotonically_increasing_id tells the partition above these bits, and the place in it below.
PLACE_BITS = 33


def _features(docs: DataFrame, n: int, *kept: Column) -> DataFrame:
    """``kept``, n_words and, a row for each feature (one null for none), the feature."""
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0))
    rows = docs.select(*kept, F.coalesce(words, F.array().cast("array<string>")).alias("_words"))
    size = F.size("_words")
    runs = [F.col("_words")]
    for k in range(2, n + 1):  # a run is a shorter one and a further word, so no lambda looks at the whole text again
        m = F.greatest(size - k + 1, F.lit(0))
        runs.append(F.zip_with(F.slice(runs[-1], F.lit(1), m), F.slice("_words", F.lit(k), m), lambda x, y: F.concat(x, F.lit(" "), y)))
    features = F.concat(*runs) if n > 1 else runs[0]
    return rows.select(*[c for c in rows.columns if c != "_words"], size.alias("n_words"), F.explode_outer(features).alias("_feature"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.crc32(F.col("_feature").cast("binary")), F.lit(buckets)).alias("bucket")


def _counts(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, n) of those buckets that have features: ``buckets`` rows at most."""
    return cut(_features(texts, n).where(F.col("_feature").isNotNull()).groupBy(_bucket(buckets)).agg(F.count("*").alias("n")))


def gains(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of every bucket, the gain in whole thousandths."""
    own, wanted = _counts(docs, n, buckets), _counts(target, n, buckets)
    total, all_wanted = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (own, wanted))
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(own.withColumnRenamed("n", "s"), "bucket", "left").join(wanted.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") + 1 for c in ("s", "t"))
    share = t * F.lit(float(total + buckets)) / (s * F.lit(float(all_wanted + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(share)).alias("gain"))


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in whole thousandths."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _ranked(scored: DataFrame, min_words: int, percent: int) -> DataFrame:
    """``scored`` with ``rank``: the order of the highest ``percent`` of those with ``min_words``, null for the others."""
    scored = scored.withColumn("_may", F.col("n_words") >= min_words)
    order = scored.orderBy(F.col("_may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "_row")
    placed = cut(order.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", PLACE_BITS).alias("_part")
    sizes = cut(placed.groupBy(part).agg(F.count("*").alias("_n"), F.sum(F.col("_may").cast("long")).alias("_m")))
    drawn = (sizes.agg(F.coalesce(F.sum("_m"), F.lit(0))).first()[0] * percent) // 100
    # A row for each partition of the sort: one task adds them up, and all are given them.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.col("_offset") + F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1) + 1
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("_rank", rank)
    return numbered.withColumn("rank", F.when(F.col("_may") & (F.col("_rank") <= drawn), F.col("_rank")))


def _scored(docs: DataFrame, target: DataFrame, n: int, buckets: int, seed: int, *kept: Column) -> DataFrame:
    worth = gains(docs, target, n, buckets)
    worth = F.broadcast(worth) if buckets <= BROADCAST_BUCKETS else worth
    names = [F.col("doc_id").alias("doc_id"), *kept, F.monotonically_increasing_id().alias("_row")]
    rows = _features(docs, n, *names)
    keys = [c for c in rows.columns if c != "_feature"]
    summed = rows.withColumn("bucket", _bucket(buckets)).join(worth, "bucket", "left").groupBy(*keys).agg(F.count("gain").alias("n_features"), F.sum("gain").alias("_sum"))
    mean = F.expr("(_sum - pmod(_sum, n_features)) div n_features")  # floored, also below zero
    weight = F.when(F.col("n_features") > 0, mean).otherwise(F.lit(0)).cast("long")
    return cut(summed.withColumn("weight", weight).withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)).drop("_sum"))


def importance(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """A row for each document: doc_id, n_features, weight, score, rank (null unless drawn)."""
    out = _ranked(_scored(docs.select("doc_id", "text"), target, n, buckets, seed), min_words, percent)
    return out.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """The drawn documents with their own columns and their rank."""
    (rank,) = fresh(docs, "rank")
    same = Window.partitionBy("doc_id", "_text").orderBy("rank")
    narrow = docs.select("doc_id", "text")
    drawn = _ranked(_scored(narrow, target, n, buckets, seed, F.xxhash64("text").alias("_text")), min_words, percent).where(F.col("rank").isNotNull())
    drawn = drawn.select(F.col("doc_id").alias("_id"), "_text", F.row_number().over(same).alias("_copy"), F.col("rank").alias("_rank"))
    packed = docs.select(F.struct(*own_columns(docs.columns)).alias("_own"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"))
    # Only drawn texts are numbered among their repeats.
    some = drawn.select("_id", "_text").distinct()
    on = lambda a, b: a["_id"].eqNullSafe(b["_id"]) & (a["_text"] == b["_text"])
    packed = packed.join(some, on(packed, some), "left_semi").withColumn("_copy", F.row_number().over(Window.partitionBy("_id", "_text").orderBy(F.lit(0))))
    out = packed.join(drawn, on(packed, drawn) & (packed["_copy"] == drawn["_copy"]))
    return out.select(*[F.col("_own")[c].alias(c) for c in docs.columns], F.col("_rank").cast("long").alias(rank))
