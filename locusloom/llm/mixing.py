"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves' contents of a tree domain - language - source. A token budget flows down from
the root: a node divides it among its children by their weights, but none gets more than its
capacity, which is its tokens times ``max_epochs``. What a child can't take goes to its siblings, by
weight; only what a whole family can't take goes to its parent's siblings. Each division is a
water-filling in closed form, by prefix sums over the children sorted by capacity per weight.

A leaf takes its budget as whole epochs and a token-prefix of one more: the documents of an epoch
are ordered by a seeded hash, and those that start within the remaining tokens are taken, the last of
them as a whole. The order's prefix sums are taken over ranges of the hash first, and row by row
only within the range that the prefix ends in, so a source with a third of all rows is no single task.

Defined results: a null text has no tokens and is taken once for each whole epoch and never in a
prefix; null names count as the name ""; nodes without weights have weight 1 and a weight of 0 gets
nothing; rows that repeat a doc_id, text, lang and source are taken or left together; an empty
table gives no rows; further columns are ignored by :func:`mixture` and kept by :func:`mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusloom.llm.common import broadcast_if_small, cut, own_columns

LEVELS = ("domain", "lang", "source")
#: Leaves up to this number are broadcast.
BROADCAST_ROWS = 100_000
RANGES = 4096  # of the hash: its first three hexadecimal digits


def source_domain(source: Column, domains: int = 4) -> Column:
    """The domain of a source: its number modulo ``domains``; sources without a number are "other"."""
    number = F.expr("try_cast(nullif(regexp_extract(_source, '([0-9]+)$', 1), '') as decimal(38,0))")
    return F.coalesce(F.concat(F.lit("domain"), F.pmod(number, F.lit(domains)).cast("int").cast("string")), F.lit("other"))


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for name, value in (weights.get(level) or {}).items():
        if value < 0:
            raise ValueError("weights are at least 0")
        out = F.when(F.col(level) == name, float(value)).otherwise(out)
    return out


def _divide(children: DataFrame, parent: list[str], order: str) -> DataFrame:
    """Add ``budget``: the share of ``given`` of each child, which has ``cap`` and ``w``."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    ratio = F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(float("inf"))
    by = family.orderBy("_ratio", order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    out = children.withColumn("_ratio", ratio)
    out = out.withColumn("_caps", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    out = out.withColumn("_rest", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("_level", F.when(F.col("_rest") > 0, (F.col("given") - F.col("_caps")) / F.col("_rest")).otherwise(0.0))
    out = out.withColumn("_full", F.col("_ratio") <= F.col("_level"))
    out = out.withColumn("_line", F.greatest(F.max(F.when(~F.col("_full"), F.col("_level"))).over(family), F.lit(0.0)))
    return out.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(F.col("w") * F.col("_line"))).drop("_ratio", "_caps", "_rest", "_level", "_full", "_line")


def budgets(leaves: DataFrame, total: float, weights: dict[str, dict[str, float]], max_epochs: float) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with ``budget``, in whole tokens."""
    given = None
    tree = leaves.withColumn("cap", F.col("tokens") * float(max_epochs))
    for depth, level in enumerate(LEVELS):
        path, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        children = leaves.groupBy(*path).agg((F.sum("tokens") * float(max_epochs)).alias("cap")).withColumn("w", _weight(level, weights))
        given = _divide(children.withColumn("given", F.lit(float(total))) if given is None else children.join(given, parent), parent, level).select(*path, F.col("budget").alias("given"))
    return tree.join(given, list(LEVELS)).withColumn("budget", F.floor(F.col("given") + 1e-6).cast("long")).drop("cap", "given")


def _units(docs: DataFrame, domain: Column | None) -> DataFrame:
    rows = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("n_tokens"))
    rows = rows.groupBy("doc_id", "_th", "lang", "source").agg(F.first("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"))
    return rows.withColumn("_source", F.col("source")).withColumn("domain", source_domain(F.col("_source")) if domain is None else domain).drop("_source")


def _decided(docs: DataFrame, weights: dict[str, dict[str, float]], fraction: float, max_epochs: float, seed: int, domain: Column | None) -> DataFrame:
    units = cut(_units(docs, domain).withColumn("_t", F.col("n_tokens") * F.col("n_rows")))
    leaves = cut(units.groupBy(*LEVELS).agg(F.sum("_t").alias("tokens")))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = budgets(leaves, total * float(fraction), weights, max_epochs)
    plan = plan.withColumn("_epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("long"))
    plan = cut(plan.withColumn("_left", F.col("budget") - F.col("_epochs") * F.col("tokens")))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = units.join(broadcast_if_small(plan.select(*LEVELS, "_epochs", "_left"), BROADCAST_ROWS), list(LEVELS)).withColumn("_h", F.md5(text)).withColumn("_range", F.substring("_h", 1, 3))
    sizes = rows.groupBy(*LEVELS, "_range").agg(F.sum("_t").alias("_size"))
    before = Window.partitionBy(*LEVELS).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    rows = rows.join(sizes, [*LEVELS, "_range"])
    edge = (F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("_size") > F.col("_left"))
    within = Window.partitionBy(*LEVELS, "_range").orderBy("_h", "_t", "_th").rowsBetween(Window.unboundedPreceding, -1)
    cutting = rows.where(edge).withColumn("_start", F.col("_before") + F.coalesce(F.sum("_t").over(within), F.lit(0)))
    rows = rows.where(~edge).withColumn("_start", F.col("_before")).unionByName(cutting)
    taken = (F.col("_start") < F.col("_left")) & (F.col("_t") > 0)
    return rows.withColumn("copies", F.col("_epochs") + taken.cast("long")).where("copies > 0")


def mixture(docs: DataFrame, weights: dict[str, dict[str, float]], fraction: float = 1.0, max_epochs: float = 4.0, seed: int = 0, domain: Column | None = None) -> DataFrame:
    """A row for each document taken: doc_id, domain, lang, source, n_tokens, copies.

    The budget is ``fraction`` of the documents' tokens.
    """
    rows = _decided(docs, weights, fraction, max_epochs, seed, domain)
    return rows.select("doc_id", *LEVELS, "n_tokens", "copies", F.explode(F.sequence(F.lit(1), F.col("n_rows"))).alias("_k")).drop("_k")


def mixed(docs: DataFrame, weights: dict[str, dict[str, float]], fraction: float = 1.0, max_epochs: float = 4.0, seed: int = 0, domain: Column | None = None) -> DataFrame:
    """``docs`` with its own columns, each row as often as the mixture takes it."""
    rows = _decided(docs, weights, fraction, max_epochs, seed, domain)
    rows = rows.select(F.col("doc_id").alias("_id"), F.col("_th").alias("_h"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), "copies")
    # The documents' own columns travel in one, whatever their names are.
    name = lambda c: F.coalesce(c, F.lit(""))
    packed = docs.select(
        F.struct(*own_columns(docs.columns)).alias("row"),
        F.col("doc_id").alias("doc"),
        F.xxhash64("text").alias("h"),
        name("lang").alias("lang"),
        name("source").alias("source"),
    )
    on = F.col("doc").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source"))
    taken = packed.join(rows, on).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("k"))
    return taken.select("row.*")
