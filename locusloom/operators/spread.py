"""Conjugate gradients for all LD blocks at once, as joins and sums: for blocks that are too large for a task.

A vector is a column of the nodes' table. A product with the precision matrix joins edges with the vector and adds up by node; dot
products are sums by block, which meet the nodes again as a table with a row for each block. The state is written down in each
round, so a lost executor costs a round, and no task holds more than its share of rows, however large a block is.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusloom.functions.stats import heterozygosity_sd
from locusloom.functions.tables import cut

NODE = ["ld_block", "pop", "ld_node"]
#: Blocks up to which the table of dot products is broadcast.
BROADCAST_BLOCKS = 1_000_000
#: Rounds between two questions whether any block goes on.
CHECKED = 3


def prepared(nodes: DataFrame, alpha: float) -> DataFrame:
    """Nodes with d, seen, het, sd, sign, alpha_hat and the mean sample size of their block and population."""
    seen = F.coalesce(F.col("z").isNotNull() & ~F.isnan("z") & (F.col("n") > 0), F.lit(False))
    sign = F.when(F.col("aa") == 1, -1.0).otherwise(1.0)
    rows = nodes.withColumn("seen", seen).withColumn("sign", sign).withColumn("het", F.sqrt(2 * F.col("af") * (1 - F.col("af"))))
    rows = rows.withColumn("sd", F.when(F.col("seen"), heterozygosity_sd(F.col("af"), alpha)).otherwise(0.0))
    rows = rows.withColumn("alpha_hat", F.when(F.col("seen"), F.col("sign") * F.col("z") / F.sqrt("n")).otherwise(0.0))
    means = rows.groupBy("ld_block", "pop").agg(F.coalesce(F.avg(F.when(F.col("seen"), F.col("n"))), F.lit(1.0)).alias("mean_n"))
    return rows.join(means, ["ld_block", "pop"]).select(*NODE, F.col("ld_diagonal").alias("d"), "seen", "sign", "het", "sd", "alpha_hat", "mean_n")


def times_precision(state: DataFrame, both: DataFrame, vector: Column, out: str) -> DataFrame:
    """Add ``out``: the precision matrix times ``vector``. ``both`` has each edge in both directions."""
    own = [c for c in state.columns if c not in NODE and c != out]
    given = state.select("ld_block", "pop", F.col("ld_node").alias("j"), vector.alias("_v")).where("_v <> 0")
    parts = both.join(given, ["ld_block", "pop", "j"]).select("ld_block", "pop", F.col("i").alias("ld_node"), F.lit(None).alias("_s"), (F.col("w") * F.col("_v")).alias("_q"))
    rows = state.select(*NODE, F.struct(*own).alias("_s"), (F.col("d") * vector).alias("_q"))
    added = rows.unionByName(parts).groupBy(*NODE).agg(F.max("_s").alias("_s"), F.sum("_q").alias(out))  # one row has the state, so max picks it
    return added.select(*NODE, "_s.*", out)


def times_covariance(state: DataFrame, vector: str, out: str, beta_cov: float, cross_corr: float) -> DataFrame:
    """Add ``out``: the prior covariance of effects times ``vector``; a node's populations are a handful of rows."""
    mine = F.col("sd") * F.col(vector)
    both = F.sum(mine).over(Window.partitionBy("ld_block", "ld_node"))
    return state.withColumn(out, beta_cov * F.col("sd") * ((1 - cross_corr) * mine + cross_corr * both))


def _steps(state: DataFrame, scale: Column, tolerance: float) -> DataFrame:
    """For each block the step along p, the share of p that stays, and whether it goes on."""
    r, q = F.col("r"), F.col("q")
    sums = {"_rr": scale * r * r, "_pq": F.col("p") * q, "_rq": scale * r * q, "_qq": scale * q * q}
    dots = state.groupBy("ld_block").agg(*[F.sum(v).alias(c) for c, v in sums.items()])
    dots = dots.withColumn("_on", (F.col("_rr") >= tolerance * tolerance) & (F.col("_pq") > 0))
    dots = dots.withColumn("_step", F.when(F.col("_on"), F.try_divide("_rr", "_pq")).otherwise(0.0))
    left = F.greatest(F.col("_rr") - 2 * F.col("_step") * F.col("_rq") + F.col("_step") * F.col("_step") * F.col("_qq"), F.lit(0.0))
    return dots.select("ld_block", "_step", F.when(F.col("_on"), F.try_divide(left, F.col("_rr"))).otherwise(0.0).alias("_share"), "_on")


def conjugate(state: DataFrame, product, scale: Column, tolerance: float, rounds: int, small: bool) -> DataFrame:
    """``state`` with x, the solution of product(x) = b for its column b, by blocks; ``scale`` is one over the diagonal.

    A block stands still once its scaled residual is below ``tolerance``, which is asked every ``CHECKED`` rounds; there are ``rounds`` rounds at most.
    """
    state = state.withColumn("x", F.lit(0.0)).withColumn("r", F.col("b")).withColumn("p", scale * F.col("b"))
    state = cut(product(cut(state)))  # adds q, the product with p
    for k in range(rounds):
        steps = _steps(state, scale, tolerance)
        if k % CHECKED == 0 and not steps.where("_on").limit(1).count():
            break
        state = state.join(F.broadcast(steps) if small else steps, "ld_block")
        state = state.withColumn("x", F.col("x") + F.col("_step") * F.col("p")).withColumn("r", F.col("r") - F.col("_step") * F.col("q"))
        state = state.withColumn("p", F.when(F.col("_on"), scale * F.col("r") + F.col("_share") * F.col("p")).otherwise(0.0))
        state = cut(product(state.drop("_step", "_share", "_on", "q")))
    return state.drop("r", "p", "q")


def blup(nodes: DataFrame, edges: DataFrame, alpha: float = -0.5, beta_cov: float = 1e-7, cross_corr: float = 0.9, tolerance: float = 1e-6) -> DataFrame:
    """(ld_block, pop, ld_node, es) as :func:`locusloom.operators.ld.blup`, whatever the size of a block."""
    base = cut(prepared(nodes, alpha))
    sizes = base.groupBy("ld_block").agg(F.count("*").alias("n")).agg(F.count("*"), F.max("n")).first()
    small, rounds = sizes[0] <= BROADCAST_BLOCKS, max(sizes[1] or 0, 50)
    both = edges.select("ld_block", "pop", "i", "j", "w")
    both = both.unionByName(both.select("ld_block", "pop", F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    known = base.select("ld_block", "pop", F.col("ld_node").alias("j"))
    if both.join(known, ["ld_block", "pop", "j"], "left_anti").limit(1).count():
        raise ValueError("an edge has a neighbour that is no node")
    # Kept by what products join on: rounds shuffle vectors, not edges.
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(parts, "ld_block", "pop", "j").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        zero, lacks = F.lit(0.0), ~F.col("seen")
        first = times_precision(base, both, F.col("alpha_hat"), "b").withColumn("b", F.when(lacks, F.col("b")).otherwise(zero))

        def among_missing(state: DataFrame) -> DataFrame:
            out = times_precision(state, both, F.col("p"), "q")
            return out.withColumn("q", F.when(lacks, F.col("q")).otherwise(zero))

        def system(state: DataFrame) -> DataFrame:
            out = times_covariance(times_precision(state, both, F.col("p"), "q"), "p", "_c", beta_cov, cross_corr)
            return out.withColumn("q", F.col("_c") + F.col("q") / F.col("mean_n")).drop("_c")

        state = conjugate(first, among_missing, 1 / F.col("d"), tolerance, rounds, small)
        state = times_precision(state.drop("b"), both, F.col("alpha_hat") - F.col("x"), "b").drop("x")
        state = state.withColumn("b", F.when(F.col("seen"), F.col("b")).otherwise(zero))
        scale = 1 / (beta_cov * F.col("sd") * F.col("sd") + F.col("d") / F.col("mean_n"))
        state = times_covariance(conjugate(state, system, scale, tolerance, rounds, small), "x", "beta", beta_cov, cross_corr)
        return cut(state.where("seen").select(*NODE, (F.col("sign") * F.col("beta") / F.when(F.col("het") > 0, F.col("het")).otherwise(1.0)).alias("es")))
    finally:
        both.unpersist()
