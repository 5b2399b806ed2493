"""Effects re-weighted by sparse linkage-disequilibrium precision matrices, block by block.

Nodes are rows (ld_block, pop, ld_node, aa, af, ld_diagonal, z, n[, vid]) with null z and n where a node has no
association; edges are rows (ld_block, pop, i, j, w), i < j. Spark shuffles both by block; a block of usual
size is solved in one task by conjugate gradients on its sparse matrices, never as a dense one; larger blocks are iterated over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusloom.functions.stats import heterozygosity_sd
from locusloom.functions.tables import cut
from locusloom.operators import spread

#: The median of a chi-squared variable with one degree, and the average LD score.
MEDIAN_CHI2, AVERAGE_LD_SCORE = 0.45493642311957283031, 72.6


def checked(ldgm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of an LD table: aa 0 or 1, a frequency, node numbers, diagonals of at least 1, later neighbours."""
    good = (
        F.col("aa").isin(0, 1) & F.col("af").isNotNull() & (F.col("ld_node") >= 0) & (F.col("ld_diagonal") >= 1)
        & (F.size("ld_neighbors") == F.size("ld_weights")) & F.forall("ld_neighbors", lambda x: x > F.col("ld_node"))
    )
    ok = F.coalesce(good, F.lit(False))
    return ldgm.where(ok), ldgm.where(~ok)


def from_edge_list(snps: DataFrame, edges: DataFrame) -> DataFrame:
    """LD tables of markers (ld_block, ld_node, chrom, pos, anc, deriv, af, swapped) and edges (ld_block, i, j, w), i = j for diagonals.

    Where ``swapped`` holds, the ancestral allele is alt and the frequency is mirrored. Markers of nodes that begin no edge are left out.
    """
    other = F.when(F.col("i") != F.col("j"), F.struct("j", "w"))
    own = edges.groupBy("ld_block", F.col("i").alias("ld_node")).agg(F.max(F.when(F.col("i") == F.col("j"), F.col("w"))).alias("ld_diagonal"), F.array_sort(F.collect_list(other)).alias("_e"))
    turned = F.coalesce(F.col("swapped"), F.lit(False))
    pick = lambda yes, no: F.when(turned, yes).otherwise(no)
    return snps.join(own, ["ld_block", "ld_node"]).select(
        "ld_block", "ld_node", "chrom", "pos", pick(F.col("deriv"), F.col("anc")).alias("ref"), pick(F.col("anc"), F.col("deriv")).alias("alt"), turned.cast("int").alias("aa"),
        pick(1 - F.col("af"), F.col("af")).alias("af"), "ld_diagonal", F.col("_e.j").alias("ld_neighbors"), F.col("_e.w").alias("ld_weights"),
    )


def edges_of(ldgm: DataFrame) -> DataFrame:
    """Edges (ld_block, pop, i, j, w) of distinct nodes' neighbour lists, without zero weights."""
    nodes = ldgm.dropDuplicates(["ld_block", "pop", "ld_node"])
    pairs = nodes.select("ld_block", "pop", F.col("ld_node").alias("i"), F.explode(F.arrays_zip("ld_neighbors", "ld_weights")).alias("_x"))
    return pairs.select("ld_block", "pop", "i", F.col("_x.ld_neighbors").alias("j"), F.col("_x.ld_weights").cast("double").alias("w")).where("w <> 0")


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    return edges.unionByName(edges.select("ld_block", "pop", F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def with_association(ldgm: DataFrame, stats: DataFrame) -> DataFrame:
    """Nodes with z and n of the association rows with the same key; the first with a z represents its node."""
    joined = ldgm.join(stats.select("chrom", "pos", "ref", "alt", "z", "n"), ["chrom", "pos", "ref", "alt"], "left")
    usable = F.col("z").isNotNull() & (F.col("n") > 0)
    first = Window.partitionBy("ld_block", "pop", "ld_node").orderBy((~usable).cast("int"), "pos", "ref", "alt")
    return joined.withColumn("z", F.when(usable, F.col("z"))).withColumn("n", F.when(usable, F.col("n"))).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def node_map(nodes: DataFrame) -> DataFrame:
    """(ld_block, ld_node, pops): the populations that have a node."""
    return nodes.groupBy("ld_block", "ld_node").agg(F.array_sort(F.collect_set("pop")).alias("pops"))


def node_statistics(nodes: DataFrame, alpha: float = -0.5) -> DataFrame:
    """Add the standardised effect alpha_hat = z / sqrt(n), negated where the ancestral allele is alt, and sd."""
    signed = F.when(F.col("aa") == 1, -F.col("z")).otherwise(F.col("z"))
    return nodes.withColumn("alpha_hat", signed / F.sqrt("n")).withColumn("sd", heterozygosity_sd(F.col("af"), alpha))


def prior_covariance(nodes: DataFrame, beta_cov: float = 1e-7, cross_corr: float = 0.9, alpha: float = -0.5) -> DataFrame:
    """(ld_block, ld_node, pop1, pop2, sigma): the prior covariance of the effects of nodes that have an association."""
    rows = node_statistics(nodes, alpha).where(F.col("z").isNotNull())
    held = rows.groupBy("ld_block", "ld_node").agg(F.sort_array(F.collect_list(F.struct("pop", "sd"))).alias("_p"))  # a struct for each population
    one = held.select("ld_block", "ld_node", "_p", F.explode("_p").alias("_a"))
    both = one.select("ld_block", "ld_node", "_a", F.explode("_p").alias("_b")).where("_a.pop <= _b.pop")
    share = F.when(F.col("_a.pop") == F.col("_b.pop"), 1.0).otherwise(cross_corr)
    return both.select("ld_block", "ld_node", F.col("_a.pop").alias("pop1"), F.col("_b.pop").alias("pop2"), (beta_cov * F.col("_a.sd") * F.col("_b.sd") * share).alias("sigma"))


def summary(nodes: DataFrame, alpha: float = -0.5, average_ld_score: float = AVERAGE_LD_SCORE, correct: bool = False, expected_ratio: float = 0.6) -> DataFrame:
    """(pop, non_missing, missing, lambda_gc, sigmasq_inf, trace_inf, beta_cov, max_alpha2, sum_alpha2) over all blocks.

    Lambda compares the median over blocks of mean sample size with that of median squared effect; with ``correct`` the heritability is
    shrunk for a share of large effects.
    """
    rows = node_statistics(nodes, alpha)
    seen = F.col("z").isNotNull()
    block = rows.groupBy("pop", "ld_block").agg(
        F.count_if(seen).alias("have"), F.count_if(~seen).alias("lack"), F.avg(F.when(seen, F.col("n"))).alias("mean_n"),
        F.median(F.when(seen, F.col("alpha_hat") * F.col("alpha_hat"))).alias("median_a2"), F.sum(F.when(seen, F.col("alpha_hat") * F.col("alpha_hat"))).alias("sum_a2"),
        F.sum(F.when(seen, F.col("sd") * F.col("sd"))).alias("trace"), F.max(F.when(seen, F.col("alpha_hat") * F.col("alpha_hat"))).alias("max_a2"),
    )
    pop = block.groupBy("pop").agg(
        F.sum("have").alias("non_missing"), F.sum("lack").alias("missing"), (F.median("mean_n") * F.median("median_a2") / MEDIAN_CHI2).alias("lambda_gc"),
        F.median("mean_n").alias("_n"), F.sum("sum_a2").alias("_a2"), F.sum("trace").alias("trace_inf"), F.max("max_a2").alias("max_alpha2"),
    )
    prop = F.col("non_missing") / (F.col("non_missing") + F.col("missing"))
    sigma = F.greatest((F.col("lambda_gc") - 1) / (F.col("_n") * average_ld_score * prop), F.lit(0.0))
    if correct:
        ratio = F.try_divide(F.col("lambda_gc") - 1, F.col("_a2") / F.col("non_missing") * F.col("_n") - 1) / expected_ratio
        sigma = sigma * F.least(F.coalesce(ratio * ratio, F.lit(1.0)), F.lit(1.0))
    pop = pop.withColumn("sigmasq_inf", sigma)
    return pop.select("pop", "non_missing", "missing", "lambda_gc", "sigmasq_inf", "trace_inf", F.try_divide(F.col("sigmasq_inf"), F.col("trace_inf") / F.col("non_missing")).alias("beta_cov"), "max_alpha2", F.col("_a2").alias("sum_alpha2"))


def system_entries(nodes: DataFrame, edges: DataFrame, alpha: float = -0.5, beta_cov: float = 1e-7, cross_corr: float = 0.9) -> DataFrame:
    """(ld_block, matrix, pop1, node1, pop2, node2, value): all entries of the block models' matrices, as :func:`blup` solves them.

    ``P`` is the precision of nodes, ``S`` the prior covariance of effects, and ``A`` = S + P / n, with n the mean sample size of the block
    and population over nodes with an association (1 without any). Entries of both triangles are told, those that are 0 needn't be.
    A node pair that several edges name has the sum of their weights.
    """
    entry = lambda m, p1, n1, p2, n2, x: ["ld_block", F.lit(m).alias("matrix"), p1.alias("pop1"), n1.alias("node1"), p2.alias("pop2"), n2.alias("node2"), x.cast("double").alias("value")]
    key = ["ld_block", "matrix", "pop1", "node1", "pop2", "node2"]
    pop, i, j, node = F.col("pop"), F.col("i"), F.col("j"), F.col("ld_node")
    both = edges.select(*entry("P", pop, i, pop, j, F.col("w"))).unionByName(edges.select(*entry("P", pop, j, pop, i, F.col("w"))))
    precision = nodes.select(*entry("P", pop, node, pop, node, F.col("ld_diagonal"))).unionByName(both).groupBy(*key).agg(F.sum("value").alias("value"))
    usable = nodes.withColumn("z", F.when(F.col("n") > 0, F.col("z")))
    prior = prior_covariance(usable, beta_cov, cross_corr, alpha)
    p1, p2 = F.col("pop1"), F.col("pop2")
    upper = prior.select(*entry("S", p1, node, p2, node, F.col("sigma")))
    prior = upper.unionByName(prior.where(p1 != p2).select(*entry("S", p2, node, p1, node, F.col("sigma"))))
    means = usable.groupBy("ld_block", "pop").agg(F.coalesce(F.avg(F.when(F.col("z").isNotNull(), F.col("n"))), F.lit(1.0)).alias("_n")).withColumnRenamed("pop", "pop1")
    scaled = precision.join(means, ["ld_block", "pop1"]).withColumn("value", F.col("value") / F.col("_n")).drop("_n")
    system = scaled.unionByName(prior).withColumn("matrix", F.lit("A")).groupBy(*key).agg(F.sum("value").alias("value"))
    return precision.unionByName(prior).unionByName(system)


def system_vectors(nodes: DataFrame, alpha: float = -0.5) -> DataFrame:
    """(ld_block, pop, ld_node, seen, alpha_hat, effect, sd) of all nodes: sd is 0 and the effects are null where there is no association.

    ``alpha_hat`` is the effect of a standardised genotype, ``effect`` that of an allele: divided by the genotype's deviation.
    """
    rows = node_statistics(nodes, alpha)
    seen = F.col("z").isNotNull() & (F.col("n") > 0)
    deviation = F.sqrt(2 * F.col("af") * (1 - F.col("af")))
    hat = F.when(seen, F.col("alpha_hat"))
    return rows.select("ld_block", "pop", "ld_node", F.coalesce(seen, F.lit(False)).alias("seen"), hat.alias("alpha_hat"), F.try_divide(hat, deviation).alias("effect"), F.when(seen, F.col("sd")).otherwise(0.0).alias("sd"))


def solve(product: Callable[[np.ndarray], np.ndarray], b: np.ndarray, diagonal: np.ndarray | None, tolerance: float, start: np.ndarray | None = None) -> np.ndarray:
    """Conjugate gradients, preconditioned by the diagonal if it is given."""
    if not len(b):
        return b.copy()
    x = b.copy() if start is None else start.copy()
    scale = 1 / diagonal if diagonal is not None else np.ones_like(b)
    r = b - product(x)
    s = scale * r
    p, rs = s.copy(), r @ s
    for _ in range(max(len(b), 50)):
        if rs < tolerance * tolerance:
            break
        q = product(p)
        step = rs / (p @ q)
        x += step * p
        r -= step * q
        s = scale * r
        rs, old = r @ s, rs
        p = s + (rs / old) * p
    return x


class Block:
    """One LD block: precision matrix of all populations' nodes, and the covariance of effects."""

    def __init__(self, nodes: pd.DataFrame, edges: pd.DataFrame, alpha: float, beta_cov: float, cross_corr: float, tolerance: float, jacobi: bool = True) -> None:
        nodes = nodes.sort_values(["pop", "ld_node"]).reset_index(drop=True)
        self.nodes, self.tolerance, self.jacobi = nodes, tolerance, jacobi
        key = pd.Series(np.arange(len(nodes)), index=pd.MultiIndex.from_frame(nodes[["pop", "ld_node"]]))
        find = lambda c: key.reindex(pd.MultiIndex.from_arrays([edges["pop"], edges[c]])).to_numpy()
        i, j = find("i"), find("j")
        if np.isnan(i.astype(float)).any() or np.isnan(j.astype(float)).any():
            raise ValueError("an edge has a neighbour that is no node")
        self.i, self.j, self.w = i.astype(int), j.astype(int), edges["w"].to_numpy(float)
        self.d = nodes["ld_diagonal"].to_numpy(float)
        self.seen = (nodes["z"].notna() & (nodes["n"] > 0)).to_numpy()
        self.het = np.sqrt(2 * nodes["af"] * (1 - nodes["af"])).to_numpy(float)
        self.sd = np.where(self.seen, self.het ** (alpha + 1), 0.0)
        self.sign = np.where(nodes["aa"] == 1, -1.0, 1.0)
        n = nodes["n"].to_numpy(float)
        self.alpha_hat = np.where(self.seen, self.sign * nodes["z"].to_numpy(float) / np.sqrt(np.where(self.seen, n, 1.0)), 0.0)
        means = {p: n[(nodes["pop"] == p) & self.seen].mean() if ((nodes["pop"] == p) & self.seen).any() else 1.0 for p in nodes["pop"].unique()}
        self.mean_n = nodes["pop"].map(means).to_numpy(float)
        self.beta_cov, self.cross = beta_cov, cross_corr
        _, self.group = np.unique(nodes["ld_node"], return_inverse=True)

    def precision(self, x: np.ndarray) -> np.ndarray:
        out = self.d * x
        if len(self.w):
            out += np.bincount(self.i, self.w * x[self.j], len(x)) + np.bincount(self.j, self.w * x[self.i], len(x))
        return out

    def covariance(self, x: np.ndarray) -> np.ndarray:
        """The prior of effects: of equal variance, correlated between populations at the same node."""
        y = self.sd * x
        both = np.bincount(self.group, y, self.group.max(initial=-1) + 1)[self.group]
        return self.beta_cov * self.sd * ((1 - self.cross) * y + self.cross * both)

    def given_missing(self, y: np.ndarray) -> np.ndarray:
        """(P11 - P10 P00^-1 P01) y on the nodes that are seen, 0 elsewhere."""
        lack = ~self.seen
        py = self.precision(np.where(self.seen, y, 0.0))
        if lack.any():
            inner = lambda v: np.where(lack, self.precision(np.where(lack, v, 0.0)), v)
            x = solve(inner, np.where(lack, py, 0.0), self.d if self.jacobi else None, self.tolerance)
            py = py - self.precision(np.where(lack, x, 0.0))
        return np.where(self.seen, py, 0.0)

    def system(self, x: np.ndarray) -> np.ndarray:
        return self.covariance(x) + self.precision(x) / self.mean_n

    def blup(self) -> np.ndarray:
        """Posterior mean effects per standardised genotype of each node."""
        diagonal = self.beta_cov * self.sd**2 + self.d / self.mean_n
        x = solve(self.system, self.given_missing(self.alpha_hat), diagonal if self.jacobi else None, self.tolerance)
        return self.covariance(x)

    def effects(self, beta: np.ndarray) -> pd.DataFrame:
        out = self.nodes[["ld_block", "pop", "ld_node"]].copy()
        out["es"] = np.where(self.seen, self.sign * beta / np.where(self.het > 0, self.het, 1.0), 0.0)
        return out[self.seen]


#: Nodes and edges of a block that one task solves; larger ones are spread over all tasks.
TASK_ROWS = 1_000_000


def blup(
    nodes: DataFrame, edges: DataFrame, alpha: float = -0.5, beta_cov: float = 1e-7, cross_corr: float = 0.9, tolerance: float = 1e-6, jacobi: bool = True, task_rows: int = TASK_ROWS
) -> DataFrame:
    """(ld_block, pop, ld_node, es) of the nodes that represent an association.

    Blocks of up to ``task_rows`` nodes and edges are solved in a task each; larger ones together, by joins and sums
    (:mod:`locusloom.operators.spread`), so that no block is too large.
    """
    if not -1 <= alpha <= 0:
        raise ValueError("alpha is in [-1, 0]")

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        block = Block(n, e, alpha, beta_cov, cross_corr, tolerance, jacobi)
        return block.effects(block.blup())

    schema = _schema(nodes)
    number = [F.col(c).cast("double").alias(c) for c in ("af", "ld_diagonal", "z", "n")]
    nodes, edges = cut(nodes.select("ld_block", "pop", "ld_node", "aa", *number)), cut(edges)
    rows = nodes.select("ld_block").unionByName(edges.select("ld_block")).groupBy("ld_block").count()
    large = cut(rows.where(F.col("count") > task_rows).select("ld_block"))
    small_nodes, small_edges = nodes, edges
    some = large.limit(1).count() > 0
    if some:
        small_nodes, small_edges = nodes.join(large, "ld_block", "left_anti"), edges.join(large, "ld_block", "left_anti")
    out = small_nodes.groupBy("ld_block").cogroup(small_edges.groupBy("ld_block")).applyInPandas(run, schema)
    if not some:
        return out
    of_large = lambda df: df.join(large, "ld_block", "left_semi")
    return out.unionByName(spread.blup(of_large(nodes), of_large(edges), alpha, beta_cov, cross_corr, tolerance))


def _schema(nodes: DataFrame) -> str:
    kinds = dict(nodes.dtypes)
    return f"ld_block {kinds['ld_block']}, pop {kinds['pop']}, ld_node {kinds['ld_node']}, es double"


def output_name(study: str, kind: str, pops: int, alpha: float | None = None, beta_cov: float | None = None) -> str:
    """The name of a re-weighted study."""
    many = "x" if pops > 1 else ""
    return f"{study}_blup{many}_a{-alpha:g}_b{beta_cov:g}" if kind == "blup" else f"{study}_pgs{many}"
