"""Sparse large effects beside the polygenic ones, by a Gibbs sampler within each LD block."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.operators.ld import Block, _schema, blup, solve


def log_bayes_factor(sd: np.ndarray, e: np.ndarray, n: np.ndarray, s2: float) -> np.ndarray:
    """Of an effect of variance s2 sd^2 against none, given a residual e with variance 1/n."""
    x = n * sd * sd * s2
    return -0.5 * (np.log1p(x) - n * e * e * x / (1 + x))


def log_bayes_factor_of(sd: Column, e: Column, n: Column, s2: float) -> Column:
    """The same as a Column."""
    x = n * sd * sd * s2
    return -0.5 * (F.log1p(x) - n * e * e * x / (1 + x))


def joint_log_bayes_factor(sd: np.ndarray, e: np.ndarray, n: np.ndarray, s2: float, c: float, group: np.ndarray) -> np.ndarray:
    """The same for each group of rows (a node in several populations) whose effects correlate by c.

    Effects are sd (u + v) with v shared: independent parts of variance x = s2 (1 - c), a shared one of y = s2 c. With z = 1 / (1/(n sd^2) + x),
    the determinant lemma and the Sherman-Morrison formula give determinant and inverse.
    """
    k = group.max(initial=-1) + 1
    x, y = s2 * (1 - c), s2 * c
    m = n * sd * sd
    z = 1 / (1 / m + x)
    total = lambda v: np.bincount(group, v, k)
    d = 1 + y * total(z)
    log_det = np.log(d) + total(np.log1p(x * m))
    quad = total(n * e * e * (z / m - 1)) - y / d * total(e * z / sd) ** 2
    return -0.5 * (log_det + quad)


def prior_grid(max_alpha2: float = 0.002, herit_per_marker: float = 1e-7, values: list[float] | None = None, weights: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Variances of large effects, and their prior probability for each node."""
    s2 = np.array(values if values else [max_alpha2 / 2, max_alpha2 / 4])
    if weights is not None and len(weights) != len(s2):
        raise ValueError("a weight for each value")
    return s2, np.array(weights) if weights is not None else herit_per_marker / s2 / len(s2)


def sample_block(block: Block, s2: np.ndarray, prior: np.ndarray, iterations: int, burn_in: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Mean over the kept iterations of the effects given the sampled large ones; how often each node had a large one.

    The first factor is never changed: columns A^-1 u of active effects are solved once and combined by
    Woodbury's identity.
    """
    beta_hat = block.given_missing(block.alpha_hat)
    if iterations <= burn_in:
        return block.blup(), np.zeros(len(block.d))
    nodes = block.group.max(initial=-1) + 1
    diagonal = block.beta_cov * block.sd**2 + block.d / block.mean_n
    a_inverse = lambda b, x0=None: solve(block.system, b, diagonal, block.tolerance, x0)
    base = a_inverse(beta_hat)
    own = [np.flatnonzero((block.group == g) & block.seen) for g in range(nodes)]
    columns: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def factors(g: int) -> list[np.ndarray]:
        """Columns whose squares add up to the covariance of unit variance that a large effect of node g adds."""
        out, rows = [], own[g]
        if block.cross > 0 or len(rows) == 1:
            u = np.zeros(len(block.d))
            u[rows] = block.sd[rows] * (math.sqrt(block.cross) if len(rows) > 1 else 1.0)
            out.append(u)
        if len(rows) > 1 and block.cross < 1:
            for r in rows:
                u = np.zeros(len(block.d))
                u[r] = block.sd[r] * math.sqrt(1 - block.cross)
                out.append(u)
        return out

    def solved(active: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        """x of (A + sum s2 u u') x = beta_hat, and the effects."""
        us, cs = [], []
        for g, s in active.items():
            if g not in columns:
                columns[g] = [(u, a_inverse(u)) for u in factors(g)]
            for u, c in columns[g]:
                us.append(math.sqrt(s) * u)
                cs.append(math.sqrt(s) * c)
        if not us:
            return base, block.covariance(base)
        u, c = np.stack(us, axis=1), np.stack(cs, axis=1)
        x = base - c @ np.linalg.solve(np.eye(u.shape[1]) + u.T @ c, u.T @ base)
        return x, block.covariance(x) + u @ (u.T @ x)

    seen_nodes = np.array([len(r) > 0 for r in own])
    rows, group = np.flatnonzero(block.seen), block.group[block.seen]
    sd, n = block.sd[rows], block.nodes["n"].to_numpy(float)[rows]
    expected = nodes * prior.sum()
    slots: list[tuple[int, int] | None] = [None] * max(1, math.ceil(expected + 2 * math.sqrt(expected)))
    mean, kept, warm, picked = np.zeros(len(block.d)), 0, None, np.zeros(nodes)
    log_prior = np.log(np.maximum(prior, 1e-300))

    def active() -> dict[int, float]:
        out: dict[int, float] = {}
        for s in slots:
            if s is not None:
                out[s[1]] = out.get(s[1], 0.0) + s2[s[0]]
        return out

    table, beta = None, None
    for it in range(iterations):
        zero_prior = max(1 - prior.sum() * nodes / len(slots), 1e-12)
        for j in range(len(slots)):
            if slots[j] is not None or table is None:
                slots[j] = None
                _, beta = solved(active())
                fitted = solve(block.precision, beta, block.d, block.tolerance, warm)
                warm = fitted
                residual = (block.alpha_hat - fitted)[rows]
                if len(np.unique(block.nodes["pop"])) > 1:
                    logs = np.stack([joint_log_bayes_factor(sd, residual, n, v, block.cross, group) for v in s2])
                    logs = np.pad(logs, ((0, 0), (0, nodes - logs.shape[1])))
                else:
                    logs = np.zeros((len(s2), nodes))
                    for k, v in enumerate(s2):
                        logs[k, group] = log_bayes_factor(sd, residual, n, v)
                logs = np.where(seen_nodes[None, :], logs + log_prior[:, None], -np.inf)
                top = logs.max()
                table = np.exp(logs - top)
                total = table.sum() / len(slots)
                empty = zero_prior / (zero_prior + total * math.exp(min(top, 700)))
            if rng.random() >= empty:
                pick = np.searchsorted(np.cumsum(table.ravel()), rng.random() * table.sum())
                slots[j] = (int(pick) // nodes, int(pick) % nodes)
                table = None
        if it >= burn_in:
            _, beta = solved(active())
            mean += beta
            picked[list(active())] += 1
            kept += 1
        used = sum(s is not None for s in slots)
        slots += [None] * max(0, used + math.ceil(2 * math.sqrt(used)) - len(slots))
    return mean / kept, (picked / kept)[block.group]


def pgs(
    nodes: DataFrame, edges: DataFrame, alpha: float = -0.5, beta_cov: float = 1e-7, cross_corr: float = 0.9, tolerance: float = 1e-10, iterations: int = 10, burn_in: int = 2, seed: int = 0,
    max_alpha2: float = 0.002, herit_per_marker: float = 1e-7, values: list[float] | None = None, weights: list[float] | None = None, ld_block: int | None = None, record_weights: bool = False,
) -> DataFrame:
    """(ld_block, pop, ld_node, es[, gw]); gw is how often the node had a large effect. Each block draws from a generator of its own, seeded by ``seed`` and the block.

    With no more iterations than the burn-in the result is that of :func:`locusloom.operators.ld.blup`.
    """
    if ld_block is not None:
        nodes, edges = nodes.where(F.col("ld_block") == ld_block), edges.where(F.col("ld_block") == ld_block)
    if iterations <= burn_in:
        out = blup(nodes, edges, alpha, beta_cov, cross_corr, tolerance)
        return out.withColumn("gw", F.lit(0.0)) if record_weights else out
    s2, prior = prior_grid(max_alpha2, herit_per_marker, values, weights)

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        block = Block(n, e, alpha, beta_cov, cross_corr, tolerance)
        rng = np.random.Generator(np.random.PCG64([seed, int(n["ld_block"].iloc[0])]))
        beta, large = sample_block(block, s2, prior, iterations, burn_in, rng)
        out = block.effects(beta)
        return out.assign(gw=large[block.seen]) if record_weights else out

    columns = nodes.select("ld_block", "pop", "ld_node", "aa", *[F.col(c).cast("double").alias(c) for c in ("af", "ld_diagonal", "z", "n")])
    return columns.groupBy("ld_block").cogroup(edges.groupBy("ld_block")).applyInPandas(run, _schema(nodes) + (", gw double" if record_weights else ""))
