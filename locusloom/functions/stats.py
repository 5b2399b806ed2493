"""Statistics of association tests as Column expressions, safe far into the tails.

Functions take column *names* where a formula uses its argument many times, so that expressions stay
small. Missing and non-finite arguments give null.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LN10 = math.log(10)
HALF_LN_2PI = 0.5 * math.log(2 * math.pi)
SERIES_TERMS, FRACTION_LEVELS, SPLIT = 30, 40, 2.5


def mills(z: str | Column) -> Column:
    """Upper tail over density of the normal distribution at ``z`` >= 0.

    Below SPLIT the power series of the centre, above it Laplace's continued fraction.
    """
    c = F.col(z) if isinstance(z, str) else z
    centre = F.lit(1.0)
    for k in range(SERIES_TERMS, 0, -1):
        centre = centre * c * c / (2.0 * k + 1) + 1.0
    tail = c
    for k in range(FRACTION_LEVELS, 0, -1):
        tail = F.lit(float(k)) / tail + c
    return F.when(c < SPLIT, F.exp(c * c / 2) * math.sqrt(math.pi / 2) - c * centre).otherwise(F.lit(1.0) / tail)


def log_upper_tail(z: str | Column) -> Column:
    """ln of the normal upper tail at ``z`` >= 0."""
    c = F.col(z) if isinstance(z, str) else z
    return -c * c / 2 - HALF_LN_2PI + F.ln(mills(c))


def two_sided_lp(z: str) -> Column:
    """-log10 of the two-sided p-value of ``z`` >= 0."""
    return -(log_upper_tail(z) + math.log(2)) / LN10


#: Where the pieces of the quantile begin, in t = sqrt(-2 ln(tail)), and their polynomials' degree. Each piece doubles t, so that the
#: nearest singularity is thrice its half-width away and each degree gains a factor of 5.8.
PIECES, DEGREE = (math.sqrt(2 * math.log(2)), 2.0, 4.0, 8.0, 16.0, 32.0, 64.0), 20


def _quantile(t: float) -> float:
    """The z >= 0 whose tail's logarithm is -t^2/2, by Newton's steps."""
    z = max(t - 1.0, 0.0)
    for _ in range(60):
        if z < SPLIT:
            term, total = z, z
            for k in range(1, 60):
                term *= z * z / (2 * k + 1)
                total += term
            ratio = math.exp(z * z / 2) * math.sqrt(math.pi / 2) - total
        else:
            ratio = z
            for k in range(2 * FRACTION_LEVELS, 0, -1):
                ratio = z + k / ratio
            ratio = 1 / ratio
        step = (-z * z / 2 - HALF_LN_2PI + math.log(ratio) + t * t / 2) * ratio
        z = max(z + step, 0.0)
        if abs(step) < 1e-16 * (1 + z):
            break
    return z


@lru_cache(maxsize=1)
def _pieces() -> list[list[float]]:
    """The polynomials of the pieces in [-1, 1], highest power first, from interpolation at Chebyshev's nodes."""
    out = []
    for low, high in zip(PIECES[:-1], PIECES[1:], strict=True):
        fit = np.polynomial.chebyshev.chebinterpolate(lambda x: [_quantile(low + (high - low) * (y + 1) / 2) for y in x], DEGREE)  # noqa: B023
        out.append([float(c) for c in np.polynomial.chebyshev.cheb2poly(fit)[::-1]])
    return out


def with_abs_z(df: DataFrame, lp: str, out: str) -> DataFrame:
    """Add ``out``, the z >= 0 whose two-sided -log10 p is ``lp``, to rounding: a polynomial of t = sqrt(-2 ln(p/2)) on each of a few pieces.

    Beyond the last, z^2 = t^2 - ln(2 pi z^2) + 2 ln(z m), where m is the tail over the density: three rounds, each of which gains a
    factor of z^2. What the polynomial refers to many times are columns of projections before it, and its numbers are looked up by the piece,
    so there is one short formula for all pieces, which is compiled.
    """
    square, t, piece, x = names = [f"_{out}_{c}" for c in ("square", "t", "piece", "x")]
    ok = F.col(lp).isNotNull() & ~F.isnan(lp) & (F.col(lp) >= 0) & (F.col(lp) < float("inf"))
    df = df.withColumn(square, F.when(ok, 2 * (F.col(lp) * LN10 + math.log(2)))).withColumn(t, F.sqrt(square))
    at = F.lit(len(PIECES) - 2)
    for k in range(len(PIECES) - 2, 0, -1):
        at = F.when(F.col(t) < PIECES[k], k - 1).otherwise(at)
    of = lambda values: F.get(F.lit([float(v) for v in values]), F.col(piece))
    bounds = list(zip(PIECES[:-1], PIECES[1:], strict=True))
    scaled = F.col(t) * of(2 / (high - low) for low, high in bounds) - of((high + low) / (high - low) for low, high in bounds)
    df = df.withColumn(piece, at).withColumn(x, scaled)
    powers = list(zip(*_pieces(), strict=True))
    value = of(powers[0])
    for c in powers[1:]:
        value = value * F.col(x) + of(c)
    y = F.col(square) - F.ln(2 * math.pi * F.col(square))
    for _ in range(2):
        y = F.col(square) - F.ln(2 * math.pi * y) + 2 * F.log1p(-1.0 / y + 3.0 / (y * y) - 15.0 / (y * y * y))
    return df.withColumn(out, F.when(F.col(t) < PIECES[-1], F.greatest(value, F.lit(0.0))).otherwise(F.sqrt(y))).drop(*names)


def chi2_lp(x: str, df: str) -> Column:
    """-log10 of the upper tail of chi-squared with an integer column ``df`` of degrees at column ``x``.

    Finite sums: of exp(-x/2) (x/2)^j / j! for even degrees, and of the normal tail for odd ones; ``x``
    must have a companion column ``_root`` = sqrt(x).
    """
    half = F.col(x) / 2
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def grow(ratio):
        return lambda acc, j: F.struct((acc["term"] * ratio(j)).alias("term"), (acc["sum"] + acc["term"] * ratio(j)).alias("sum"))

    def total(n: Column, ratio) -> Column:
        return F.aggregate(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), start, grow(ratio), lambda acc: acc["sum"])

    even = -half + F.ln(total((F.col(df) / 2 - 1).cast("int"), lambda j: half / j))
    odd_sum = F.when(F.col(df) >= 3, F.col("_root") * total(((F.col(df) - 3) / 2).cast("int"), lambda j: F.col(x) / (2 * j + 1))).otherwise(0.0)
    odd = -half - HALF_LN_2PI + F.ln(2 * mills("_root") + 2 * odd_sum)
    return -F.when(F.col(df) % 2 == 0, even).otherwise(odd) / LN10


def effective_n(ne: Column, ns: Column, nc: Column) -> Column:
    """Effective sample size: as given, 4 cases controls / all, or all."""
    return F.coalesce(ne, F.try_divide(4 * (ns - nc) * nc, ns), ns)


def threshold_lp(p: float) -> float:
    return -math.log10(p)


def heterozygosity_sd(af: Column, alpha: float) -> Column:
    """sqrt(2 p (1 - p)) to the power alpha + 1."""
    return F.pow(F.sqrt(2 * af * (1 - af)), F.lit(alpha + 1))


def compress_lp(lp: Column, above: float = 10.0) -> Column:
    """Doubly logarithmic scale beyond ``above``."""
    return F.when(lp > above, above * F.log10(lp) / math.log10(above)).otherwise(lp)


def binomial_lp(a: Column, b: Column) -> Column:
    """-log10 of the two-sided binomial test of a against b at even odds, by logarithms of a running sum."""
    low, n = F.least(a, b).cast("int"), (a + b).cast("int")
    start = F.struct((-n * math.log(2)).alias("term"), (-n * math.log(2)).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] + F.ln((n - k + 1) / k)
        big, small = F.greatest(acc["sum"], term), F.least(acc["sum"], term)
        return F.struct(term.alias("term"), (big + F.ln(1 + F.exp(small - big))).alias("sum"))

    log_cdf = F.aggregate(F.when(low >= 1, F.sequence(F.lit(1), low)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: acc["sum"])
    return F.greatest(-(math.log(2) + log_cdf) / LN10, F.lit(0.0))


@lru_cache(maxsize=1)
def truncated_correlation_series(terms: int = 10) -> np.ndarray:
    """Odd Taylor coefficients of E[XY | |X|, |Y| < 1] in the correlation of a binormal pair.

    By Mehler's expansion both the integral of xy and the probability are power series whose terms are squares of
    integrals of Hermite polynomials; the ratio of the series is cut after ``terms`` odd powers.
    """
    nodes, weights = np.polynomial.legendre.leggauss(80)
    density = np.exp(-nodes * nodes / 2) / math.sqrt(2 * math.pi) * weights
    order = 2 * terms
    he = [np.ones_like(nodes), nodes]
    for k in range(1, order):
        he.append(nodes * he[-1] - k * he[-2])
    top = np.array([(he[k] * nodes * density).sum() ** 2 / math.factorial(k) for k in range(order)])
    bottom = np.array([(he[k] * density).sum() ** 2 / math.factorial(k) for k in range(order)])
    ratio = np.zeros(order)
    for k in range(order):
        ratio[k] = (top[k] - (ratio[:k] * bottom[k:0:-1]).sum()) / bottom[0]
    return ratio[1::2]


def correlation_from_truncated(t: float) -> float:
    """The correlation in [0, 1] whose truncated correlation is nearest to ``t``; 0 below 0."""
    if not t > 0:
        return 0.0
    c = truncated_correlation_series()
    value = lambda r: r * np.polyval(c[::-1], r * r)
    grid = np.linspace(0, 1, 2001)
    best = grid[np.argmin(np.abs(value(grid) - t))]
    lo, hi = max(best - 1e-3, 0.0), min(best + 1e-3, 1.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < t else (lo, mid)
    return float((lo + hi) / 2)
