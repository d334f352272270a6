"""Statistics: tiers, intervals and shrinkage as columns; tails and quantiles as numpy kernels."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values shared by the operators.
ESTABLISHED, EVOLVING = 100, 30
STRENGTH = 15.0
JEFFREYS_UP_TO = 40
Z95 = 1.959963984540054


def tier(n: Column) -> Column:
    return F.when(n >= ESTABLISHED, "established").when(n >= EVOLVING, "evolving").otherwise("speculative")


def shrink(wins: Column, n: Column, prior: Column | float = 0.5, strength: float = STRENGTH) -> Column:
    """Posterior mean of a rate under a prior of the given mean and strength."""
    p = F.lit(prior) if isinstance(prior, float) else prior
    return (p * F.lit(strength) + wins) / (F.lit(strength) + n)


def wilson(wins: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval, clamped to [0, 1]; (0, 1) without games."""
    p, z2 = wins / F.nullif(n, F.lit(0)), z * z
    mid, half = p + z2 / (2 * n), F.lit(z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    lo, hi = (mid - half) / (1 + z2 / n), (mid + half) / (1 + z2 / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), lo)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), hi))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        k = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        else:
            num = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if i and abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def beta_ppf(q: float, a: float, b: float) -> float:
    """Quantile of a beta distribution, by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < q else (lo, mid)
    return (lo + hi) / 2


def interval(wins: float, n: float, alpha: float = 0.05) -> tuple[float, float]:
    """Jeffreys interval up to 40 games, Wilson's above, (0, 1) without games."""
    if n <= 0:
        return 0.0, 1.0
    if n <= JEFFREYS_UP_TO:
        return beta_ppf(alpha / 2, wins + 0.5, n - wins + 0.5), beta_ppf(1 - alpha / 2, wins + 0.5, n - wins + 0.5)
    z = NormalDist().inv_cdf(1 - alpha / 2)
    p = wins / n
    mid, half, den = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return max(0.0, (mid - half) / den), min(1.0, (mid + half) / den)


@F.pandas_udf(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
def interval_udf(wins: pd.Series, n: pd.Series) -> pd.DataFrame:
    known = {k: interval(*k) for k in set(zip(wins, n))}
    return pd.DataFrame([known[k] for k in zip(wins, n)], columns=["lo", "hi"])


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact p of a 2x2 table; empty margins give 1."""
    n1, n2, k = a + b, c + d, a + c
    if min(n1, n2, k, b + d) == 0:
        return 1.0
    lf = math.lgamma

    def lp(x: int) -> float:
        return lf(n1 + 1) - lf(x + 1) - lf(n1 - x + 1) + lf(n2 + 1) - lf(k - x + 1) - lf(n2 - k + x + 1) - lf(n1 + n2 + 1) + lf(k + 1) + lf(n1 + n2 - k + 1)

    seen = lp(a)
    return min(1.0, sum(math.exp(v) for x in range(max(0, k - n2), min(k, n1) + 1) if (v := lp(x)) <= seen + 1e-7))


@F.pandas_udf(T.DoubleType())
def fisher_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    known = {k: fisher(*map(int, k)) for k in set(zip(a, b, c, d))}
    return pd.Series([known[k] for k in zip(a, b, c, d)])


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of the chi-squared distribution, by series or continued fraction of the incomplete gamma function."""
    if x <= 0 or k <= 0:
        return 1.0
    a, x = k / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        i = a
        while abs(term) > abs(total) * 1e-15:
            i += 1
            term *= x / i
            total += term
        return max(0.0, 1 - front * total)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def chi2_sf_udf(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else chi2_sf(float(a), float(b)) for a, b in zip(x, k)])


def optimal_partition(cost, n: int, penalty: float, least: int) -> list[int]:
    """Change points of the exact penalised segmentation; cost(i, j) is that of points i..j-1, for an array of starts i."""
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
    best[0] = -penalty
    for j in range(least, n + 1):
        i = np.flatnonzero(np.isfinite(best[: j - least + 1]))
        v = best[i] + cost(i, j) + penalty
        k = int(np.flatnonzero(v <= v.min() + 1e-12)[0])  # the earliest of equal ones
        best[j], back[j] = v[k], i[k]
    out, j = [], n
    while j > 0 and back[j] > 0:
        out.append(int(back[j]))
        j = back[j]
    return sorted(out)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers, by Stirling's series after a shift by seven."""
    x = np.asarray(x, dtype=float)
    y = x + 7
    low = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6))
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - low


def _lbeta(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return lgamma(x) + lgamma(y) - lgamma(x + y)


def bocpd_step(state: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, n: int, hazard: float = 1 / 25, a: float = 1.0, b: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the run length (probabilities, alphas, betas) after one more beta-binomial observation.

    Weights are kept as logarithms until they are scaled by the largest, so an observation that no run explains leaves
    the most likely ones and never a division by zero. Lengths under 1e-9, but for the two shortest, are dropped.
    """
    run, al, be = state
    with np.errstate(divide="ignore"):
        w = np.log(run) + _lbeta(al + k, be + n - k) - _lbeta(al, be)
    w = np.exp(w - w.max())
    post = np.append(hazard * w.sum(), (1 - hazard) * w)
    post /= post.sum()
    al, be = np.append(a, al + k), np.append(b, be + n - k)
    keep = (post > 1e-9) | (np.arange(len(post)) < 2)
    return post[keep], al[keep], be[keep]


def bocpd(successes: np.ndarray, trials: np.ndarray, hazard: float = 1 / 25, a: float = 1.0, b: float = 1.0) -> np.ndarray:
    """Probability after each point that the run began with it or the one before; beta-binomial observations."""
    state, out = (np.array([1.0]), np.array([a]), np.array([b])), []
    for k, n in zip(successes, trials):
        state = bocpd_step(state, k, n, hazard, a, b)
        out.append(state[0][:2].sum())
    return np.array(out)
