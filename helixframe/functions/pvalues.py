"""p-values that Spark has no function for: of the normal and chi-square distributions as column arithmetic, exact ones as vectorized helpers for the few rows that ask for them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])

#: Cody's rational approximations of the error function (1969): numerators and denominators, highest power first, for |x| up to 0.46875 (in x squared), up to 4 (in x), and beyond (in 1 / x squared).
ERF = ((1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
ERFC_NEAR = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
ERFC_FAR = ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3))


def _ratio(x: Column, both: tuple[Sequence[float], Sequence[float]]) -> Column:
    top, bottom = (F.lit(p[0]) for p in both)
    for a, b in zip(both[0][1:], both[1][1:], strict=True):
        top, bottom = top * x + a, bottom * x + b
    return top / bottom


def erfc(x: Column) -> Column:
    """The complementary error function of numbers from 0 on, to about 15 digits; null stays null. x is used many times, so give a column of its own."""
    # exp(-x * x) in two factors, as x * x loses digits where it is large.
    cut = F.floor(x * 16) / 16
    bell = F.exp(-cut * cut) * F.exp(-(x - cut) * (x + cut))
    z = 1 / (x * x)
    far = bell / x * (1 / math.sqrt(math.pi) - z * _ratio(z, ERFC_FAR))
    return F.when(x <= 0.46875, 1 - x * _ratio(x * x, ERF)).when(x <= 4, bell * _ratio(x, ERFC_NEAR)).when(x < 27, far).when(x.isNotNull(), 0.0)


@lru_cache(256)
def u_counts(m: int, n: int) -> tuple[int, ...]:
    """How many of the orders of m and n distinct values give each U from 0 to m * n."""
    ways = [1] + [0] * (m * n)
    for i in range(1, m + 1):  # times (1 - x ** (n + i)) / (1 - x ** i)
        for u in range(m * n, n + i - 1, -1):
            ways[u] -= ways[u - n - i]
        for u in range(i, m * n + 1):
            ways[u] += ways[u - i]
    return tuple(ways)


@lru_cache(256)
def u_tails(m: int, n: int) -> np.ndarray:
    """The share of orders of m and n distinct values with a U of at least 0, 1, ..., m * n."""
    tail, out = 0, []
    for w in reversed(u_counts(m, n)):
        tail += w
        out.append(tail / math.comb(m + n, m))
    return np.array(out[::-1])


def exact_u_p(u: float, m: int, n: int) -> float:
    """Two-sided p of the larger U among all orders, without ties."""
    return min(1.0, 2 * float(u_tails(min(m, n), max(m, n))[int(max(u, m * n - u))]))


@F.pandas_udf(DoubleType())
def exact_u_test(u: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    """exact_u_p() of each row; the tails of each pair of sizes are made once in a worker."""
    f = pd.DataFrame({"u": u, "m": np.minimum(n_a, n_b).astype(int), "n": np.maximum(n_a, n_b).astype(int)})
    out = np.zeros(len(f))
    for (m, n), rows in f.groupby(["m", "n"]).indices.items():
        v = f["u"].to_numpy()[rows]
        out[rows] = np.minimum(1.0, 2 * u_tails(m, n)[np.maximum(v, m * n - v).astype(int)])
    return pd.Series(out)


#: A test is exact if nothing ties and a group has so many values at most.
EXACT = 8


def u_erfc_argument(u: Column, n_a: Column, n_b: Column, ties: Column) -> Column:
    """Of a Mann-Whitney test (U, the group sizes and the sum of t ** 3 - t over ties) what erfc() has as its p: normal with tie correction and continuity. 0 or less stands for a p of 1, which is also that of equal values; null for an empty group."""
    a, b = n_a.cast("double"), n_b.cast("double")
    n = a + b
    spread = F.sqrt(a * b / 12 * ((n + 1) - F.when(n > 1, ties / (n * (n - 1))).otherwise(0.0)))
    z = (F.greatest(u, a * b - u) - a * b / 2 - 0.5) / F.when(spread > 0, spread) / math.sqrt(2)
    return F.when((a > 0) & (b > 0), F.greatest(F.coalesce(z, F.lit(0.0)), F.lit(0.0)))


def chi2_p(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom; null stays null."""
    return erfc(F.sqrt(x / 2))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of the probabilities of all tables with these margins that are no likelier than this one (but for 1e-7 of it)."""
    row, col, n = a + b, a + c, a + b + c + d
    x = np.arange(max(0, row + col - n), min(row, col) + 1)
    log = lambda top, k: _lgamma(top + 1.0) - _lgamma(k + 1.0) - _lgamma(top - k + 1.0)
    p = np.exp(log(np.full(len(x), row), x) + log(np.full(len(x), n - row), col - x) - log(np.array([n]), np.array([col])))
    return float(min(1.0, p[p <= p[x == a] * (1 + 1e-7)].sum()))


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided Fisher test of tables (a, b; c, d); each distinct table of a batch is computed once."""
    f = pd.DataFrame({"a": a, "b": b, "c": c, "d": d}).astype(int)
    known = {t: fisher_two_sided(*t) for t in set(f.itertuples(index=False, name=None))}
    return pd.Series([known[t] for t in f.itertuples(index=False, name=None)], dtype=float)
