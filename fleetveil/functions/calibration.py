"""Noise scales and the two special functions Spark lacks.

The scalar helpers serve the noise plan, a table of a few hundred parameter rows.
The ``pandas_udf`` forms serve parameter or summary frames of any length.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship the helpers below with the UDFs, so that executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INF = float("inf")


def laplace_scale(sensitivity: float, epsilon: float) -> float:
    if epsilon == INF:
        return 0.0
    return INF if epsilon == 0.0 else sensitivity / epsilon


def classic_gaussian_sigma(sensitivity: float, epsilon: float, delta: float) -> float:
    return sensitivity / epsilon * math.sqrt(2.0 * math.log(1.25 / delta))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def gaussian_delta(sigma: float, sensitivity: float, epsilon: float) -> float:
    """The delta a Gaussian of this sigma achieves (Balle and Wang, 2018)."""
    shift = epsilon * sigma / sensitivity
    half = sensitivity / (2.0 * sigma)
    return normal_cdf(half - shift) - math.exp(epsilon) * normal_cdf(-half - shift)


def analytic_gaussian_sigma(
    sensitivity: float, epsilon: float, delta: float, cap_at_classic: bool = False
) -> float:
    """Smallest sigma that is (epsilon, delta)-private.

    Up to epsilon 1 it lies below the classic bound. Beyond, the classic formula can
    fall short of the guarantee; ``cap_at_classic`` restores the published cap there.
    """
    if epsilon == INF or sensitivity == 0.0:
        return 0.0
    if epsilon == 0.0:
        return INF
    classic = classic_gaussian_sigma(sensitivity, epsilon, delta)
    # Solve in units of the sensitivity, where the guarantee depends on sigma alone.
    low, high = 0.0, classic / sensitivity
    while gaussian_delta(high, 1.0, epsilon) > delta:
        high *= 2.0
    while high - low > 1e-10 * high:
        middle = 0.5 * (low + high)
        if gaussian_delta(middle, 1.0, epsilon) <= delta:
            high = middle
        else:
            low = middle
    sigma = high * sensitivity
    return min(sigma, classic) if cap_at_classic else sigma


def round_up(x: float, digits: int = 5) -> float:
    """To so many significant digits."""
    if x == 0.0 or x == INF:
        return x
    power = 10.0 ** (digits - 1 - math.floor(math.log10(x)))
    return math.ceil(x * power) / power


def released_sigma(epsilon: float, delta: float) -> float:
    """The sigma that releases use, in units of the sensitivity.

    Rounding up adds a little noise and makes the published scale independent of the last digits
    of a search.
    """
    return round_up(analytic_gaussian_sigma(1.0, epsilon, delta))


def with_gaussian_sigma(df: DataFrame, sensitivity: str, epsilon: str, delta: str) -> DataFrame:
    """Add ``sigma`` to a parameter frame, solving once per distinct parameter row."""
    keys = [sensitivity, epsilon, delta]

    @F.pandas_udf(DoubleType())
    def solve(s: pd.Series, e: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([analytic_gaussian_sigma(*row) for row in zip(s, e, d)])

    solved = df.select(*keys).distinct().withColumn("sigma", solve(*keys))
    return df.join(solved, keys)


def _beta_fraction(a: float, b: float, x: float) -> float:
    # Continued fraction of the incomplete beta function, modified Lentz method.
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def regularised_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p_value(rho: float, n: float) -> float:
    """Two-sided p-value of a rank correlation by Student's t with n - 2 degrees."""
    if n is None or rho is None or np.isnan(rho) or np.isnan(n) or n < 3:
        return float("nan")
    if abs(rho) >= 1.0:
        return 0.0
    dof = n - 2.0
    t_squared = rho * rho * dof / (1.0 - rho * rho)
    return regularised_beta(dof / 2.0, 0.5, dof / (dof + t_squared))


@F.pandas_udf(DoubleType())
def correlation_p_value_udf(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p_value(r, k) for r, k in zip(rho, n.astype(float))])
