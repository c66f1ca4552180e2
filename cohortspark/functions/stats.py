"""Tail probabilities as column expressions, so test tables stay lazy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIES_TERMS = 60
SWITCH = 2.5


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def erfc(c: Column | str) -> Column:
    """Complementary error function for x >= 0: series below 2.5, continued fraction above."""
    x = _col(c).cast("double")
    square = x * x
    # sum of 2^n x^(2n+1) / (2n+1)!!, all terms positive
    start = F.struct(x.alias("total"), x.alias("term"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)),
        start,
        lambda s, n: F.struct(
            (s["total"] + s["term"] * 2.0 * square / (2.0 * n + 1.0)).alias("total"),
            (s["term"] * 2.0 * square / (2.0 * n + 1.0)).alias("term"),
        ),
        lambda s: s["total"],
    )
    small = F.lit(1.0) - F.lit(2.0) / F.sqrt(F.lit(3.141592653589793)) * F.exp(-square) * series
    fraction = F.aggregate(
        F.sequence(F.lit(SERIES_TERMS), F.lit(1)), F.lit(0.0), lambda f, k: (k / 2.0) / (F.greatest(x, F.lit(SWITCH)) + f)
    )
    large = F.exp(-square) / (F.sqrt(F.lit(3.141592653589793)) * (F.greatest(x, F.lit(SWITCH)) + fraction))
    return F.when(x < SWITCH, small).otherwise(large)


def two_sided_p(z: Column | str) -> Column:
    """Two-sided normal p-value."""
    return erfc(F.abs(_col(z)) / F.sqrt(F.lit(2.0)))


def kolmogorov_p(c: Column | str) -> Column:
    """Asymptotic tail of the Kolmogorov statistic: 2 Σ (-1)^(k-1) exp(-2 k² λ²)."""
    lam = _col(c).cast("double")
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    return F.when(lam < 0.04, F.lit(1.0)).otherwise(F.least(F.greatest(total * 2, F.lit(0.0)), F.lit(1.0)))
