"""Statistical column functions (X-09)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

# Rational approximation coefficients of the normal quantile
# (Abramowitz & Stegun 26.2.23).
_C = (2.515517, 0.802853, 0.010328)
_D = (1.432788, 0.189269, 0.001308)


def inverse_normal_cdf(p) -> Column:
    """X-09 normal quantile by rational approximation: -inf at p <= 0, +inf at p >= 1,
    0 at .5, mirrored below .5. Pure column math (codegen)."""
    p = col_(p) if not isinstance(p, (int, float)) else F.lit(float(p))
    q = F.when(p < 0.5, 1 - p).otherwise(p)
    t = F.sqrt(-2 * F.log(1 - q))
    approx = t - (_C[0] + _C[1] * t + _C[2] * t * t) / (1 + _D[0] * t + _D[1] * t * t + _D[2] * t * t * t)
    return (F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf")))
            .when(p == 0.5, F.lit(0.0)).when(p < 0.5, -approx).otherwise(approx))


def normal_cdf(z) -> Column:
    """X-09 normal CDF. Spark has no ``erf``; the value comes from an Arrow kernel. Use it
    on aggregated rows (a few per experiment), not on raw data."""
    from .kernels import normal_cdf_udf
    return normal_cdf_udf(col_(z))
