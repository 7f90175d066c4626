"""Normal distribution function and its inverse as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Acklam's rational approximation of the normal quantile
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
         3.754408661907416e00)
PPF_TAIL = 0.02425

# fixed values: Hart's double precision approximation of the normal tail
CDF_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376)
CDF_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
           296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CDF_FAR = 2.506628274631


def _horner(coefs, x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefs[1:], F.lit(coefs[0]))


def norm_ppf(p: Column) -> Column:
    """Quantile of the standard normal; null outside (0, 1)."""
    low = F.sqrt(-2.0 * F.log(p))
    high = F.sqrt(-2.0 * F.log(1.0 - p))
    mid = p - 0.5
    r = mid * mid

    def tail(q):
        return _horner(PPF_C, q) / _horner((*PPF_D, 1.0), q)

    return (
        F.when((p <= 0.0) | (p >= 1.0), F.lit(None).cast("double"))
        .when(p < PPF_TAIL, tail(low))
        .when(p > 1 - PPF_TAIL, -tail(high))
        .otherwise(_horner(PPF_A, r) * mid / _horner((*PPF_B, 1.0), r))
    )


def norm_cdf(x: Column) -> Column:
    """Distribution function of the standard normal, to about 1e-15."""
    z = F.abs(x)
    e = F.exp(-z * z / 2.0)
    near = e * _horner(CDF_NUM, z) / _horner(CDF_DEN, z)
    k = z + 0.65
    for c in (4.0, 3.0, 2.0, 1.0):
        k = z + F.lit(c) / k
    upper = F.when(z > 37.0, F.lit(0.0)).when(z < 7.07106781186547, near).otherwise(e / k / CDF_FAR)
    return F.when(x > 0, 1.0 - upper).otherwise(upper)
