"""Distribution functions: as Spark columns where closed forms serve, in numpy for the kernels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rational approximation of the inverse normal distribution (Acklam): fixed published coefficients.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(c, x):
    out = c[0]
    for k in c[1:]:
        out = out * x + k
    return out


def norm_ppf(p: float) -> float:
    """Inverse normal distribution, refined by one Halley step to double precision."""
    if not 0 < p < 1:
        return math.nan if not 0 <= p <= 1 else math.copysign(math.inf, p - 0.5)
    if p < 0.02425 or p > 1 - 0.02425:
        q = math.sqrt(-2 * math.log(min(p, 1 - p)))
        x = math.copysign(_poly(_C, q) / (_poly(_D, q) * q + 1), p - 0.5)
    else:
        q = p - 0.5
        x = _poly(_A, q * q) * q / (_poly(_B, q * q) * q * q + 1)
    e = 0.5 * math.erfc(-x / math.sqrt(2)) - p
    u = e * math.sqrt(2 * math.pi) * math.exp(x * x / 2)
    return x - u / (1 + x * u / 2)


def ppf(p: Column) -> Column:
    """Inverse normal distribution as a column (absolute error under 2e-9)."""
    tail = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    q = p - 0.5
    far = F.signum(q) * F.abs(_poly([F.lit(c) for c in _C], tail) / (_poly([F.lit(c) for c in _D], tail) * tail + 1))
    near = _poly([F.lit(c) for c in _A], q * q) * q / (_poly([F.lit(c) for c in _B], q * q) * q * q + 1)
    return F.when((p <= 0) | (p >= 1), None).when((p < 0.02425) | (p > 1 - 0.02425), far).otherwise(near)


def phi(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def cdf(x: Column) -> Column:
    """Normal distribution as a column: a rational approximation of erfc with relative error under 1.2e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    k = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223]
    tail = 0.5 * t * F.exp(-z * z + _poly([F.lit(c) for c in k], t))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    tail = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma, for chi-square tails."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def expected_max_normal(n: int) -> float:
    """E[max of n standard normals] by quadrature."""
    x = np.linspace(-8, 8, 4001)
    cdf_x = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    pdf = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    return float(np.trapezoid(x * n * cdf_x ** (n - 1) * pdf, x))
