"""The standard normal distribution as Column functions: built-in arithmetic only, no Python workers.

Absolute errors are under 1e-14 for :func:`pdf` and :func:`cdf`; the relative
error of :func:`ppf` is under 1e-13.  Null gives null, NaN gives NaN; ``cdf`` of
the infinities is 0 and 1; ``ppf`` of 0 and 1 is an infinity, outside of them NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Hart's rational approximation of the upper tail
# (J. F. Hart, Computer Approximations, 1968, number 5666), highest power first.
TAIL_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TAIL_BREAK = 7.07106781186547

# Coefficients of Wichura's algorithm AS 241 (Applied Statistics,
# 1988), highest power first: the middle, the tails, and the far tails.
MIDDLE_TOP = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608)
MIDDLE_BOTTOM = (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0)
NEAR_TOP = (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734)
NEAR_BOTTOM = (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0)
FAR_TOP = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772)
FAR_BOTTOM = (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0)


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def pdf(x: Column) -> Column:
    """The density at ``x``."""
    x = x.cast("double")
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def cdf(x: Column) -> Column:
    """The share of the distribution up to ``x``."""
    x = x.cast("double")
    size = F.abs(x)
    near = _polynomial(size, TAIL_TOP) / _polynomial(size, TAIL_BOTTOM)
    far = size + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):  # a continued fraction
        far = size + F.lit(k) / far
    tail = F.exp(-size * size / 2) * F.when(size < TAIL_BREAK, near).otherwise(1 / (far * math.sqrt(2 * math.pi)))
    tail = F.when(size > 38, F.lit(0.0)).otherwise(tail)
    return F.when(F.isnan(x), x).when(x > 0, 1 - tail).otherwise(tail)


def ppf(p: Column) -> Column:
    """The point up to which the share is ``p``."""
    p = p.cast("double")
    q = p - 0.5
    square = F.lit(0.180625) - q * q
    middle = q * _polynomial(square, MIDDLE_TOP) / _polynomial(square, MIDDLE_BOTTOM)
    least = F.when(q < 0, p).otherwise(1 - p)
    root = F.sqrt(-F.ln(F.when((p > 0) & (p < 1), least)))
    near = _polynomial(root - 1.6, NEAR_TOP) / _polynomial(root - 1.6, NEAR_BOTTOM)
    far = _polynomial(root - 5, FAR_TOP) / _polynomial(root - 5, FAR_BOTTOM)
    tail = F.when(root <= 5, near).otherwise(far)
    inside = F.when(F.abs(q) <= 0.425, middle).when(q < 0, -tail).otherwise(tail)
    end = F.when(p == 0, -float("inf")).when(p == 1, float("inf")).otherwise(float("nan"))
    return F.when((p > 0) & (p < 1), inside).when(p.isNull(), F.lit(None)).otherwise(end)
