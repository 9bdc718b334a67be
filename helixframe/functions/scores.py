"""Score arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.constants import PROB_EPSILON


def clip_prob(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(PROB_EPSILON)), F.lit(1.0 - PROB_EPSILON))


def orient(score: Column, higher_is_positive: bool = True) -> Column:
    return score if higher_is_positive else -score


def log_loss_term(y: Column, p: Column) -> Column:
    q = clip_prob(p)
    return -F.when(y == 1, F.ln(q)).otherwise(F.ln(1.0 - q))


def missing_flag(c: Column) -> Column:
    return c.isNull().cast("int")


def finite(c: Column) -> Column:
    """Infinities and NaN to NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


#: Step and terms of the midpoint rule below; with them the error is below 1e-13.
ERFC_STEP = 0.5
ERFC_TERMS = 13


def erfc(x: Column) -> Column:
    """Complementary error function of a column of non-negative numbers.

    erfc(x) = (2 x exp(-x^2) / pi) * integral of exp(-t^2) / (x^2 + t^2) over t > 0, by the midpoint
    rule, whose only notable error, from the pole at t = ix, has a closed form.
    """
    h = ERFC_STEP
    square = x * x
    total = F.lit(0.0)
    for k in range(ERFC_TERMS):
        t = (k + 0.5) * h
        total = total + F.lit(math.exp(-t * t)) / (square + F.lit(t * t))
    body = F.lit(2.0 * h / math.pi) * x * F.exp(-square) * total
    pole = F.when(x < F.lit(math.pi / h), F.lit(2.0) / (F.lit(1.0) + F.exp(F.lit(2.0 * math.pi / h) * x))).otherwise(0.0)
    return body + pole


def two_sided_normal(z: Column) -> Column:
    """Two-sided tail of a standard normal statistic; null for null and NaN."""
    usable = F.nanvl(z.cast("double"), F.lit(None).cast("double"))
    return erfc(F.abs(usable) / F.lit(math.sqrt(2.0)))


#: Steps of the recurrence below; from there on seven terms of the series are exact to rounding.
RATIO_STEPS = 24
# --- Fixed values: coefficients of the series of gamma(a + 1/2) / (gamma(a) sqrt(a)) in 1 / a ---
RATIO_SERIES = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304)


def gamma_ratio(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a) for positive a, without the cancellation of two logarithms."""
    far = a + F.lit(float(RATIO_STEPS))
    series = F.lit(0.0)
    for c in reversed(RATIO_SERIES):
        series = series / far + F.lit(c)
    out = F.sqrt(far) * series
    for i in range(RATIO_STEPS):
        out = out * (a + float(i)) / (a + (i + 0.5))
    return out


def beta_fraction(a: Column, b: Column, x: Column, terms: Column) -> Column:
    """Continued fraction of the incomplete beta function, evaluated forwards (modified Lentz)."""
    tiny = F.lit(1e-300)

    def safe(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def step(state: Column, m: Column) -> Column:
        m = m.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = 1 / safe(1 + even * state["d"]), safe(1 + even / state["c"])
        d2, c2 = 1 / safe(1 + odd * d1), safe(1 + odd / c1)
        return F.struct((state["h"] * d1 * c1 * d2 * c2).alias("h"), c2.alias("c"), d2.alias("d"))

    d = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(d.alias("h"), F.lit(1.0).alias("c"), d.alias("d"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), terms), start, step, lambda s: s["h"])


def two_sided_student(t_share: Column, freedom: Column) -> Column:
    """Two-sided tail of Student's t with `freedom` degrees, as the regularised incomplete beta function.

    `t_share` is t^2 / (freedom + t^2), for a correlation its square; null for null, for a share
    outside [0, 1] and without degrees of freedom. The fraction takes a number of terms that grows with the
    root of the degrees, so the error stays near rounding for every table.
    """
    share = t_share.cast("double")
    half = freedom.cast("double") / 2
    terms = F.lit(60).cast("long") + F.ceil(4 * F.sqrt(half)).cast("long")
    common = F.exp(half * F.log1p(-share)) * F.sqrt(share) * gamma_ratio(half) / F.lit(math.sqrt(math.pi))
    upper = common / half * beta_fraction(half, F.lit(0.5), 1 - share, terms)
    lower = 1 - common / F.lit(0.5) * beta_fraction(F.lit(0.5), half, share, terms)
    inside = F.when(1 - share < (half + 1) / (half + 2.5), upper).otherwise(lower)
    value = F.when(share == 0, 1.0).when(share == 1, 0.0).otherwise(F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0)))
    return F.when(share.between(0, 1) & (freedom > 0), value)
