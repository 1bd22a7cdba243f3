"""Tail probabilities and quantiles of Student's t and the normal distribution.

Tails are the density at their edge times the integral of how it falls from there. That integral runs to
infinity and is taken on a scale of its own, by the double-exponential rule, so it holds for a few degrees of
freedom, whose tails are long, as for 1e12, and stays relative however small the tail is. Near the middle the
area from 0 is taken by Simpson's rule. Degrees of freedom may be real.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 200  # Simpson intervals between 0 and MIDDLE
MIDDLE = 1.0
NODES, WIDTH = 120, 0.035  # double-exponential points on either side, and their distance
CLOSE = 1e-12  # relative change of a quantile below which its steps end
MOST_STEPS = 60  # a bound for the longest tails; the steps end long before
SHIFT = 24  # the ratio of gamma functions is taken this far up, where its series is exact


def _central(reach: Column, f) -> Column:
    """Integral of f from 0 to a column of at most MIDDLE."""
    width = reach / F.lit(float(STEPS))

    def term(k: Column) -> Column:
        weight = F.when((k == 0) | (k == STEPS), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
        return weight * f(k * width)

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda total, k: total + term(k)) * width / 3.0


def _falling(excess) -> Column:
    """Integral over w > 0 of exp(-excess(w)), where excess starts like w."""

    def term(k: Column) -> Column:
        at = (k - NODES) * F.lit(WIDTH)
        w = F.exp(F.lit(math.pi / 2) * F.sinh(at))
        return F.exp(-excess(w)) * w * F.lit(math.pi / 2) * F.cosh(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * NODES)), F.lit(0.0), lambda total, k: total + term(k)) * F.lit(WIDTH)


def _peak(df: Column) -> Column:
    """The t density at 0: gamma((df + 1) / 2) / gamma(df / 2) / sqrt(pi * df)."""
    a = df / 2
    up = a + SHIFT
    # gamma(a + 1/2) / gamma(a) by its asymptotic series at `up`, brought down by the recurrence
    series = _polynomial([1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304], 1 / up)
    down = F.aggregate(
        F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(1.0), lambda total, k: total * ((a + k) / (a + k + 0.5))
    )
    return F.sqrt(up) * series * down / F.sqrt(df * math.pi)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for `df` >= 1 degrees of freedom."""
    x = F.abs(t)
    half = (df + 1) / 2
    centre = 1 - 2 * _peak(df) * _central(F.least(x, F.lit(MIDDLE)), lambda y: F.exp(-half * F.log1p(y * y / df)))
    edge = F.greatest(x, F.lit(MIDDLE))
    slope = 2 * half * edge / (df + edge * edge)

    def excess(w: Column) -> Column:
        y = w / slope
        return half * F.log1p(y * (2 * edge + y) / (df + edge * edge))

    tail = 2 * _peak(df) * F.exp(-half * F.log1p(edge * edge / df)) / slope * _falling(excess)
    return F.when(x <= MIDDLE, centre).otherwise(tail)


def t_upper(t: Column, df: Column) -> Column:
    """P(T >= t)."""
    half = t_two_sided(t, df) / 2
    return F.when(t >= 0, half).otherwise(1 - half)


def t_quantile(p: float, df: Column) -> Column:
    """The value that T stays below with probability `p` > 0.5, to about 1e-12 of itself; null if `df` is.

    Third-order steps start at the Cornish-Fisher expansion around the normal quantile, which no t quantile lies
    below, and end as soon as one changes no more than CLOSE: a few do, more only in the long tails of few degrees
    of freedom.
    """
    wanted = 2 * (1 - p)
    half = (df + 1) / 2
    peak = _peak(df)
    z = normal_quantile(F.lit(p))
    expanded = z
    for power, numerator in enumerate(_CORNISH_FISHER, 1):
        expanded = expanded + z * _polynomial(numerator, z * z) / F.pow(df, F.lit(float(power)))

    def step(state: Column, _: Column) -> Column:
        x = state["x"]
        density = state["peak"] * F.exp(-half * F.log1p(x * x / df))
        newton = (t_two_sided(x, df) - wanted) / (2 * density)
        bend = F.greatest(1 - newton * half * x / (df + x * x), F.lit(0.5))
        return F.struct(F.greatest(x + newton / bend, z).alias("x"), state["x"].alias("before"), state["peak"].alias("peak"))

    def on(state: Column, k: Column) -> Column:
        return F.when(F.abs(state["x"] - state["before"]) <= CLOSE * state["x"], state).otherwise(step(state, k))

    start = F.struct(F.greatest(expanded, z).alias("x"), F.lit(0.0).alias("before"), peak.alias("peak"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_STEPS)), start, on, lambda state: state["x"])
    return F.when(df.isNotNull(), found)


def normal_upper(z: Column) -> Column:
    """P(Z >= z) of the standard normal distribution."""
    x = F.abs(z)
    peak = F.lit(1 / math.sqrt(2 * math.pi))
    centre = 0.5 - peak * _central(F.least(x, F.lit(MIDDLE)), lambda y: F.exp(-y * y / 2))
    edge = F.greatest(x, F.lit(MIDDLE))
    far = peak * F.exp(-edge * edge / 2) / edge * _falling(lambda w: w + w * w / (2 * edge * edge))
    tail = F.when(x <= MIDDLE, centre).otherwise(far)
    return F.when(z >= 0, tail).otherwise(1 - tail)


# Terms of the expansion of t by 1 / df, as z times polynomials in z * z.
_CORNISH_FISHER = [
    [1 / 4, 1 / 4],
    [3 / 96, 16 / 96, 5 / 96],
    [-15 / 384, 17 / 384, 19 / 384, 3 / 384],
]

# Rational approximation of the normal quantile (Wichura 1988, AS 241, PPND16).
_CENTRE_NUM = [
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
]
_CENTRE_DEN = [
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
]
_MIDDLE_NUM = [
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
]
_MIDDLE_DEN = [
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
]
_FAR_NUM = [
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
]
_FAR_DEN = [
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
]


def _polynomial(coefficients: list[float], x: Column) -> Column:
    """coefficients[0] + coefficients[1] * x + ..."""
    value = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        value = value * x + F.lit(c)
    return value


def normal_quantile(p: Column) -> Column:
    """The value a standard normal variable stays below with probability `p`."""
    q = p - 0.5
    r_centre = F.lit(0.180625) - q * q
    r_tail = F.sqrt(-F.log(F.least(p, 1 - p)))
    centre = q * _polynomial(_CENTRE_NUM, r_centre) / _polynomial(_CENTRE_DEN, r_centre)
    middle = _polynomial(_MIDDLE_NUM, r_tail - 1.6) / _polynomial(_MIDDLE_DEN, r_tail - 1.6)
    far = _polynomial(_FAR_NUM, r_tail - 5) / _polynomial(_FAR_DEN, r_tail - 5)
    tail = F.when(r_tail <= 5, middle).otherwise(far)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * tail)
