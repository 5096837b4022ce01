"""Tail probabilities of the normal, t and F distributions as column expressions, from continued fractions and series."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series ten steps up, taken down again."""
    z = z.cast("double")
    down = F.lit(0.0)
    for k in range(10):
        down = down + F.log(z + k)
    w = z + 10
    series = F.lit(1 / 12) / w - F.lit(1 / 360) / F.pow(w, 3) + F.lit(1 / 1260) / F.pow(w, 5) - F.lit(1 / 1680) / F.pow(w, 7)
    return (w - 0.5) * F.log(w) - w + F.lit(0.5 * math.log(2 * math.pi)) + series - down


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz' method; terms grow with the root of a and b."""
    sure = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)
    terms = F.ceil(6 * F.sqrt(F.greatest(a, b))).cast("int") + 60
    first = 1 / sure(1 - (a + b) * x / (a + 1))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            # d and c of one step are used twice each, so they are bound before they are used
            s = _let(F.struct((1 / sure(1 + term * s["d"])).alias("d"), sure(1 + term / s["c"]).alias("c"), s["h"].alias("h")), lambda v: F.struct(v["d"].alias("d"), v["c"].alias("c"), (v["h"] * v["d"] * v["c"]).alias("h")))
        return s

    start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), terms), start, lambda s, m: _let(s, lambda v: step(v, m.cast("double"))), lambda s: s["h"])


def regularised_beta(a: Column, b: Column, x: Column) -> Column:
    """I_x(a, b) for a, b > 0 and x in [0, 1]; null where an argument is."""
    a, b, x = (c.cast("double") for c in (a, b, x))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    inner = F.when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inner)


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """The probability that F with d1 and d2 degrees of freedom is at least f."""
    return regularised_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * F.greatest(f, F.lit(0.0))))


def t_tails(t: Column, degrees: Column) -> Column:
    """The probability that t with so many degrees of freedom is at least as far from 0, on both sides."""
    return regularised_beta(degrees / 2, F.lit(0.5), degrees / (degrees + t * t))


def normal_tails(z: Column) -> Column:
    """The probability that a normal number is at least as far from 0 as z: 1 less a series of positive terms, and from 6 on a continued fraction."""
    x = F.abs(z.cast("double"))
    near = F.aggregate(F.sequence(F.lit(1), F.lit(120)), F.struct(x.alias("term"), x.alias("sum")), lambda s, k: _let(s["term"] * x * x / (2 * k + 1), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum"))), lambda s: s["sum"])
    density = F.exp(-x * x / 2) * F.lit(math.sqrt(2 / math.pi))
    far = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda s, k: x + k / s)
    return F.when(x < 6, F.greatest(1 - density * near, F.lit(0.0))).otherwise(density / far)
