"""Tail probabilities against closed forms, sums of binomial terms and numerical integrals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.functions import tails
from grainmill.operators import predict as pr
from grainmill.plans import catalog


def values(spark, data, schema, expression):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(data)], "k long, " + schema)
    return [r["v"] for r in df.select("k", expression.alias("v")).orderBy("k").collect()]


def test_log_gamma(spark):
    at = [0.5, 1.0, 2.5, 7.0, 33.3, 1e4, 3e7]
    got = values(spark, [(x,) for x in at], "x double", tails.log_gamma(F.col("x")))
    assert got == pytest.approx([math.lgamma(x) for x in at], rel=1e-12, abs=1e-9)


def test_beta_of_whole_numbers_is_a_binomial_sum(spark):
    cases = [(a, b, x) for a in (1, 2, 7, 40) for b in (1, 3, 25) for x in (0.0, 0.01, 0.3, 0.5, 0.77, 0.999, 1.0)]
    want = [sum(math.comb(a + b - 1, j) * x**j * (1 - x) ** (a + b - 1 - j) for j in range(a, a + b)) for a, b, x in cases]
    got = values(spark, cases, "a int, b int, x double", tails.regularised_beta(F.col("a"), F.col("b"), F.col("x")))
    assert got == pytest.approx(want, abs=1e-11)


def test_t_and_f_in_closed_form(spark):
    t = [0.0, 0.4, 1.0, 3.0, -12.0, 1e4]
    one = [1 - 2 * math.atan(abs(x)) / math.pi for x in t]
    two = [1 - abs(x) / math.sqrt(2 + x * x) for x in t]
    got = [values(spark, [(x, n) for x in t], "t double, n long", tails.t_tails(F.col("t"), F.col("n"))) for n in (1, 2)]
    assert got[0] == pytest.approx(one, abs=1e-11) and got[1] == pytest.approx(two, abs=1e-11)
    f = [(x, d) for x in (0.0, 0.2, 1.0, 5.0, 60.0) for d in (2, 9, 400)]
    assert values(spark, f, "f double, d int", tails.f_tail(F.col("f"), F.lit(2), F.col("d"))) == pytest.approx([(1 + 2 * x / d) ** (-d / 2) for x, d in f], abs=1e-11)
    assert values(spark, f, "f double, d int", tails.f_tail(F.col("f"), F.lit(1), F.col("d"))) == pytest.approx(values(spark, f, "f double, d int", tails.t_tails(F.sqrt("f"), F.col("d"))), abs=1e-11)


def test_many_degrees_near_the_normal_law(spark):
    """With a billion degrees of freedom t is normal to nine digits; so are the terms that the fraction takes then."""
    z = [0.1, 1.0, 2.5]
    assert values(spark, [(x,) for x in z], "z double", tails.t_tails(F.col("z"), F.lit(10_000_000))) == pytest.approx([math.erfc(x / math.sqrt(2)) for x in z], abs=1e-6)


def test_normal(spark):
    z = [0.0, 1e-9, 0.5, -1.96, 3.0, 5.9, 5.999999, 6.0, 9.0, 30.0]
    got = values(spark, [(x,) for x in z], "z double", tails.normal_tails(F.col("z")))
    assert got == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in z], abs=1e-13)
    assert got[-3:] == pytest.approx([math.erfc(x / math.sqrt(2)) for x in z[-3:]], rel=1e-9)


def test_signed_ranks_with_ties(spark):
    rng = np.random.default_rng(6)
    d = rng.integers(-4, 7, 300).astype(float)
    got = pr.wilcoxon_test(spark.createDataFrame([(x, 0.0) for x in d.tolist()], "a double, b double"), "a", "b").first()
    d = d[d != 0]
    size, n = np.abs(d), len(d)
    levels, at, times = np.unique(size, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[at]
    plus = rank[d > 0].sum()
    z = (plus - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ((times**3 - times) / 48).sum())
    assert (got["n"], got["w_plus"]) == (n, plus) and got["z"] == pytest.approx(z) and got["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-12)
    assert pr.wilcoxon_test(spark.createDataFrame([(1.0, 1.0)], "a double, b double"), "a", "b").first()["p"] is None


def test_queries(spark, sf_dir):
    t = catalog.QUERIES["t3_correlation_test"](spark, sf_dir).first()
    law = lambda x, v: math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) - (v + 1) / 2 * math.log1p(x * x / v))
    x = np.linspace(0, abs(t["t"]), 20001)
    y = np.array([law(v, t["n"] - 2) for v in x])
    assert t["p"] == pytest.approx(1 - 2 * np.trapezoid(y, x), abs=1e-7)
    f = catalog.QUERIES["t1_shape_test"](spark, sf_dir).first()
    assert 0 <= f["p"] <= 1 and f["f"] == pytest.approx(catalog.QUERIES["t1_shape_f"](spark, sf_dir).first()["f"])
    assert 0 <= catalog.QUERIES["t2_wilcoxon_test"](spark, sf_dir).first()["p"] <= 1
