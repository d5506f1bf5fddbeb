"""Column expressions of tail probabilities against plain sums and known values."""

import math

import pytest
from pyspark.sql import functions as F

from fathomset.functions import special as P


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_log_gamma(spark):
    xs = [0.01, 0.5, 1.0, 2.0, 7.3, 150.0, 1e6]
    got = values(spark, [(x,) for x in xs], "x double", P.log_gamma(F.col("x")))
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-12)


def tail(e, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(e + 1))


def test_binomial(spark):
    cases = [(0, 10, 0.2), (3, 10, 0.2), (9, 10, 0.9), (10, 10, 0.5), (40, 300, 0.1), (500, 1000, 0.52)]
    got = values(spark, cases, "e int, n int, p double", P.binomial_tail(F.col("e"), F.col("n"), F.col("p")))
    assert got == pytest.approx([tail(*c) for c in cases], rel=1e-9)
    uppers = values(spark, cases, "e int, n int, p double", P.binomial_upper(F.col("e"), F.col("n"), F.lit(0.05)))
    for (e, n, _), u in zip(cases, uppers, strict=True):
        assert u == 1.0 if e >= n else tail(e, n, u) == pytest.approx(0.05, rel=1e-8)
    both = value(spark, P.binomial_interval(3, 20))
    assert tail(3, 20, both.hi) == pytest.approx(0.025, rel=1e-8) and 1 - tail(2, 20, both.lo) == pytest.approx(0.025, rel=1e-8)
    assert tuple(value(spark, P.binomial_interval(0, 5)))[0] == 0.0 and value(spark, P.binomial_interval(5, 5)).hi == 1.0


def test_chi_square_and_normal(spark):
    # an even number of degrees of freedom has a closed sum; one degree is a normal tail
    cases = [(0.0, 4), (1.5, 2), (9.2, 6), (40.0, 20), (300.0, 200), (1000.0, 4)]
    closed = lambda x, d: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(d // 2))
    got = values(spark, cases, "x double, d int", P.chi2_sf(F.col("x"), F.col("d")))
    assert got == pytest.approx([closed(*c) for c in cases], rel=1e-9)
    for z in (0.0, 0.3, 1.96, 6.0):
        assert value(spark, P.normal_two_sided(z)) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)
    assert value(spark, P.chi2_sf(3.0, 0)) == 1.0


def test_t_and_correlation(spark):
    assert value(spark, P.t_two_sided(1.0, 1)) == pytest.approx(0.5, rel=1e-9)  # Cauchy
    for t in (0.2, 1.3, 5.0):  # two degrees have a closed form
        assert value(spark, P.t_two_sided(t, 2)) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-9)
    assert value(spark, P.correlation_p(1.0, 9)) == 0.0 and value(spark, P.correlation_p(0.3, 2)) is None
    t = 0.4 * math.sqrt(2 / (1 - 0.16))
    assert value(spark, P.correlation_p(-0.4, 4)) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-9)


def test_fisher(spark):
    cases = [(3, 1, 1, 3), (8, 2, 1, 5), (0, 10, 12, 2), (0, 0, 3, 4), (10, 10, 10, 10), (0, 0, 0, 0), (40, 60, 55, 45)]

    def slow(a, b, c, d):
        r, k, n = a + b, a + c, a + b + c + d
        each = {x: math.comb(k, x) * math.comb(n - k, r - x) for x in range(max(0, r + k - n), min(r, k) + 1)}
        return sum(v for v in each.values() if v <= each[a] * (1 + 1e-7)) / sum(each.values()) if n else 1.0
    got = values(spark, cases, "a int, b int, c int, d int", P.fisher_exact(*[F.col(c) for c in "abcd"]))
    assert got == pytest.approx([slow(*c) for c in cases], rel=1e-8)


def test_mann_whitney(spark):
    # no ties: variance p q (n + 1) / 12, half a step of correction
    z = (abs(0.8 * 60 - 30) - 0.5) / math.sqrt(60 * 17 / 12)
    assert value(spark, P.mann_whitney_p(0.8, 6, 10, 0)) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)
    assert value(spark, P.mann_whitney_p(0.5, 3, 3, 6**3 - 6)) == 1.0 and value(spark, P.mann_whitney_p(0.5, 0, 3, 0)) is None
