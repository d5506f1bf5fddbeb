"""Tail probabilities as column expressions: incomplete beta and gamma functions, exact tests, small-sample p-values.

All of them are evaluated in the JVM, row by row, on tables of summaries.  Continued fractions run for a number of steps that
grows with the root of their parameters, which is what they need to converge.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300
#: Halvings of (0, 1) when a quantile is looked for.
HALVINGS = 52


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _num(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def log_gamma(z) -> Column:
    """log Γ(z) for z > 0: the asymptotic series eight steps further up."""
    def series(x: Column) -> Column:
        y = x + 8
        i = 1 / (y * y)
        tail = (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i * (1 / 1188 - i * 691 / 360360))))) / y
        down = F.log(x)
        for k in range(1, 8):
            down = down + F.log(x + k)
        return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - down
    return let(_num(z), series)


def _away_from_zero(x: Column) -> Column:
    return F.when(F.abs(x) > TINY, x).otherwise(F.lit(TINY))


def _lentz(first: Column, h: Column, terms: Column, step) -> Column:
    """A continued fraction from its first d and value h on: ``step(j)`` gives the j-th (numerator, denominator)."""
    start = F.struct(F.lit(1 / TINY).alias("c"), first.alias("d"), h.alias("h"))

    def advance(acc: Column, j: Column) -> Column:
        num, den = step(j)
        pair = F.struct(_away_from_zero(den + num / acc["c"]).alias("c"), (1 / _away_from_zero(den + num * acc["d"])).alias("d"))
        return let(pair, lambda p: F.struct(p["c"].alias("c"), p["d"].alias("d"), (acc["h"] * p["c"] * p["d"]).alias("h")))
    return F.aggregate(terms, start, advance, lambda acc: acc["h"])


def _steps(size: Column, factor: int = 6, least: int = 60) -> Column:
    return F.sequence(F.lit(1), (least + factor * F.ceil(F.sqrt(size))).cast("int"))


def beta_cdf(x, a, b) -> Column:
    """Regularised incomplete beta function of x in [0, 1]."""
    v = F.struct(_num(x).alias("x"), _num(a).alias("a"), _num(b).alias("b"))

    def fraction(p: Column) -> Column:
        x_, a_, b_ = p["x"], p["a"], p["b"]

        def step(j: Column):
            m = F.floor(j / 2)
            even = m * (b_ - m) * x_ / ((a_ + 2 * m - 1) * (a_ + 2 * m))
            odd = -(a_ + m) * (a_ + b_ + m) * x_ / ((a_ + 2 * m) * (a_ + 2 * m + 1))
            return F.when(j % 2 == 0, even).otherwise(odd), F.lit(1.0)
        front = F.exp(log_gamma(a_ + b_) - log_gamma(a_) - log_gamma(b_) + a_ * F.log(x_) + b_ * F.log1p(-x_))
        return front * _lentz(F.lit(1.0), F.lit(1.0), _steps(F.greatest(a_, b_)), step) / a_

    def value(p: Column) -> Column:
        low = p["x"] < (p["a"] + 1) / (p["a"] + p["b"] + 2)
        turned = let(F.when(low, p).otherwise(F.struct((1 - p["x"]).alias("x"), p["b"].alias("a"), p["a"].alias("b"))), fraction)
        return F.when(p["x"] <= 0, 0.0).when(p["x"] >= 1, 1.0).otherwise(F.when(low, turned).otherwise(1 - turned))
    return let(v, value)


def beta_quantile(q, a, b) -> Column:
    """x with ``beta_cdf(x, a, b) = q``, by halving."""
    v = F.struct(_num(q).alias("q"), _num(a).alias("a"), _num(b).alias("b"))

    def search(p: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def halve(acc: Column, _: Column) -> Column:
            mid = (acc["lo"] + acc["hi"]) / 2
            return F.when(beta_cdf(mid, p["a"], p["b"]) < p["q"], F.struct(mid.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda acc: (acc["lo"] + acc["hi"]) / 2)
    return let(v, search)


def binomial_tail(errors, n, rate) -> Column:
    """P(at most ``errors`` of ``n``) at that rate."""
    e, m = _num(errors), _num(n)
    return F.when(e >= m, 1.0).otherwise(beta_cdf(1 - _num(rate), m - e, e + 1))


def binomial_upper(errors, n, delta) -> Column:
    """Exact one-sided upper bound on an error rate: the (1 − δ) quantile of Beta(errors + 1, n − errors)."""
    e, m = _num(errors), _num(n)
    return F.when((m == 0) | (e >= m), 1.0).otherwise(beta_quantile(1 - _num(delta), e + 1, m - e))


def binomial_interval(successes, n, level: float = 0.95) -> Column:
    """Exact two-sided interval (lo, hi) of a share."""
    s, m, a = _num(successes), _num(n), (1 - level) / 2
    lo = F.when(s <= 0, 0.0).otherwise(beta_quantile(F.lit(a), s, m - s + 1))
    hi = F.when(s >= m, 1.0).otherwise(beta_quantile(F.lit(1 - a), s + 1, m - s))
    return F.when(m > 0, F.struct(lo.alias("lo"), hi.alias("hi")))


def gamma_sf(a, x) -> Column:
    """Regularised upper incomplete gamma function Q(a, x)."""
    v = F.struct(_num(a).alias("a"), _num(x).alias("x"))

    def value(p: Column) -> Column:
        a_, x_ = p["a"], p["x"]
        front = F.exp(-x_ + a_ * F.log(x_) - log_gamma(a_))
        # below a + 1 the series of the lower function, above it the continued fraction of the upper one
        series = F.aggregate(_steps(a_), F.struct((1 / a_).alias("t"), (1 / a_).alias("s")),
                             lambda acc, j: let(acc["t"] * x_ / (a_ + j), lambda t: F.struct(t.alias("t"), (acc["s"] + t).alias("s"))), lambda acc: acc["s"])
        first = 1 / _away_from_zero(x_ + 1 - a_)

        fraction = _lentz(first, first, _steps(a_), lambda j: (-j * (j - a_), x_ + 1 - a_ + 2 * j))
        return F.when(x_ <= 0, 1.0).when(x_ < a_ + 1, 1 - front * series).otherwise(front * fraction)
    return let(v, value)


def chi2_sf(statistic, df) -> Column:
    """P(χ² above the statistic); 1 without degrees of freedom."""
    return F.when(_num(df) <= 0, 1.0).otherwise(gamma_sf(_num(df) / 2, _num(statistic) / 2))


def normal_two_sided(z) -> Column:
    return gamma_sf(F.lit(0.5), _num(z) * _num(z) / 2)


def t_two_sided(t, df) -> Column:
    """P(|T| above |t|) of Student's distribution."""
    d = _num(df)
    return F.when(d > 0, beta_cdf(d / (d + _num(t) * _num(t)), d / 2, F.lit(0.5)))


def correlation_p(r, n) -> Column:
    """Two-sided p of a (rank) correlation of n pairs by its t statistic; 0 for a perfect one, NULL under three pairs."""
    r_, n_ = _num(r), _num(n)
    t = r_ * F.sqrt((n_ - 2) / (1 - r_ * r_))
    return F.when(n_ < 3, F.lit(None).cast("double")).when(F.abs(r_) >= 1, 0.0).otherwise(t_two_sided(t, n_ - 2))


def mann_whitney_p(auroc, n_pos, n_neg, tie_sum) -> Column:
    """Two-sided normal p of an AUROC with tie and continuity correction; ``tie_sum`` is Σ(t³ − t) over groups of equal scores."""
    a, p, q = _num(auroc), _num(n_pos), _num(n_neg)
    n = p + q
    sd = F.sqrt(p * q / 12 * ((n + 1) - _num(tie_sum) / (n * (n - 1))))
    gap = F.greatest(F.abs(a * p * q - p * q / 2) - 0.5, F.lit(0.0))
    return F.when((p == 0) | (q == 0), F.lit(None).cast("double")).when(sd > 0, normal_two_sided(gap / sd)).otherwise(1.0)


def fisher_exact(a, b, c, d) -> Column:
    """Two-sided exact p of a 2 × 2 table: all tables with its margins that are no likelier, summed over the hypergeometric support.

    The support has as many points as the smallest margin plus one; a row of counts is one table.
    """
    v = F.struct(*[_num(x).alias(k) for k, x in zip("abcd", (a, b, c, d), strict=True)])

    def value(p: Column) -> Column:
        rows, cols, n = p["a"] + p["b"], p["a"] + p["c"], p["a"] + p["b"] + p["c"] + p["d"]
        lo, hi = F.greatest(F.lit(0.0), rows + cols - n), F.least(rows, cols)
        weight = lambda k: -(log_gamma(k + 1) + log_gamma(rows - k + 1) + log_gamma(cols - k + 1) + log_gamma(n - rows - cols + k + 1))
        walk = F.transform(F.sequence(lo.cast("long"), hi.cast("long")), lambda k: weight(k.cast("double")))

        def total(logs: Column) -> Column:
            top = F.array_max(logs)
            own = F.element_at(logs, (p["a"] - lo + 1).cast("int"))
            add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, t: s + F.exp(t - top))
            return F.least(F.lit(1.0), add(F.filter(logs, lambda t: t <= own + 1e-7)) / add(logs))
        return F.when(n > 0, let(walk, total)).otherwise(1.0)
    return let(v, value)
