"""Certified panel sizes: error counts, upper bounds and the fixed-sequence stop rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import unit_hash
from ..functions.special import binomial_upper


def hoeffding_upper(err: str, n: str, delta: str) -> Column:
    return F.least(F.lit(1.0), F.col(err) / F.col(n) + F.sqrt(F.log(1 / F.col(delta)) / (2 * F.col(n))))


def panel_errors(wrong: DataFrame, keys: list[str]) -> DataFrame:
    return wrong.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("wrong").alias("n_err"))


def certify_table(errors: DataFrame, run: list[str], config: list[tuple[float, float]], bound: str) -> DataFrame:
    """Every (run, k, α, δ) with its bound and whether the descending sequence is still unbroken there."""
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(d).alias("delta")) for a, d in config]))
    t = errors.withColumn("_g", grid).select(*run, "k", "n", "n_err", "_g.alpha", "_g.delta")
    ucb = hoeffding_upper("n_err", "n", "delta") if bound == "hoeffding" else binomial_upper(F.col("n_err"), F.col("n"), F.col("delta"))
    over = W.partitionBy(*run, "alpha", "delta").orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
    return (t.withColumn("ucb", ucb)
            .withColumn("certified", F.min(F.col("ucb") <= F.col("alpha")).over(over)))


def certify(errors: DataFrame, run: list[str], config: list[tuple[float, float]], bound: str = "exact") -> DataFrame:
    """Smallest certified k per run and (α, δ); NULL when the largest k already fails."""
    return (certify_table(errors, run, config, bound).groupBy(*run, "alpha", "delta")
            .agg(F.min(F.when(F.col("certified"), F.col("k"))).alias("certified_k")))


def losses(calls: DataFrame, run: list[str], seed: int = 51) -> DataFrame:
    """Error counts three ways: pooled samples, any wrong sample of an individual, one sample per individual."""
    per_group = calls.withColumn("_u", unit_hash(seed, "sample_id")).groupBy(*run, "group_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("wrong").alias("s"), F.max("wrong").alias("any"),
        F.min_by("wrong", "_u").alias("one"))
    kinds = F.explode(F.array(
        F.struct(F.lit("pooled").alias("loss"), F.col("n").alias("n"), F.col("s").cast("long").alias("e")),
        F.struct(F.lit("any_per_group").alias("loss"), F.lit(1).cast("long").alias("n"), F.col("any").cast("long").alias("e")),
        F.struct(F.lit("one_per_group").alias("loss"), F.lit(1).cast("long").alias("n"), F.col("one").cast("long").alias("e"))))
    return (per_group.select(*run, kinds.alias("_k")).groupBy(*run, F.col("_k.loss").alias("loss"))
            .agg(F.sum("_k.n").alias("n"), F.sum("_k.e").alias("n_err")))


def zero_error_sizes(group_count: DataFrame, config: list[tuple[float, float]]) -> DataFrame:
    """Individuals needed so that zero errors certify α at level δ, beside the number available."""
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(d).alias("delta")) for a, d in config]))
    t = group_count.withColumn("_g", grid).select("n_groups", "_g.alpha", "_g.delta")
    need = F.ceil(F.log("delta") / F.log(1 - F.col("alpha")))
    return t.select("alpha", "delta", need.alias("needed"), (F.col("n_groups") >= need).alias("enough"))


def validity(certified: DataFrame, test_errors: DataFrame, split: list[str]) -> DataFrame:
    """The test error at each certified size and whether it keeps α; NULL where nothing is certified."""
    test = test_errors.withColumnRenamed("k", "certified_k")
    return certified.join(test, [*split, "certified_k"], "left").withColumn("test_within_alpha", F.col("test_err") <= F.col("alpha"))


def size_distribution(certified: DataFrame, sizes: Sequence[int], keys: Sequence[str] = ("loss",)) -> DataFrame:
    """For every size, the share of the splits that are certified with at most so many features."""
    each = certified.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sizes])))
    within = F.coalesce(F.col("certified_k") <= F.col("k"), F.lit(False))
    return each.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n_splits"), F.avg(within.cast("int")).alias("frac_certified"))


def grid_summary(certified: DataFrame, k_of_interest: int, keys: Sequence[str] = ("loss",)) -> DataFrame:
    """Per (α, δ): splits certified within ``k_of_interest``, certified at all, and the median certified size."""
    k = F.col("certified_k")
    return certified.groupBy(*keys, "alpha", "delta").agg(
        F.count(F.lit(1)).alias("n_splits"), F.round(F.avg(F.coalesce(k <= k_of_interest, F.lit(False)).cast("int")), 6).alias("frac_certified_k"),
        F.round(F.avg(k.isNotNull().cast("int")), 6).alias("frac_any_certified"), F.percentile(k, F.lit(0.5)).alias("median_certified_k"))
