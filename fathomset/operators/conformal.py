"""Split-conformal scores, thresholds, prediction sets and their evaluation.

``probs`` tables are long: one row per (run keys, sample, candidate class) with ``p``; the true label
travels along as ``class`` and the candidate as ``candidate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import unit_hash
from ..functions.ranking import SLICES, kth_smallest, value_ranks
from ..session import checked_broadcast

DIGITS = 9  # probabilities are rounded here so that a threshold comparison is reproducible
INF = float("inf")


def softmax_over(keys: list[str], score: str, out: str = "p") -> callable:
    """A transform adding the softmax of ``score`` over one sample's candidates (few rows per partition)."""
    def apply(df: DataFrame) -> DataFrame:
        over = W.partitionBy(*keys)
        e = df.withColumn("_e", F.exp(F.col(score) - F.max(score).over(over)))
        return e.withColumn(out, F.round(F.col("_e") / F.sum("_e").over(over), DIGITS)).drop("_e")
    return apply


def lac_scores(probs: DataFrame) -> DataFrame:
    """1 − p of the true class; samples whose label the model never saw produce no row."""
    return probs.where("candidate = class").withColumn("score", F.round(1 - F.col("p"), DIGITS)).drop("candidate", "p")


def mass_before(probs: DataFrame, sample_keys: list[str]) -> DataFrame:
    """Probability mass of the candidates ranked above each one (one sample's candidates per partition)."""
    over = W.partitionBy(*sample_keys).orderBy(F.desc("p"), "candidate").rowsBetween(W.unboundedPreceding, 0)
    return probs.withColumn("before", F.round(F.sum("p").over(over) - F.col("p"), DIGITS))


def aps_scores(probs: DataFrame, sample_keys: list[str], seed: int = 17) -> DataFrame:
    """Mass before the true class plus a hash-random share of its own mass."""
    u = unit_hash(seed, *sample_keys)
    return (mass_before(probs, sample_keys).where("candidate = class")
            .withColumn("score", F.round(F.col("before") + u * F.col("p"), DIGITS))
            .drop("candidate", "p", "before"))


def unseen_labels(samples: DataFrame, candidates: DataFrame, run: list[str]) -> DataFrame:
    """Samples (per run) whose label is not among the model's classes; counted, never scored."""
    known = candidates.select(*run, F.col("candidate").alias("class")).distinct()
    return samples.join(known, [*run, "class"], "left_anti")


def conformal_rank(alpha, n="n_total") -> Column:
    """ceil((n+1)(1−α)) with a tolerance for integers that come out a hair too large."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.greatest(F.lit(1), F.ceil((F.col(n) + 1) * (1 - a) - 1e-9))


def thresholds(scores: DataFrame, run: list[str], alphas: list[float], slices: int = SLICES) -> DataFrame:
    """The conformal threshold per run and α; +∞ where the rank exceeds the number of scores."""
    ranks = value_ranks(scores, run, "score", slices=slices)
    each = ranks.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    return (kth_smallest(each, [*run, "alpha"], "score", conformal_rank(F.col("alpha")), "q")
            .withColumn("q", F.coalesce("q", F.lit(INF))).withColumnRenamed("n_total", "n_cal"))


def class_thresholds(scores: DataFrame, run: list[str], alphas: list[float], classes: DataFrame,
                     floored: bool = False, slices: int = SLICES) -> DataFrame:
    """Per-class thresholds for every candidate class of the run.

    A class without calibration scores falls back to the marginal threshold; ``floored`` raises every
    class threshold to at least the marginal one.
    """
    marginal = thresholds(scores, run, alphas, slices).select(*run, "alpha", F.col("q").alias("q_marginal"))
    own = (thresholds(scores, [*run, "class"], alphas, slices)
           .select(*run, "alpha", F.col("class").alias("candidate"), F.col("q").alias("q_class"), "n_cal"))
    grid = classes.select(*run, "candidate").distinct().join(marginal, run) if run else None
    if grid is None:
        grid = classes.select("candidate").distinct().withColumn(
            "_m", F.explode(marginal.agg(F.collect_list(F.struct("alpha", "q_marginal"))).scalar())
        ).select("candidate", "_m.alpha", "_m.q_marginal")
    out = grid.join(own, [*run, "alpha", "candidate"], "left")
    q = F.coalesce("q_class", "q_marginal")
    if floored:
        q = F.greatest(q, "q_marginal")
    return out.select(*run, "alpha", "candidate", q.alias("q"), F.coalesce("n_cal", F.lit(0)).alias("n_cal"))


def lac_member(p: str = "p", q: str = "q") -> Column:
    return (F.col(q) == INF) | (F.col(p) >= F.round(1 - F.col(q), DIGITS))


def prediction_sets(probs: DataFrame, q: DataFrame, join_on: list[str], sample_keys: list[str],
                    member: Column | None = None) -> DataFrame:
    """One row per sample and α: sorted members, size and coverage; empty sets are kept."""
    inside = lac_member() if member is None else member
    return (probs.join(checked_broadcast(q), join_on)
            .groupBy(*sample_keys, "class", "alpha")
            .agg(F.array_sort(F.collect_list(F.when(inside, F.col("candidate")))).alias("members"),
                 F.max(F.when(F.col("candidate") == F.col("class"), F.when(inside, 1).otherwise(0))).alias("covered"))
            .withColumn("set_size", F.size("members")))


def evaluate_sets(sets: DataFrame, keys: list[str], per_class: bool = False) -> DataFrame:
    """Coverage over labels the model knows, mean size, singleton and empty shares; optionally per class too."""
    aggs = [F.count(F.lit(1)).alias("n"), F.count("covered").alias("n_seen"),
            F.round(F.avg("covered"), 6).alias("coverage"), F.round(F.avg("set_size"), 6).alias("mean_size"),
            F.round(F.avg((F.col("set_size") == 1).cast("double")), 6).alias("singleton_share"),
            F.round(F.avg((F.col("set_size") == 0).cast("double")), 6).alias("empty_share")]
    if not per_class:
        return sets.groupBy(*keys).agg(*aggs)
    cols = [F.col(k) for k in keys]
    return sets.groupingSets([cols, [*cols, F.col("class")]], *keys, "class").agg(*aggs)
