"""Mergeable moments, variance ranking, one-vs-rest effect sizes and round-robin panels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MIN_SD = 1e-6  # fixed value: added to the pooled sd of the effect size


def moments(fact: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``n, mean, m2`` per key: the sufficient statistic every later step merges instead of raw rows."""
    return (fact.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                    (F.var_pop(value) * F.count(value)).alias("m2"))
            .where("n > 0"))


def pool(parts: DataFrame, keys: list[str], feature: str = "feature_id", weight: Column | None = None) -> DataFrame:
    """Merge moments over everything not in ``keys``; optional integer weights (resampling).

    Means are taken relative to each feature's overall mean, so no large squares cancel.
    """
    w = F.lit(1) if weight is None else weight
    ref = parts.groupBy(feature).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_ref"))
    d = F.col("mean") - F.col("_ref")
    sums = (parts.join(ref, feature).groupBy(*keys).agg(
        F.sum(w * F.col("n")).alias("n"), F.first("_ref").alias("_ref"),
        F.sum(w * F.col("n") * d).alias("_s"),
        F.sum(w * (F.col("m2") + F.col("n") * d * d)).alias("_q")))
    shift = F.try_divide("_s", "n")
    return (sums.where("n > 0")
            .select(*keys, "n", (F.col("_ref") + shift).alias("mean"),
                    F.greatest(F.lit(0.0), F.col("_q") - F.col("_s") * shift).alias("m2")))


def with_complement(parts: DataFrame, whole: list[str]) -> DataFrame:
    """Add ``rest_n, rest_mean, rest_m2``: the moments of everything else inside ``whole``.

    ``whole`` partitions hold one row per class or fold, never raw rows.
    """
    over = W.partitionBy(*whole)
    tot = (parts.withColumn("_n", F.sum("n").over(over))
           .withColumn("_mean", F.sum(F.col("n") * F.col("mean")).over(over) / F.col("_n"))
           .withColumn("_m2", F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2).over(over)))
    rest_n = F.col("_n") - F.col("n")
    rest_mean = F.try_divide(F.col("_n") * F.col("_mean") - F.col("n") * F.col("mean"), rest_n)
    rest_m2 = (F.col("_m2") - F.col("m2") - F.col("n") * (F.col("mean") - F.col("_mean")) ** 2
               - rest_n * (F.col("rest_mean") - F.col("_mean")) ** 2)
    return (tot.withColumn("rest_n", rest_n).withColumn("rest_mean", rest_mean)
            .withColumn("rest_m2", F.greatest(F.lit(0.0), rest_m2)).drop("_n", "_mean", "_m2"))


def one_vs_rest(class_moments: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Effect size of every (class, feature): |mean in − mean out| / (pooled sd + ε); 0 below two samples a side."""
    run = run or []
    both = with_complement(class_moments, [*run, "feature_id"])
    sd = F.sqrt((F.col("m2") / F.col("n") + F.try_divide("rest_m2", "rest_n")) / 2) + F.lit(MIN_SD)
    score = F.when((F.col("n") >= 2) & (F.col("rest_n") >= 2), F.abs(F.col("mean") - F.col("rest_mean")) / sd)
    return both.select(*run, "class", "feature_id", F.round(F.coalesce(score, F.lit(0.0)), 9).alias("score"))


def top_variance(feature_moments: DataFrame, k: int) -> DataFrame:
    """The ``k`` features of largest population variance (ties by id)."""
    return (feature_moments.select("feature_id", F.round(F.col("m2") / F.col("n"), 9).alias("variance"))
            .orderBy(F.desc("variance"), "feature_id").limit(k))


def class_ranks(scores: DataFrame, k: int | None = None, run: list[str] | None = None) -> DataFrame:
    """Rank features within each class; with ``k`` Spark limits each map partition before the shuffle."""
    over = W.partitionBy(*(run or []), "class").orderBy(F.desc("score"), "feature_id")
    ranked = scores.withColumn("rank", F.row_number().over(over))
    return ranked.where(F.col("rank") <= k) if k else ranked


def round_robin(scores: DataFrame, k: int, run: list[str], excluded: DataFrame | None = None) -> DataFrame:
    """Panel of ``k`` features: the best remaining feature of every class in turn.

    Only each class's ``k`` best candidates can ever be picked, so at most classes × k rows of one
    (run, fold, resample) reach the sequential step.  A smaller panel is the prefix of a larger one.
    """
    if excluded is not None:
        scores = scores.join(excluded.select("class", "feature_id"), ["class", "feature_id"], "left_anti")
    candidates = class_ranks(scores, k, run)

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        queues = {c: iter(g.sort_values("rank")["feature_id"]) for c, g in sorted(rows.groupby("class"))}
        taken: dict[str, str] = {}
        while queues and len(taken) < k:
            for name in list(queues):
                pick = next((f for f in queues[name] if f not in taken), None)
                if pick is None:
                    del queues[name]
                elif len(taken) < k:
                    taken[pick] = name
        out = pd.DataFrame({"feature_id": list(taken), "picked_for": list(taken.values())})
        out["pick"] = range(1, len(out) + 1)
        for name in run:
            out[name] = rows[name].iloc[0]
        return out[[*run, "pick", "feature_id", "picked_for"]]

    types = dict(candidates.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in run] + ["pick int", "feature_id string", "picked_for string"])
    return candidates.select(*run, "class", "feature_id", "rank").groupBy(*run).applyInPandas(deal, schema)


def excluded_features(fact: DataFrame, covariate: DataFrame, regulated: DataFrame | None, r_limit: float = 0.5,
                      min_n: int = 8) -> DataFrame:
    """(class, feature) pairs a class may not pick: |r| with a QC covariate above the limit, or regulated."""
    bad = class_correlation(fact, covariate, min_n).where(F.abs("r") > r_limit).select("class", "feature_id")
    return bad.unionByName(regulated.select("class", "feature_id")).distinct() if regulated is not None else bad


def class_correlation(fact: DataFrame, covariate: DataFrame, min_n: int = 8) -> DataFrame:
    """Pearson r of every feature with a sample covariate ``qc`` inside each class with enough samples."""
    return (fact.join(covariate.where("qc IS NOT NULL"), "sample_id")
            .groupBy("class", "feature_id").agg(F.corr("value", "qc").alias("r"), F.count("value").alias("n"))
            .where(F.col("n") >= min_n))


def marker_effect(class_means: DataFrame) -> DataFrame:
    """Per feature: the class of highest mean, the next class, and the gap between them."""
    over = W.partitionBy("feature_id").orderBy(F.desc("mean"), "class")  # one row per class
    r = class_means.withColumn("_r", F.row_number().over(over))
    pick = lambda i, c: F.max(F.when(F.col("_r") == i, F.col(c)))
    return r.groupBy("feature_id").agg(
        pick(1, "class").alias("marker_class"), pick(1, "mean").alias("marker_mean"),
        pick(2, "class").alias("next_class"), pick(2, "mean").alias("next_mean")
    ).withColumn("effect", F.col("marker_mean") - F.col("next_mean"))


def marker_check(source_means: DataFrame, target_means: DataFrame) -> DataFrame:
    """Does a feature's source marker class still lead in a target? Lost (effect ≤ 0), weakened (< half), holds."""
    src = marker_effect(source_means).select("feature_id", "marker_class", F.col("effect").alias("source_effect"))
    t = target_means.join(src, "feature_id")
    own = F.max(F.when(F.col("class") == F.col("marker_class"), F.col("mean")))
    other = F.max(F.when(F.col("class") != F.col("marker_class"), F.col("mean")))
    seen = t.groupBy("feature_id").agg((own - other).alias("target_effect"))
    status = (F.when(F.col("target_effect").isNull(), "not tested").when(F.col("target_effect") <= 0, "lost")
              .when(F.col("target_effect") < 0.5 * F.col("source_effect"), "weakened").otherwise("holds"))
    return src.join(seen, "feature_id", "left").withColumn("status", status)


def selection_consistency(panels: DataFrame, n_runs: int) -> DataFrame:
    """How often a feature was selected over folds, and whether in all of them."""
    return (panels.groupBy("feature_id").agg(F.count_distinct("fold").alias("n_folds"))
            .withColumn("share", F.col("n_folds") / n_runs).withColumn("in_all", F.col("n_folds") == n_runs))
