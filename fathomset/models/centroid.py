"""Nearest-centroid and coefficient models, fitted as aggregations and scored as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.conformal import DIGITS
from ..operators.effects import moments, pool
from ..session import checked_broadcast


def fold_moments(fact: DataFrame, roles: DataFrame, role: str = "fit") -> DataFrame:
    """(fold, class, feature) moments of one role: a single pass over the fact table, then group-level merging."""
    per_group = moments(fact, ["group_id", "class", "feature_id"])
    mine = roles.where(F.col("role") == role).select("fold", "group_id")
    return pool(per_group.join(mine, "group_id"), ["fold", "class", "feature_id"])


def centroids(fits: DataFrame, run: list[str], features: DataFrame | None = None) -> DataFrame:
    """Class means plus the feature's training sd; sd 0 counts as 1. ``features`` restricts to a panel."""
    overall = pool(fits, [*run, "feature_id"]).select(
        *run, "feature_id", F.sqrt(F.col("m2") / F.col("n")).alias("_sd"))
    out = fits.join(overall, [*run, "feature_id"])
    if features is not None:
        out = out.join(features.select(*run, "feature_id"), [*run, "feature_id"], "left_semi")
    return out.select(*run, F.col("class").alias("candidate"), "feature_id", F.col("mean").alias("mu"),
                      F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0)).alias("sd"))


def centroid_probs(fact: DataFrame, roles: DataFrame, table: DataFrame, wanted: list[str] = ("test", "cal")) -> DataFrame:
    """p ∝ exp(−d²/2) with d the distance to each class centroid in training-sd units.

    The centroid table is turned to one row per feature with a column per class (the class list is the
    model's own, small, dimension), so the fact table meets it in a map-side join without being multiplied
    by the classes; all distances of a sample come from one aggregation and the softmax is row-local.
    """
    names = [r["candidate"] for r in table.select("candidate").distinct().orderBy("candidate").collect()]
    wide = table.groupBy("fold", "feature_id").agg(F.first("sd").alias("sd"), *[
        F.max(F.when(F.col("candidate") == c, F.col("mu"))).alias(f"_m{i}") for i, c in enumerate(names)])
    who = roles.where(F.col("role").isin(list(wanted))).select("fold", "role", "group_id")
    near = fact.join(checked_broadcast(who), "group_id").join(
        checked_broadcast(wide), ["fold", "feature_id"])
    gap = [(F.col("value") - F.col(f"_m{i}")) / F.col("sd") for i in range(len(names))]
    dist = near.groupBy("fold", "role", "sample_id", "group_id", "class").agg(
        *[F.round(F.sum(g * g), 9).alias(f"_d{i}") for i, g in enumerate(gap)])
    each = F.filter(F.array(*[F.struct(F.lit(c).alias("candidate"), F.col(f"_d{i}").alias("d2")) for i, c in enumerate(names)]),
                    lambda s: s["d2"].isNotNull())
    best = F.array_min(F.transform("_s", lambda s: s["d2"]))
    e = F.transform("_s", lambda s: F.struct(s["candidate"].alias("candidate"), s["d2"].alias("d2"), F.exp((F.col("_b") - s["d2"]) / 2).alias("e")))
    total = F.aggregate("_e", F.lit(0.0), lambda acc, s: acc + s["e"])
    out = (dist.withColumn("_s", each).withColumn("_b", best).withColumn("_e", e).withColumn("_t", total)
           .select("fold", "role", "sample_id", "group_id", "class", "_t", F.explode("_e").alias("_x")))
    return out.select("fold", "role", "sample_id", "group_id", "class", "_x.candidate", "_x.d2",
                      F.round(F.col("_x.e") / F.col("_t"), DIGITS).alias("p"))


def linear_logits(z: DataFrame, coef: DataFrame, intercept: DataFrame, keys: list[str]) -> DataFrame:
    """z·W + b for a stored model: ``coef(candidate, feature_id, w)``, ``intercept(candidate, b)``."""
    dot = (z.join(checked_broadcast(coef), "feature_id").groupBy(*keys, "candidate")
           .agg(F.sum(F.col("value") * F.col("w")).alias("_dot")))
    return (dot.join(checked_broadcast(intercept), "candidate")
            .select(*keys, "candidate", (F.col("_dot") + F.col("b")).alias("logit")))


def top_two(probs: DataFrame, keys: list[str]) -> DataFrame:
    """Called class and runner-up per sample; equal probabilities go to the first name."""
    ranked = probs.groupBy(*keys).agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("np"), "candidate"))), 1, 2).alias("_t"))
    return ranked.select(*keys, F.col("_t")[0]["candidate"].alias("call"), (-F.col("_t")[0]["np"]).alias("call_p"),
                         F.col("_t")[1]["candidate"].alias("runner_up"), (-F.col("_t")[1]["np"]).alias("runner_up_p"))


def contributions(z: DataFrame, coef: DataFrame, keys: list[str]) -> DataFrame:
    """Per-feature terms coef·z of every class; their sum plus the intercept is the logit."""
    return z.join(checked_broadcast(coef), "feature_id").select(
        *keys, "candidate", "feature_id", (F.col("value") * F.col("w")).alias("term"))


def contrast(terms: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Why X, not Y: difference of the two classes' terms per feature, by conditional sums (no self-join)."""
    t = terms.join(pairs, keys)
    part = lambda side: F.sum(F.when(F.col("candidate") == F.col(side), F.col("term")))
    return (t.groupBy(*keys, "feature_id", "call", "runner_up")
            .agg((part("call") - part("runner_up")).alias("diff")))


def panel_calls(fact: DataFrame, roles: DataFrame, table: DataFrame, panel: DataFrame, sizes: Sequence[int], wanted: Sequence[str] = ("test", "cal")) -> DataFrame:
    """The nearest centroid of each sample for every panel size, in one pass: rows (fold, role, group_id, sample_id, class, k, call).

    A panel feature is one row with its place and a column per class, so facts are multiplied neither by classes nor by
    sizes; a sample's distances are sums per class and step from one size to the next.
    """
    sizes, names = sorted(sizes), [r["candidate"] for r in table.select("candidate").distinct().orderBy("candidate").collect()]
    features = (table.groupBy("fold", "feature_id").agg(F.first("sd").alias("sd"), *[F.max(F.when(F.col("candidate") == c, F.col("mu"))).alias(f"_m{i}") for i, c in enumerate(names)])
                .join(panel.select("fold", "feature_id", "pick").where(F.col("pick") <= max(sizes)), ["fold", "feature_id"]))
    who = roles.where(F.col("role").isin(list(wanted))).select("fold", "role", "group_id")
    near = fact.join(checked_broadcast(who), "group_id").join(checked_broadcast(features), ["fold", "feature_id"])
    step = [(F.col("pick") > low) & (F.col("pick") <= k) for low, k in zip([0, *sizes], sizes, strict=False)]
    gap = [F.pow((F.col("value") - F.col(f"_m{i}")) / F.col("sd"), 2) for i in range(len(names))]
    known = F.coalesce(*[F.when(F.col(f"_m{i}").isNotNull(), F.lit(i)) for i in range(len(names))])
    own = near.groupBy("fold", "role", "group_id", "sample_id", "class").agg(
        F.min("pick").alias("_first"), F.min(known).alias("_known"),
        *[F.sum(F.when(s, g)).alias(f"_d{j}_{i}") for j, s in enumerate(step) for i, g in enumerate(gap)])

    def nearest(j: int) -> Column:
        parts = lambda i: [F.col(f"_d{s}_{i}") for s in range(j + 1)]
        total = lambda i: sum((F.coalesce(d, F.lit(0.0)) for d in parts(i)), F.lit(0.0))
        near = F.array(*[F.when(F.coalesce(*parts(i)).isNotNull(), F.struct(F.round(total(i), DIGITS).alias("d2"), F.lit(i).alias("i"))) for i in range(len(names))])
        # without any value all distances are unknown, and the first name is called
        return F.when(F.col("_first") <= sizes[j], F.array(*[F.lit(c) for c in names])[F.coalesce(F.array_min(near)["i"], F.col("_known"))])
    calls = F.array(*[F.struct(F.lit(k).alias("k"), nearest(j).alias("call")) for j, k in enumerate(sizes)])
    return own.select("fold", "role", "group_id", "sample_id", "class", F.inline(calls))
