"""Claimed labels against prediction sets: mapping, statuses, scaling choice, recalibration, swap detection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import normal_label
from ..session import checked_broadcast

# fixed values: limits of within-set scaling, of driver features and of recalibration; label texts read as "no claim"
WITHIN_MIN_SAMPLES, WITHIN_MIN_CLASSES = 8, 3
DRIVER_MIN, DRIVER_REL = 0.1, 0.1
MIN_LABELLED = 3
NO_CLAIM = ["", "na", "nan", "null"]


def map_claims(samples: DataFrame, names: DataFrame, label: str = "label") -> DataFrame:
    """Add ``claimed`` (array of classes) and ``claim_kind``: class, superclass, not_in_reference or none.

    ``names(name, classes)`` is looked up by the normalised label, then without " tissue", then without a plural s.
    """
    book = checked_broadcast(names.select(normal_label("name").alias("_k"), F.array_sort("classes").alias("_c")).distinct())
    n = normal_label(label)
    out = samples.withColumn("_n", n)
    for i, key in enumerate((F.col("_n"), F.regexp_replace("_n", " tissue$", ""), F.regexp_replace("_n", "s$", ""))):
        side = book.select(F.col("_k").alias(f"_k{i}"), F.col("_c").alias(f"_c{i}"))
        out = out.join(side, key == F.col(f"_k{i}"), "left")
    hit = F.coalesce("_c0", "_c1", "_c2")
    none = F.col("_n").isNull() | F.col("_n").isin(NO_CLAIM)
    kind = (F.when(none, "none").when(hit.isNull(), "not_in_reference").when(F.size(hit) == 1, "class").otherwise("superclass"))
    empty = F.array().cast("array<string>")
    return out.select(*samples.columns, F.when(none, empty).otherwise(F.coalesce(hit, empty)).alias("claimed"), kind.alias("claim_kind"))


def sample_status(size: str = "set_size") -> Column:
    return F.when(F.col(size) == 0, "Unknown").when(F.col(size) == 1, "Confident").otherwise("Ambiguous")


def claim_status(members: str = "members", claimed: str = "claimed", kind: str = "claim_kind") -> Column:
    return (F.when(F.col(kind) == "none", None).when(F.col(kind) == "not_in_reference", "Not in reference")
            .when(F.size(members) == 0, "Can't confirm").when(F.arrays_overlap(members, claimed), "Consistent")
            .otherwise("Mismatch"))


def check_samples(sets: DataFrame, claims: DataFrame, on: list[str]) -> DataFrame:
    """Statuses, flag and display priority of every sample."""
    j = sets.join(claims, on).withColumn("status", sample_status()).withColumn("claim_status", claim_status())
    cs = F.coalesce("claim_status", F.lit(""))
    rank = (F.when(cs == "Mismatch", 0).when(cs == "Can't confirm", 1).when(cs == "Not in reference", 2)
            .when(F.col("status") == "Unknown", 3).when(F.col("status") == "Ambiguous", 4).otherwise(5))
    return (j.withColumn("priority", rank)
            .withColumn("flagged", cs.isin("Mismatch", "Can't confirm", "Not in reference") | (F.col("status") == "Unknown")))


def status_counts(checked: DataFrame, keys: list[str]) -> DataFrame:
    one = F.explode(F.array_compact(F.array("status", "claim_status", F.when(F.col("flagged"), "flagged"), F.lit("total"),
                                            F.when(F.col("claim_status").isNotNull(), "claimed"))))
    return checked.select(*keys, one.alias("name")).groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"))


def choose_scaling(rows: DataFrame, keys: list[str], forced: str | None = None, parts: list[str] | None = None) -> DataFrame:
    """Within-set scaling only for enough samples spanning enough claimed or called classes.

    ``parts`` adds a row for every part of a set by these columns; they are NULL in the row of the whole set.

    ``forced`` sets the mode; then ``auto`` is what the rule would choose, and ``caveat`` says that the set is too small or
    too uniform for the within-set scaling that is forced on it.
    """
    rows = rows.withColumn("_claimed", F.when(F.col("claim_kind").isin("class", "superclass"), F.concat_ws("|", "claimed")))
    cols = [F.col(k) for k in keys]
    grouped = rows.groupingSets([cols, [*cols, *map(F.col, parts)]], *keys, *parts) if parts else rows.groupBy(*keys)
    # the claim kind may be one of the parts: what counts distinct is fixed before
    s = grouped.agg(F.count_distinct("sample_id").alias("n_samples"), F.count_distinct("_claimed").alias("_c"),
                    F.count_distinct("call").alias("_p"))
    keys = [*keys, *(parts or [])]
    n = F.greatest("_c", "_p")
    ok = (F.col("n_samples") >= WITHIN_MIN_SAMPLES) & (n >= WITHIN_MIN_CLASSES)
    auto = F.when(ok, "within").otherwise("reference")
    if forced is None:
        return s.select(*keys, "n_samples", n.alias("n_classes"), auto.alias("mode"))
    return s.select(*keys, "n_samples", n.alias("n_classes"), F.lit(forced).alias("mode"), auto.alias("auto"), ((auto == "reference") & F.lit(forced == "within")).alias("caveat"))


def labelled_for_recalibration(claims: DataFrame, excluded: DataFrame) -> DataFrame:
    """Samples whose claim names exactly one class, minus those known to be wrong."""
    return (claims.where("claim_kind = 'class'").join(excluded, "sample_id", "left_anti")
            .select("sample_id", F.col("claimed")[0].alias("class")))


def min_labelled(alpha: float) -> int:
    """Fewest labelled samples for a finite threshold (never below the fixed minimum)."""
    n = max(1, math.ceil((1 - alpha) / alpha - 1e-9))
    return max(MIN_LABELLED, n)


def flag_rates(checked: DataFrame, keys: list[str]) -> DataFrame:
    share = lambda s: F.round(F.avg((F.col("claim_status") == s).cast("int")), 6)
    return checked.where("claim_status IS NOT NULL").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), share("Consistent").alias("consistent_rate"), share("Mismatch").alias("mismatch_rate"),
        share("Can't confirm").alias("cant_confirm_rate"))


def swap_detection(pairs: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    """Two samples exchange their (disjoint) true labels: how often is one, both or none flagged?

    ``sets(sample_id, label, members)`` meets the hash-drawn pairs by two equi-joins.
    """
    side = lambda s: sets.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("sample_id", "label", "members")])
    p = checked_broadcast(pairs)
    j = side("a").join(p, "sample_id_a").join(side("b"), ["sample_id_b", *keys])
    j = j.where("label_a <> label_b")
    mis = lambda s, other: ((F.size(f"members_{s}") > 0) & ~F.array_contains(f"members_{s}", F.col(f"label_{other}"))).cast("int")
    a, b = mis("a", "b"), mis("b", "a")
    cc = (F.size("members_a") == 0).cast("int") + (F.size("members_b") == 0).cast("int")
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_swaps"), F.round(F.avg((a + b) / 2), 6).alias("sample_detection_rate"),
        F.round(F.avg(F.greatest(a, b)), 6).alias("pair_detection_rate"), F.round(F.avg(a * b), 6).alias("both_flagged_rate"),
        F.round(F.avg(cc / 2), 6).alias("cant_confirm_rate"))


def drivers(diffs: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """Top positive terms of "why X, not Y" above max(fixed floor, share of the largest); few rows per sample."""
    pos = diffs.where("diff > 0")
    top = F.max("diff").over(W.partitionBy(*keys))
    r = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("diff"), "feature_id"))
    return (pos.withColumn("_top", top).withColumn("rank", r)
            .where((F.col("diff") >= F.greatest(F.lit(DRIVER_MIN), DRIVER_REL * F.col("_top"))) & (F.col("rank") <= n)).drop("_top"))


def ordered_union(lists: DataFrame, cap: int) -> DataFrame:
    """Union of ranked lists ``(list_no, pos, feature_id)``: first occurrence wins, first ``cap`` kept (the feature of
    this operator), in list order."""
    first = lists.groupBy("feature_id").agg(F.min(F.struct("list_no", "pos")).alias("_o"))
    top = first.orderBy("_o", "feature_id").limit(cap)
    over = W.orderBy("_o", "feature_id")  # at most ``cap`` rows
    return top.select(F.row_number().over(over).alias("position"), "feature_id", F.col("_o.list_no").alias("list_no"))
