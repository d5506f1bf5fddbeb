"""Group-wise splits as role tables: one row per (split, group), joined to samples when needed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import unit_hash
from ..functions.ranking import dense_index


def modal_stratum(samples: DataFrame, group: str, stratum: str) -> DataFrame:
    """Most frequent stratum of every group; ties go to the first name."""
    return (samples.groupBy(group, stratum).agg(F.count(F.lit(1)).alias("_n"))
            .groupBy(group).agg(F.min_by(stratum, F.struct(-F.col("_n"), F.col(stratum))).alias(stratum)))


def grouped_kfold(samples: DataFrame, stratum: str = "class", group: str = "group_id", n_splits: int = 5,
                  seed: int = 11) -> DataFrame:
    """``group → fold``: every group on one side, strata spread evenly; never more folds than groups."""
    groups = modal_stratum(samples, group, stratum).withColumn("_u", unit_hash(seed, group))
    folds = F.least(F.lit(n_splits), groups.agg(F.count(F.lit(1)).cast("int")).scalar())
    return (dense_index(groups, [stratum], "_u", group)
            .select(group, stratum, (F.col("idx") % folds).cast("int").alias("fold")))


def fold_roles(folds: DataFrame, n_splits: int = 5, cal_frac: float | None = 0.3, n_cal: int | None = None,
               group: str = "group_id", seed: int = 12) -> DataFrame:
    """``(fold, group, role)`` with role test / cal / fit; calibration groups come from the training side.

    ``n_cal`` takes an absolute number of groups, else ``cal_frac`` of the training groups (at least 1).
    """
    every = folds.select(group, F.col("fold").alias("_own"),
                         F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold"))
    test = every.where("fold = _own").select("fold", group, F.lit("test").alias("role"))
    train = every.where("fold <> _own").select("fold", group, unit_hash(seed, "fold", group).alias("_u"))
    if n_cal is None and not cal_frac:
        return test.unionByName(train.select("fold", group, F.lit("fit").alias("role")))
    take = F.lit(n_cal) if n_cal is not None else F.greatest(F.lit(1), F.round(F.col("n_total") * cal_frac))
    train = dense_index(train, ["fold"], "_u", group).select(
        "fold", group, F.when(F.col("idx") < take, "cal").otherwise("fit").alias("role"))
    return test.unionByName(train)


def shift_roles(samples: DataFrame, rules: dict[str, tuple[Column, Column]], group: str = "group_id") -> DataFrame:
    """``(split, group, role)`` from named (train condition, test condition) pairs over group attributes."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("split"),
                 F.when(train, "train").when(test, "test").alias("role"))
        for name, (train, test) in rules.items()])
    return (samples.select(group, F.explode(rows).alias("_r")).where("_r.role IS NOT NULL")
            .select("_r.split", group, "_r.role").distinct())


def leave_one_level_out(samples: DataFrame, column: str, levels: list, prefix: str = "holdout",
                        group: str = "group_id") -> DataFrame:
    return shift_roles(samples, {f"{prefix}_{column}_{v}": (F.col(column) != v, F.col(column) == v) for v in levels},
                       group)


def leaked_groups(roles: DataFrame, split: str = "fold", group: str = "group_id") -> DataFrame:
    """Groups seen on more than one side of a split; must be empty."""
    return roles.groupBy(split, group).agg(F.count_distinct("role").alias("n_roles")).where("n_roles > 1")


def assert_no_leak(roles: DataFrame, split: str = "fold", group: str = "group_id") -> None:
    bad = leaked_groups(roles, split, group).limit(5).count()
    if bad:
        raise AssertionError("a group appears in more than one role of a split")


def describe_splits(samples: DataFrame, roles: DataFrame, split: str = "fold", group: str = "group_id",
                    label: str = "class") -> DataFrame:
    per_group = samples.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    return (per_group.join(roles, group).groupBy(split, "role")
            .agg(F.sum("_n").alias("n_samples"), F.count_distinct(group).alias("n_groups"),
                 F.count_distinct(label).alias("n_classes")))


def one_per_group(samples: DataFrame, group: str = "group_id", sample: str = "sample_id", seed: int = 13) -> DataFrame:
    """One sample per group, chosen by hash (a max_by, so a hot group is reduced before the shuffle)."""
    return (samples.withColumn("_u", unit_hash(seed, sample))
            .groupBy(group).agg(F.min_by(sample, F.struct("_u", sample)).alias(sample)))


def random_subset(rows: DataFrame, keys: list[str], ident: str, n: int, seed: int) -> DataFrame:
    """Uniform subset of at most ``n`` rows per stratum (hash rank, no replacement)."""
    ranked = dense_index(rows.withColumn("_u", unit_hash(seed, *keys, ident)), keys, "_u", ident)
    return ranked.where(F.col("idx") < n).drop("idx", "n_total", "_u")


def small_combinations(ids: DataFrame, ident: str, size: int) -> DataFrame:
    """All ``size``-subsets of a small id table as ``(draw, ident)``; ids must be few (the caller checks).

    Theta self-join on ``ident``; the result is C(n, size) rows by definition of the operator.
    """
    out = ids.select(F.array(ident).alias("_set"))
    for _ in range(size - 1):
        nxt = ids.select(F.col(ident).alias("_x"))
        out = out.join(nxt, F.element_at("_set", -1) < F.col("_x")).select(
            F.concat("_set", F.array("_x")).alias("_set"))
    return out.select(F.concat_ws(";", "_set").alias("draw"), F.explode("_set").alias(ident))


def sampled_combinations(ids: DataFrame, ident: str, size: int, n_draws: int, seed: int) -> DataFrame:
    """``n_draws`` different ``size``-subsets of any number of ids as ``(draw, ident)``, all subsets equally likely.

    A draw is a rank below C(n, size) decided by a hash, turned into a subset by the combinatorial number system; the subsets are
    never listed.  Ranks that were drawn before are passed over.  A request for more than half of them takes the ranks in
    the order of their hashes, which are then fewer than twice the request.  C(n, size) has to fit a double exactly.
    """
    index = dense_index(ids.select(ident).distinct().withColumn("_u", unit_hash(seed, ident)), [], "_u", ident)
    n = index.count()
    total = math.comb(n, size)
    if total >= 1 << 53:
        raise ValueError(f"{total} subsets are too many to be ranked")
    spark, u = ids.sparkSession, lambda c: unit_hash(seed, c) + unit_hash(f"{seed}b", c) / 4294967296.0
    if 2 * n_draws > total:
        ranks = spark.range(total).select(F.col("id").alias("rank")).orderBy(u("rank"), "rank").limit(min(n_draws, total))
    else:
        tries = spark.range(4 * n_draws + 16).select("id", F.floor(u("id") * total).cast("long").alias("rank"))
        ranks = tries.groupBy("rank").agg(F.min("id").alias("id")).orderBy("id").limit(n_draws).select("rank")
    left, picks = F.col("rank"), []
    for i in range(size, 0, -1):
        upto = F.lit([math.comb(c, i) for c in range(n)]).cast("array<bigint>")
        ranks = ranks.withColumn(f"_c{i}", F.size(F.filter(upto, lambda v: v <= left)) - 1)  # noqa: B023
        ranks = ranks.withColumn(f"_r{i}", left - F.element_at(upto, F.col(f"_c{i}") + 1))
        left = F.col(f"_r{i}")
        picks.append(F.col(f"_c{i}").cast("long"))
    each = ranks.select(F.col("rank").alias("draw"), F.explode(F.array(*picks)).alias("idx"))
    return each.join(index.select(F.col("idx").cast("long").alias("idx"), ident), "idx").select("draw", ident)
