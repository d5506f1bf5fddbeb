"""Bootstrap over individuals, permutation nulls and random pairs, all driven by keyed hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import unit_hash
from ..functions.ranking import average_ranks, dense_index, join_same
from ..session import checked_broadcast, settle


def draw_weights(groups: DataFrame, n_draws: int, seed, group: str = "group_id", keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, draw, group, w)``: how often each group is picked when the G groups of a key are drawn with replacement.

    Every (draw, slot) pair picks position ⌊u·G⌋; the picks are counted before they meet the groups.
    """
    keys = list(keys)
    idx = dense_index(groups.select(*keys, group).distinct().withColumn("_u", unit_hash(seed, group)), keys, "_u", group)
    picks = (idx.select(*keys, "idx", "n_total", F.explode(F.sequence(F.lit(1), F.lit(n_draws))).alias("draw"))
             .select(*keys, "draw", F.floor(unit_hash(seed, "draw", "idx") * F.col("n_total")).alias("idx"))
             .groupBy(*keys, "draw", "idx").agg(F.count(F.lit(1)).alias("w")))
    return join_same(picks, idx.select(*keys, "idx", group), [*keys, "idx"]).select(*keys, "draw", group, "w")


def bootstrap_mean(values: DataFrame, keys: list[str], value: str, n_draws: int, seed, level: float = 0.95,
                   boundary: str = "exact", group: str = "group_id") -> DataFrame:
    """Percentile interval of a mean under resampling of the individuals of each key.

    Only per-individual (n, Σ) meet the draw weights.  With ``boundary='exact'`` a statistic at which
    every individual sits on 0 (or on 1) gets the exact binomial interval instead of a degenerate one.
    """
    per = values.where(F.col(value).isNotNull()).groupBy(*keys, group).agg(
        F.count(value).alias("n"), F.sum(value).alias("s"))
    w = draw_weights(per, n_draws, seed, group, keys)
    boot = (join_same(per, w, [*keys, group]).groupBy(*keys, "draw")
            .agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m")))
    a = (1 - level) / 2
    ci = boot.groupBy(*keys).agg(  # n_draws rows per key
        F.percentile("m", F.lit(a)).alias("lo"), F.percentile("m", F.lit(1 - a)).alias("hi"))
    point = per.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("n_groups"),
                                   F.min(F.col("s") / F.col("n")).alias("_min"), F.max(F.col("s") / F.col("n")).alias("_max"))
    j = join_same(point, ci, keys) if keys else point.withColumn("lo", ci.select("lo").scalar()).withColumn("hi", ci.select("hi").scalar())
    one = F.col("n_groups") < 2
    lo, hi = F.when(one, F.col("mean")).otherwise(F.col("lo")), F.when(one, F.col("mean")).otherwise(F.col("hi"))
    if boundary == "exact":
        edge = F.pow(F.lit(a), 1 / F.col("n_groups"))
        full, none = F.col("_min") == 1, F.col("_max") == 0
        lo = F.when(~one & full, edge).otherwise(lo)
        hi = F.when(~one & none, 1 - edge).otherwise(hi)
    return j.select(*keys, "n_groups", F.round("mean", 6).alias("mean"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


STATS = ["n", "correct", "seen", "covered", "empty", "size", "single"]


def set_statistics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Per-individual sums from which every metric of a resample follows (rows: group × class)."""
    flag = lambda c: F.sum(c.cast("int"))
    return scored.groupBy(*keys, "group_id", "class").agg(
        F.count(F.lit(1)).alias("n"), flag(F.col("call") == F.col("class")).alias("correct"),
        F.count("covered").alias("seen"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"),
        flag(F.col("set_size") == 0).alias("empty"), F.sum("set_size").alias("size"),
        flag(F.col("set_size") == 1).alias("single"))


def set_metrics(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy, coverage, empty rate, mean size, singleton rate from class-level sums."""
    t = {c: F.sum(c) for c in STATS}
    return sums.groupBy(*keys).agg(
        (t["correct"] / t["n"]).alias("accuracy"),
        F.avg(F.when(F.col("seen") > 0, F.col("correct") / F.col("n"))).alias("balanced_accuracy"),
        F.try_divide(t["covered"], t["seen"]).alias("coverage"), (t["empty"] / t["n"]).alias("empty_rate"),
        (t["size"] / t["n"]).alias("mean_set_size"), (t["single"] / t["n"]).alias("singleton_rate"))


METRICS = ["accuracy", "balanced_accuracy", "coverage", "empty_rate", "mean_set_size", "singleton_rate"]


def bootstrap_metrics(stats: DataFrame, keys: list[str], weights: DataFrame) -> DataFrame:
    """Draw-level metrics: weighted class sums first, one row per (key, draw) after."""
    w = (stats.join(weights, "group_id").groupBy(*keys, "draw", "class")
         .agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in STATS]))
    return set_metrics(w, [*keys, "draw"])


def interval(draws: DataFrame, point: DataFrame, keys: list[str], metrics: list[str], level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    long = draws.unpivot([*keys, "draw"], metrics, "metric", "value")
    ci = long.groupBy(*keys, "metric").agg(F.round(F.percentile("value", F.lit(a)), 6).alias("lo"),
                                           F.round(F.percentile("value", F.lit(1 - a)), 6).alias("hi"))
    p = point.unpivot(keys, metrics, "metric", "_v")
    return p.join(ci, [*keys, "metric"]).select(*keys, "metric", F.round("_v", 6).alias("value"), "lo", "hi")


def bootstrap_difference(first: DataFrame, second: DataFrame, value: str, n_draws: int, seed, paired: bool,
                         group: str = "group_id") -> DataFrame:
    """mean(first) − mean(second) with an interval.

    Paired: each draw picks from the individuals of either frame, so the same people count in both, and one who is
    in one frame only counts there alone.  Unpaired: each frame's own individuals are drawn.
    """
    def sums(df):
        return df.groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("s"))

    def means(per, w):
        return per.join(w, group).groupBy("draw").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))

    p1, p2 = sums(first), sums(second)
    w1 = draw_weights(p1.select(group).union(p2.select(group)) if paired else p1, n_draws, seed, group)
    w2 = w1 if paired else draw_weights(p2, n_draws, f"{seed}b", group)
    m1, m2 = means(p1, w1), means(p2, w2)
    point = lambda p: p.agg(F.sum("s") / F.sum("n")).scalar()
    d = m1.join(m2.withColumnRenamed("m", "m2"), "draw").select((F.col("m") - F.col("m2")).alias("d"))
    return d.agg(F.round(F.percentile("d", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("d", F.lit(0.975)), 6).alias("hi")).select(
        F.lit(paired).alias("paired"), F.round(point(p1) - point(p2), 6).alias("difference"), "lo", "hi")


# ---- permutations -----------------------------------------------------------------------------------------------
#: Slices of a power of two for hashed units: enough to spread a stratum, few enough that their counts combine before the shuffle.
UNIT_SLICES = 64


def permuted(rows: DataFrame, strata: list[str], columns: list[str], n_perm: int, seed, ident: str = "sample_id",
             carry: Sequence[str] = ()) -> DataFrame:
    """``(perm, ident, strata, carry, columns)`` with the columns shuffled among the rows of each stratum.

    Position by the hash of (perm, id) takes the values held at the same position of a fixed order;
    both positions come from the skew-safe index, so no stratum is sorted whole when it is large.  Columns to ``carry`` stay with
    their row, so that no join by id follows; the held side is the smaller one by ``n_perm`` and is hashed, not sorted.
    """
    base = dense_index(rows.select(ident, *strata, *columns).withColumn("_u", unit_hash(seed, ident)), strata, "_u", ident, slices=UNIT_SLICES)
    held = base.select(*strata, "idx", *columns)
    place = _places(rows.select(ident, *strata, *carry), strata, n_perm, seed, ident).select("perm", ident, *strata, *carry, "idx")
    return place.join(held.hint("shuffle_hash"), [*strata, "idx"]).drop("idx")


def _places(rows: DataFrame, strata: list[str], n_perm: int, seed, ident: str) -> DataFrame:
    """The rows once per labelling with their position (``idx``) in the stratum's order by the hash of (perm, id)."""
    every = (rows.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))
             .withColumn("_u", unit_hash(seed, "perm", ident)))
    return dense_index(every, ["perm", *strata], "_u", ident, slices=UNIT_SLICES)


#: Positions in one bit mask and in one block of masks.
_MASK, _BLOCK = 62, 62 * 64


def permuted_flags(rows: DataFrame, strata: list[str], flag: str, n_perm: int, seed, ident: str = "sample_id",
                   carry: Sequence[str] = ()) -> DataFrame:
    """``permuted`` for one boolean column without nulls: ``(perm, carry, flag)``.

    The flags held at 3,968 neighbouring positions are one row of bit masks.  Those rows meet the places by broadcast while they are
    small (a bit per row of the table), so that only the places are shuffled, once.
    """
    base = dense_index(rows.select(ident, *strata, flag).withColumn("_u", unit_hash(seed, ident)), strata, "_u", ident, slices=UNIT_SLICES)
    bit = F.when(F.col(flag), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("idx") % _MASK).cast("int"))).otherwise(F.lit(0).cast("long"))
    masks = (base.groupBy(*strata, F.floor(F.col("idx") / _BLOCK).alias("_block"), F.floor(F.col("idx") % _BLOCK / _MASK).cast("int").alias("_at"))
             .agg(F.sum(bit).alias("_mask")))
    held = masks.groupBy(*strata, "_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_mask"))), lambda m: m["_mask"]).alias("_masks"))
    place = _places(rows.select(ident, *strata, *carry), strata, n_perm, seed, ident).withColumn("_block", F.floor(F.col("idx") / _BLOCK))
    mask = F.get("_masks", F.floor(F.col("idx") % _BLOCK / _MASK).cast("int"))
    return (place.join(checked_broadcast(held), [*strata, "_block"])
            .select("perm", *carry, (F.getbit(mask, (F.col("idx") % _MASK).cast("int")) == 1).alias(flag)))


def permutation_p(null: DataFrame, observed: Column, stat: str, two_sided: bool = True) -> Column:
    x, o = (F.abs(F.col(stat)), F.abs(observed)) if two_sided else (F.col(stat), observed)
    return (F.count_if(x >= o - 1e-9) + 1) / (F.count(F.lit(1)) + 1)


def stratum_ranks(rows: DataFrame, strata: list[str], value: str, out: str) -> DataFrame:
    """Rank within the stratum scaled to (−0.5, 0.5)."""
    return (average_ranks(rows, strata, value, "_r").withColumn(out, F.col("_r") / (F.col("n_total") + 1) - 0.5)
            .drop("_r", "n_total"))


def permutation_correlation(rows: DataFrame, x: str, y: str, n_perm: int, seed, strata: list[str] | None = None,
                            ident: str = "sample_id") -> DataFrame:
    """Rank correlation with a two-sided permutation p (+1); ranks and shuffles stay within strata if given."""
    strata = strata or []
    if strata:
        r = stratum_ranks(stratum_ranks(rows, strata, x, "rx"), strata, y, "ry")
    else:
        r = average_ranks(average_ranks(rows, [], x, "rx").drop("n_total"), [], y, "ry").drop("n_total")
    r = settle(r.select(ident, *strata, "rx", "ry"))
    null = (permuted(r, strata, ["ry"], n_perm, seed, ident, ["rx"])
            .groupBy("perm").agg(F.round(F.corr("rx", "ry"), 9).alias("rho")))
    obs = r.agg(F.round(F.corr("rx", "ry"), 9)).scalar()
    return null.withColumn("_o", obs).groupBy("_o").agg(
        permutation_p(null, F.col("_o"), "rho").alias("_p"), F.count(F.lit(1)).alias("n_perm")).select(
        F.round("_o", 6).alias("rho"), F.round("_p", 6).alias("p_value"), "n_perm")


def separation(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Distance of two group centres over the pooled within-group spread, from per-feature moments."""
    m = rows.groupBy(*keys, "feature_id", label).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count(F.lit(1))).alias("w"))
    f = m.groupBy(*keys, "feature_id").agg(
        (F.max(F.when(F.col(label), F.col("m"))) - F.max(F.when(~F.col(label), F.col("m")))).alias("d"),
        F.sum("w").alias("w"), F.sum("n").alias("n"))
    return f.groupBy(*keys).agg(F.round(F.sqrt(F.sum(F.col("d") ** 2)) / F.sqrt(F.sum("w") / (F.max("n") - 2)), 9).alias("distance"))


def random_pairs(ids: DataFrame, ident: str, n_pairs: int, seed) -> DataFrame:
    """``n_pairs`` hash-drawn ordered pairs (i ≠ j) of ids: never a cross product of the table."""
    idx = dense_index(ids.select(ident).distinct().withColumn("_u", unit_hash(seed, ident)), [], "_u", ident)
    n = idx.agg(F.max("n_total")).scalar()
    draws = idx.sparkSession.range(n_pairs).select(F.col("id").alias("pair"), n.alias("n"))
    a = F.floor(unit_hash(f"{seed}i", "pair") * F.col("n"))
    step = 1 + F.floor(unit_hash(f"{seed}j", "pair") * (F.col("n") - 1))
    p = draws.select("pair", a.alias("_a"), ((a + step) % F.col("n")).alias("_b"))
    left = idx.select(F.col("idx").alias("_a"), F.col(ident).alias(f"{ident}_a"))
    right = idx.select(F.col("idx").alias("_b"), F.col(ident).alias(f"{ident}_b"))
    return p.join(left, "_a").join(right, "_b").select("pair", f"{ident}_a", f"{ident}_b")
