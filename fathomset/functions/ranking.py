"""Exact order statistics without sorting a whole group in one task.

A group (a class, a layer, a run) may hold a third of all rows, so a plain window over it would
sort it in a single task.  Here equal values are first collapsed to ``(key, value, n)`` with a
map-side combine.  Each value then names its own slice, by a rule that needs no look at the data: its
power of two, cut into equal parts.  Slices are sorted separately and offset by a table with one row per
key and slice.  The rule is monotone, so ranks are exact; the same rule serves tables of every size.
NULL keys are a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import settle

#: Parts into which each power of two is cut; a key of which half lies in one power has that half in so many slices.
SLICES = 4096


def value_slice(value: Column, slices: int = SLICES) -> Column:
    """The slice of a number: never decreasing in the value; NaN behind all numbers, NULL behind NaN."""
    v = value.cast("double")
    size = F.abs(v)
    power = F.least(F.floor(F.log2(size)), F.lit(1100))
    within = F.floor((size / F.pow(F.lit(2.0), power.cast("double")) - 1) * slices)
    far = F.lit(2200 * slices).cast("long")
    at = F.when(size == float("inf"), far).otherwise((power + 1100) * slices + within)
    return (F.when(v.isNull(), far + 2).when(F.isnan(v), far + 1).when(v == 0, F.lit(0).cast("long"))
            .when(v < 0, -at).otherwise(at))


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of one name in which NULL equals NULL."""
    names = {k: f"_same_{i}" for i, k in enumerate(keys)}
    renamed = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    same = F.lit(True)
    for k, r in names.items():
        same = same & F.col(k).eqNullSafe(F.col(r))
    return left.join(renamed, same, how).drop(*names.values())


def _over(keys: Sequence[str]) -> W:
    return W.partitionBy(*(keys or [F.lit(0)]))


def _key(keys: Sequence[str]) -> Column:
    """All keys as one struct, which is equal to itself with NULL fields too: a plain equi-join keeps the partitioning of the windows."""
    return F.struct(*(keys or [F.lit(0)]))


def _offsets(cut: DataFrame, n: Column) -> DataFrame:
    """Rows before each (key, slice) and in the whole key: one row per key and slice."""
    own = W.partitionBy("_key")
    return (cut.groupBy("_key", "_slice").agg(n.alias("_in_slice"))
            .withColumn("_offset", F.sum("_in_slice").over(own.orderBy("_slice").rowsBetween(W.unboundedPreceding, 0)) - F.col("_in_slice"))
            .withColumn("n_total", F.sum("_in_slice").over(own)).drop("_in_slice"))


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None,
                extra: dict[str, Column] | None = None, slices: int = SLICES) -> DataFrame:
    """One row per ``(keys, value)`` with ``n_eq``, ``n_below`` and ``n_total``; NULL values are left out.

    ``extra`` adds further aggregates per value (for example a count of positives).
    """
    keys = list(keys)
    n = F.sum(weight) if weight is not None else F.count(F.lit(1))
    flat = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
            .agg(n.alias("n_eq"), *[c.alias(k) for k, c in (extra or {}).items()]))
    cut = flat.withColumn("_slice", value_slice(F.col(value), slices)).withColumn("_key", _key(keys))
    run = W.partitionBy("_key", "_slice").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return (cut.withColumn("_cum", F.sum("n_eq").over(run)).join(_offsets(cut, F.sum("n_eq")), ["_key", "_slice"])
            .withColumn("n_below", F.col("_offset") + F.col("_cum") - F.col("n_eq"))
            .drop("_cum", "_offset", "_slice", "_key"))


def positions(df: DataFrame, keys: Sequence[str], by: Column, order: Sequence[str], out: str, slices: int = SLICES) -> DataFrame:
    """0-based position of every row within ``keys`` in the given order, and ``n_total``; no row is lost.

    ``by`` is a number that never decreases in that order (NULL last).
    """
    cut = df.withColumn("_slice", value_slice(by, slices)).withColumn("_key", _key(list(keys)))
    run = W.partitionBy("_key", "_slice").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return (cut.withColumn("_rn", F.row_number().over(run)).join(_offsets(cut, F.count(F.lit(1))), ["_key", "_slice"])
            .withColumn(out, F.col("_offset") + F.col("_rn") - 1).drop("_slice", "_rn", "_offset", "_key"))


def in_order(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """0-based position of every row in the order of those columns, over the whole table.

    The table is dealt into ranges and written, so that a row's range is the same whenever it is read; ranges are
    sorted separately and offset by their sizes.
    """
    ranged = settle(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    return positions(ranged, [], F.col("_range"), list(order), out).drop("_range", "n_total")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "avg_rank",
                  slices: int = SLICES) -> DataFrame:
    """Attach the tie-averaged rank of ``value`` within ``keys`` and the group's ``n_total``."""
    ranks = (value_ranks(df, keys, value, slices=slices)
             .withColumn(out, F.col("n_below") + (F.col("n_eq") + F.lit(1)) / 2.0)
             .select(*keys, value, out, "n_total"))
    return join_same(df.where(F.col(value).isNotNull()), ranks, [*keys, value])


def kth_smallest(ranks: DataFrame, keys: Sequence[str], value: str, k: Column, out: str) -> DataFrame:
    """Pick the k-th smallest value per key from :func:`value_ranks` output (k may use ``n_total``)."""
    hit = (F.col("n_below") < k) & (k <= F.col("n_below") + F.col("n_eq"))
    return ranks.groupBy(*keys).agg(F.max(F.when(hit, F.col(value))).alias(out),
                                    F.max("n_total").alias("n_total"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    slices: int = SLICES) -> DataFrame:
    """Linear-interpolation quantiles per key, exact and skew-safe; one column per name in ``probs``."""
    ranks = value_ranks(df, keys, value, slices=slices)
    picks, finish = [], []
    for name, p in probs.items():
        h = (F.col("n_total") - 1) * F.lit(float(p))
        for tag, pos in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("n_below") <= pos) & (pos < F.col("n_below") + F.col("n_eq"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{tag}"))
        frac = (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
        finish.append((F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * frac).alias(name))
    return (ranks.groupBy(*keys).agg(F.max("n_total").alias("n"), *picks)
            .select(*keys, "n", *finish))


def dense_index(df: DataFrame, keys: Sequence[str], unit: str, tie: str, out: str = "idx",
                slices: int = SLICES) -> DataFrame:
    """0-based position of every row within ``keys`` ordered by a uniform hash column ``unit``, and ``n_total``."""
    return positions(df, keys, F.col(unit), [unit, tie], out, slices)


def benjamini_hochberg(df: DataFrame, keys: Sequence[str], p: str, out: str = "p_adj",
                       slices: int = SLICES) -> DataFrame:
    """Adjusted p per family: ``min over larger p of p·n/rank``, capped at 1 (a tied p takes its last rank).

    The suffix minimum is taken inside each slice and combined with the minima of the slices behind it; slices
    follow the powers of two, so p-values that crowd near 0 are spread as well.
    """
    keys = list(keys)
    ranks = (value_ranks(df, keys, p, slices=slices)
             .withColumn("_raw", F.col(p) * F.col("n_total") / (F.col("n_below") + F.col("n_eq")))
             .withColumn("_slice", value_slice(F.col(p), slices)))
    behind = _over(keys).orderBy("_slice").rowsBetween(1, W.unboundedFollowing)
    later = (ranks.groupBy(*keys, "_slice").agg(F.min("_raw").alias("_m"))
             .withColumn("_later", F.min("_m").over(behind)).drop("_m"))
    suffix = W.partitionBy(*keys, "_slice").orderBy(p).rowsBetween(0, W.unboundedFollowing)
    adj = (join_same(ranks.withColumn("_own", F.min("_raw").over(suffix)), later, [*keys, "_slice"])
           .select(*keys, p, F.least(F.lit(1.0), F.col("_own"), F.col("_later")).alias(out)))
    return join_same(df, adj, [*keys, p], "left")
