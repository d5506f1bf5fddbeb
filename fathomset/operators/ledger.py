"""Metric ledger, anchors, table equality and before/after reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"value": F.max, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def metric_ledger(table: DataFrame, source: str, specs: list[tuple[str, str, str, str, float]]) -> DataFrame:
    """One row per (metric, predicate, column, aggregate, tolerance), all computed in one pass.

    The aggregate ``value`` demands exactly one selected row; otherwise its value is NULL.
    """
    cols = []
    for name, where, column, agg, _ in specs:
        pick = F.expr(where)
        v = AGGREGATES[agg](F.when(pick, F.col(column))).cast("double")
        n = F.count_if(pick)
        cols.append(F.struct(F.when((n == 1) | F.lit(agg != "value"), v).alias("v"), n.alias("n")).alias(name))
    row = table.agg(*cols)
    items = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(source).alias("source"), F.lit(w).alias("predicate"), F.lit(c).alias("column_name"),
                 F.lit(a).alias("aggregate"), F.lit(float(t)).alias("tolerance"), F.round(F.col(f"{m}.v"), 6).alias("value"),
                 F.col(f"{m}.n").alias("n_rows")) for m, w, c, a, t in specs]))
    return row.select(items.alias("_i")).select("_i.*")


def check_anchors(ledger: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors ``(metric, expected)`` beside the ledger value; ``ok`` is false outside the tolerance or when absent."""
    j = anchors.join(ledger, "metric", "left")
    ok = F.coalesce(F.abs(F.col("value") - F.col("expected")) <= F.col("tolerance"), F.lit(False))
    return j.select("metric", "expected", "value", ok.alias("ok"))


def assert_anchors(ledger: DataFrame, anchors: DataFrame) -> None:
    bad = [r["metric"] for r in check_anchors(ledger, anchors).where("NOT ok").select("metric").limit(20).collect()]
    if bad:
        raise AssertionError(f"values outside their anchors: {bad}")


def table_differences(a: DataFrame, b: DataFrame, keys: list[str], tol: float = 1e-6) -> DataFrame:
    """Rows that differ: missing on a side, or a value apart by more than ``tol`` (NULL = NULL, ∞ = ∞)."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the tables have different columns")
    values = [c for c in a.columns if c not in keys]
    numeric = {c for c, k in a.dtypes if k in ("double", "float", "int", "bigint", "smallint", "tinyint") or k.startswith("decimal")}
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in values], F.lit(1).alias("_in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in values], F.lit(1).alias("_in_b"))
    j = left.join(right, keys, "full_outer")

    def same(c):
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return x.eqNullSafe(y) | (F.coalesce(F.abs(x - y) <= tol, F.lit(False)) if c in numeric else F.lit(False))
    wrong = F.array_compact(F.array(*[F.when(~same(c), F.lit(c)) for c in values]))
    what = F.when(F.col("_in_b").isNull(), "only in first").when(F.col("_in_a").isNull(), "only in second").when(F.size(wrong) > 0, "values differ")
    return j.select(*keys, what.alias("difference"), F.concat_ws(";", wrong).alias("columns")).where("difference IS NOT NULL")


def reconcile(before: DataFrame, after: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    j = before.select(*on, F.col(value).alias("before")).join(after.select(*on, F.col(value).alias("after")), on, "full_outer")
    state = (F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone")
             .when(F.col("before") == F.col("after"), "same").otherwise("changed"))
    return j.select(*on, "before", "after", F.round(F.col("after") - F.col("before"), 6).alias("delta"), state.alias("state"))
