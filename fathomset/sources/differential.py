"""Differential-analysis tables with one statistic and one adjusted p whatever the producing tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: first column present wins
STAT_COLUMNS = ["zscore", "tscore", "logFC"]
P_COLUMNS = ["adj_p_value", "selection_fdr", "p_value"]


def unify_differential(raw: DataFrame) -> DataFrame:
    """Add ``stat`` and ``padj``; lower-case ``sex`` and ``comparison_group`` where present."""
    stat = next((c for c in STAT_COLUMNS if c in raw.columns), None)
    if stat is None:
        raise ValueError(f"none of {STAT_COLUMNS} is present")
    p = next((c for c in P_COLUMNS if c in raw.columns), None)
    out = raw.withColumn("stat", F.col(stat).try_cast("double")).withColumn(
        "padj", F.col(p).try_cast("double") if p else F.lit(None).cast("double"))
    for c in ("sex", "comparison_group"):
        if c in raw.columns:
            out = out.withColumn(c, F.lower(F.trim(c)))
    return out
