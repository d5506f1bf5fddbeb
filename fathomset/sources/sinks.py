"""Writers: score dumps, model tables, CSV/JSON made safe for spreadsheets and strict parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_csv_cell
from ..session import scratch_path


def write_scores(spark: SparkSession, tables: dict[str, DataFrame], folder: str | None = None,
                 partition_by: str | None = None) -> str:
    """Dump score tables for later replay; returns the folder."""
    folder = folder or scratch_path(spark, "scores")
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(partition_by) if partition_by else w).parquet(f"{folder}/{name}")
    spark.createDataFrame([(n,) for n in tables], "name string").coalesce(1).write.mode("overwrite").json(f"{folder}/_tables")
    return folder


def read_scores(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    names = [r["name"] for r in spark.read.schema("name string").json(f"{folder}/_tables").collect()]
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def json_safe(df: DataFrame) -> DataFrame:
    """NaN becomes NULL and ±infinity the strings inf / -inf, so every JSON parser reads the file."""
    inf = float("inf")
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            text = F.when(c == inf, "inf").when(c == -inf, "-inf").when(F.isnan(c), None).otherwise(c.cast("string"))
            c = text.alias(name)
        cols.append(c)
    return df.select(*cols)


def csv_safe(df: DataFrame) -> DataFrame:
    return df.select(*[safe_csv_cell(f"`{n}`").alias(n) if k == "string" else F.col(f"`{n}`") for n, k in df.dtypes])


def write_csv(df: DataFrame, path: str, compressed: bool = False) -> None:
    csv_safe(df).write.mode("overwrite").option("header", True).option(
        "compression", "gzip" if compressed else "none").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    json_safe(df).write.mode("overwrite").json(path)


def write_model(spark: SparkSession, coef: DataFrame, intercept: DataFrame, scale: DataFrame, folder: str | None = None) -> str:
    """Model export as three tables: coef(candidate, feature_id, w), intercept(candidate, b), scale(feature_id, mean, sd)."""
    return write_scores(spark, {"model_coef": coef, "model_intercept": intercept, "model_scale": scale}, folder)
