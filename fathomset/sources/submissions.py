"""Bulk ingest of submitted tables: orientation, format, labels, library sizes and quality rules per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LABEL_PATTERN, SUMMARY_PREFIX, feature_key, number_cell
from ..operators.matrices import cpm
from ..session import checked_broadcast
from .wide import numbered_lines, split_table

# fixed values: a table with this many features is read as counts; counts of fewer than so many features get a warning; plausible range of log2(CPM + 1)
MIN_FEATURES_FOR_COUNTS, FEW_FEATURES, LOG2CPM_MIN, LOG2CPM_MAX = 200, 10_000, -0.5, 20.0
COUNTS, LOG2CPM = "counts", "log2cpm"


def read_cells(spark: SparkSession, folder: str, panel: DataFrame) -> DataFrame:
    """``file, row, column, cell, orientation`` for every data cell.

    Orientation is decided per file by where more panel features are found: in the header or in the
    first column (ties: the longer side holds the features).
    """
    t = split_table(numbered_lines(spark, folder).where(~F.col("line").startswith("#")))
    keys = checked_broadcast(panel_keys(panel).select("_k"))
    first = t.select("file", feature_key(F.col("cells")[0]).alias("_k"), F.size("header").alias("_w"))
    in_first = first.join(keys.withColumn("_hit", F.lit(1)), "_k", "left").groupBy("file").agg(
        F.count("_hit").alias("_first"), F.count(F.lit(1)).alias("_rows"), (F.max("_w") - 1).alias("_cols"))
    heads = t.groupBy("file").agg(F.first("header").alias("header")).select(
        "file", F.explode(F.expr("slice(header, 2, size(header))")).alias("_n")).select("file", feature_key("_n").alias("_k"))
    in_head = heads.join(keys, "_k", "left_semi").groupBy("file").agg(F.count(F.lit(1)).alias("_head"))
    h = F.coalesce(F.col("_head"), F.lit(0))
    side = (F.when(h > F.col("_first"), "samples_x_genes").when(h < F.col("_first"), "genes_x_samples")
            .when(F.col("_rows") > F.col("_cols"), "genes_x_samples").otherwise("samples_x_genes"))
    layout = in_first.join(in_head, "file", "left").select("file", side.alias("orientation"))
    body = t.join(checked_broadcast(layout), "file")
    # a short row still yields a (NULL) cell for every header column: missing, never 0
    return body.select("file", "orientation", "block", "seq", F.col("cells")[0].alias("row"), F.posexplode("header").alias("_i", "column"), "cells").where(
        "_i > 0").select("file", "orientation", "row", "column", F.get("cells", F.col("_i")).alias("cell"),
                         (F.size("cells") <= F.col("_i")).alias("short"), F.struct("block", "seq").alias("row_at"), F.col("_i").alias("column_at"))


def long_rows(cells: DataFrame) -> DataFrame:
    """``file, sample_id, feature, cell, short, at`` whatever the orientation; ``at`` is the feature's place in the file."""
    genes_down = F.col("orientation") == "genes_x_samples"
    return cells.select("file", "orientation", F.when(genes_down, F.col("column")).otherwise(F.col("row")).alias("sample_id"),
                        F.when(genes_down, F.col("row")).otherwise(F.col("column")).alias("feature"), "cell", "short",
                        F.when(genes_down, F.col("row_at")).otherwise(F.struct(F.lit(0).cast("long").alias("block"), F.col("column_at").cast("long").alias("seq"))).alias("at"))


def claimed_labels(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("feature").rlike(LABEL_PATTERN)).select("file", "sample_id", F.col("cell").alias("label"))


def measured(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("feature").rlike(LABEL_PATTERN) & ~F.col("feature").startswith(SUMMARY_PREFIX)).withColumn(
        "value", number_cell("cell"))


def sample_libraries(rows: DataFrame) -> DataFrame:
    """Library size and input-quality counts per sample; NULL cells stay outside the library."""
    v = F.col("value")
    return measured(rows).groupBy("file", "sample_id").agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("library"), F.count(F.lit(1)).alias("n_features"),
        F.count_if(v.isNull()).alias("n_missing"), F.count_if(v < 0).alias("n_negative"),
        F.count_if((v >= 0) & (v != F.floor(v))).alias("n_fractional"), F.count_if(F.col("short")).alias("n_short"),
        F.min("value").alias("lo"), F.max("value").alias("hi"))


def file_formats(rows: DataFrame, min_features: int = MIN_FEATURES_FOR_COUNTS) -> DataFrame:
    """``file, format, n_features``: decided for a whole file before any of its rows is scaled.

    A table with many features is a count matrix, which is turned to log2 CPM by its own library sizes; a short one holds
    values on that scale already.
    """
    n = measured(rows).groupBy("file").agg(F.count_distinct("feature").alias("n_features"))
    return n.select("file", F.when(F.col("n_features") >= min_features, COUNTS).otherwise(LOG2CPM).alias("format"), "n_features")


def panel_keys(panel: DataFrame) -> DataFrame:
    """``_k, feature_id``: a panel feature is found by its id or, where the panel has the column, by its symbol."""
    names = [c for c in ("feature_id", "symbol") if c in panel.columns]
    each = panel.select("feature_id", F.explode(F.array(*[feature_key(c) for c in names])).alias("_k")).where("_k IS NOT NULL")
    return each.groupBy("_k").agg(F.min("feature_id").alias("feature_id"))


def panel_values(rows: DataFrame, panel: DataFrame, libraries: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """Panel features only, on the log2 CPM scale: counts by their library, other files as given.

    ``formats`` is :func:`file_formats`; without it every file holds counts.  Where a file names a panel feature more than
    once, the first counts, a blank one too.
    """
    hit = measured(rows).withColumn("_k", feature_key("feature")).join(checked_broadcast(panel_keys(panel)), "_k")
    hit = hit.groupBy("file", "sample_id", "feature_id").agg(F.min_by("value", "at").alias("value"))
    scaled = hit.join(libraries.select("file", "sample_id", "library"), ["file", "sample_id"]).withColumn("_cpm", cpm("value", "library"))
    if formats is None:
        return scaled.select("file", "sample_id", "feature_id", F.col("_cpm").alias("value"))
    return scaled.join(checked_broadcast(formats.select("file", "format")), "file").select(
        "file", "sample_id", "feature_id", F.when(F.col("format") == COUNTS, F.col("_cpm")).otherwise(F.col("value")).alias("value"))


def quality_report(rows: DataFrame, panel_rows: DataFrame, n_panel: int, formats: DataFrame | None = None) -> DataFrame:
    """One row per file: how often each input rule is broken; a rule looks only at files of the format it is about.

    Counts: missing, negative and fractional cells, empty libraries, summary rows, too few features for a library.  Values
    on the log scale: a panel value that log2(CPM + 1) cannot take.  Both: short rows and panel features that are not found.
    """
    lib = sample_libraries(rows)
    formats = file_formats(rows) if formats is None else formats
    v = F.col("value")
    found = panel_rows.groupBy("file").agg(F.count_distinct(F.when(v.isNotNull(), F.col("feature_id"))).alias("_f"),
                                           F.coalesce(F.max(((v < LOG2CPM_MIN) | (v > LOG2CPM_MAX)).cast("int")), F.lit(0)).alias("_out"))
    summary = rows.where(F.col("feature").startswith(SUMMARY_PREFIX)).groupBy("file").agg(
        F.count_distinct("feature").alias("_s"))
    r = lib.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("n_missing").alias("n_missing"),
        F.sum("n_negative").alias("n_negative"), F.sum("n_fractional").alias("n_fractional"), F.sum("n_short").alias("n_short"),
        F.count_if(F.col("library") <= 0).alias("n_empty_libraries"))
    j = r.join(formats, "file").join(found, "file", "left").join(summary, "file", "left")
    counts = F.col("format") == COUNTS
    only = lambda c: F.when(counts, F.col(c)).otherwise(0).alias(c)
    return j.select(
        "file", "format", "n_samples", "n_features", *[only(c) for c in ("n_missing", "n_negative", "n_fractional")], "n_short", only("n_empty_libraries"),
        F.when(counts, F.coalesce("_s", F.lit(0))).otherwise(0).alias("n_summary_rows"), (counts & (F.col("n_features") < FEW_FEATURES)).alias("few_features"),
        F.when(~counts, F.coalesce("_out", F.lit(0))).otherwise(0).alias("outside_log_range"), (F.lit(n_panel) - F.coalesce("_f", F.lit(0))).alias("n_panel_missing"))


def guess_species(ids: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Species from Ensembl prefixes, else from the case of gene symbols."""
    x = F.trim(ident)
    code = F.upper(F.regexp_extract(x, r"(?i)^ENS([A-Z]{0,4})G\d{6,}", 1))
    ens = x.rlike(r"(?i)^ENS([A-Z]{0,4})G\d{6,}")
    sym = ~ens & x.rlike(r"^[A-Za-z][A-Za-z0-9-]{1,}$")
    upper = sym & (x == F.upper(x)) & x.rlike("[A-Z]")
    cap = sym & ~upper & x.rlike("^[A-Z][a-z0-9]")
    n: dict[str, Column] = {"ens": ens, "human": ens & (code == ""), "mouse": ens & (code == "MUS"),
                            "rat": ens & (code == "RNO"), "sym": sym, "upper": upper, "cap": cap}
    s = ids.groupBy(*keys).agg(*[F.count_if(c).alias(k) for k, c in n.items()])
    c = F.col
    species = (F.when(c("ens") >= F.greatest(F.lit(5.0), 0.5 * (c("ens") + c("sym"))),
                      F.when(c("human") > 0.5 * c("ens"), "human").when(c("mouse") > 0.5 * c("ens"), "mouse")
                      .when(c("rat") > 0.5 * c("ens"), "rat").otherwise("unknown"))
               .when((c("sym") >= 5) & (c("upper") > 0.8 * c("sym")), "human")
               .when((c("sym") >= 5) & (c("cap") > 0.5 * c("sym")), "rat or mouse").otherwise("unknown"))
    return s.select(*keys, species.alias("species"))
