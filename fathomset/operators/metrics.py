"""Classification metrics and summaries over a ``calls`` table (one row per tested sample)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ranking import value_ranks


def calls(probs: DataFrame, keys: list[str]) -> DataFrame:
    """Called class (first name on ties), its probability and the probability of the true class."""
    best = F.struct(-F.col("p"), F.col("candidate"))
    return probs.groupBy(*keys).agg(
        F.min_by("candidate", best).alias("call"), F.max("p").alias("call_p"),
        F.max(F.when(F.col("candidate") == F.col("class"), F.col("p"))).alias("p_true"))


def class_counts(called: DataFrame, keys: list[str]) -> DataFrame:
    """support / called / hit per class from one confusion table (both margins by explode, no self-join)."""
    conf = called.groupBy(*keys, "class", "call").agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(
        F.struct(F.col("class").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"),
                 F.when(F.col("class") == F.col("call"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("call").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"),
                 F.lit(0).cast("long").alias("hit"))))
    return (conf.select(*keys, sides.alias("_s")).groupBy(*keys, F.col("_s.c").alias("class"))
            .agg(F.sum("_s.support").alias("support"), F.sum("_s.called").alias("called"), F.sum("_s.hit").alias("hit")))


def classification_metrics(called: DataFrame, keys: list[str], floor: float = 1e-9) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1 and log loss per key."""
    per = class_counts(called, keys).groupBy(*keys).agg(
        F.round(F.avg(F.when(F.col("support") > 0, F.col("hit") / F.col("support"))), 6).alias("balanced_accuracy"),
        F.round(F.avg(2 * F.col("hit") / (F.col("support") + F.col("called"))), 6).alias("macro_f1"))
    base = called.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("call") == F.col("class")).cast("double")), 6).alias("accuracy"),
        F.round(-F.avg(F.log(F.greatest(F.col("p_true"), F.lit(floor)))), 6).alias("log_loss"))
    return base.join(per, keys)


def fold_summary(per_fold: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    long = per_fold.unpivot([*keys, "fold"], metrics, "metric", "value")
    return long.groupBy(*keys, "metric").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"),
        F.count_distinct("fold").alias("n_folds"))


def confusion(called: DataFrame) -> DataFrame:
    n = called.groupBy("class", "call").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("class")), 6))


def confusable_pairs(called: DataFrame, top: int) -> DataFrame:
    wrong = called.where("class <> call").select(
        F.least("class", "call").alias("class_a"), F.greatest("class", "call").alias("class_b"))
    return (wrong.groupBy("class_a", "class_b").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "class_a", "class_b").limit(top))


def label_accuracy(called: DataFrame) -> DataFrame:
    """Per label: accuracy, the most frequent call with its share, and the most frequent wrong call."""
    conf = called.groupBy("class", "call").agg(F.count(F.lit(1)).alias("n"))
    wrong = F.col("call") != F.col("class")
    first = F.struct(-F.col("n"), F.col("call"))
    return conf.groupBy("class").agg(
        F.sum("n").alias("n"), F.round(F.sum(F.when(~wrong, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"),
        F.min_by("call", first).alias("most_frequent"), F.round(F.max("n") / F.sum("n"), 6).alias("most_frequent_share"),
        F.min_by(F.when(wrong, F.col("call")), F.when(wrong, first)).alias("main_wrong"))


def error_list(called: DataFrame, attributes: DataFrame, by: list[str]) -> DataFrame:
    return (called.where("call <> class").join(attributes, "sample_id").groupBy("class", "call", *by)
            .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("n_groups")))


def auroc(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by tie-averaged rank sum; NULL without both outcomes."""
    ranks = value_ranks(df, keys, score, extra={"n_pos": F.sum(F.col(positive).cast("long"))})
    avg_rank = F.col("n_below") + (F.col("n_eq") + 1) / 2.0
    s = ranks.groupBy(*keys).agg(F.sum(F.col("n_pos") * avg_rank).alias("_r"), F.sum("n_pos").alias("n_pos"),
                                 F.max("n_total").alias("n"), F.sum(F.pow("n_eq", 3) - F.col("n_eq")).alias("tie_sum"))
    u = F.col("_r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0
    return s.select(*keys, "n", "n_pos", F.try_divide(u, F.col("n_pos") * (F.col("n") - F.col("n_pos"))).alias("auroc"), "tie_sum")
