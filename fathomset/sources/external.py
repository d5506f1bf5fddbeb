"""External cohorts: individuals capped per class by hash, normalised; metabolite tables on a common key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import exact_quantiles
from ..functions.text import bare_key
from ..operators.matrices import log_cpm
from ..operators.splits import random_subset
from ..session import checked_broadcast


def prepare_cohort(counts: DataFrame, per_class: int, seed: int) -> DataFrame:
    """Keep a hash-random set of ``per_class`` individuals in every class (the sampling is the operator), log2 CPM."""
    donors = random_subset(counts.select("class", "group_id").distinct(), ["class"], "group_id", per_class, seed)
    return log_cpm(counts.join(checked_broadcast(donors), ["class", "group_id"], "left_semi"))


def log_tpm(value: str = "value"):
    return F.log2(F.col(value) + 1)


def centred_metabolites(areas: DataFrame) -> DataFrame:
    """log2(area + 1), minus the sample's median, averaged over entries sharing a normalised name."""
    x = areas.withColumn("value", F.log2(F.greatest(F.col("area"), F.lit(0.0)) + 1)).withColumn("feature_id", bare_key("name"))
    med = exact_quantiles(x, ["sample_id"], "value", {"median": 0.5}).select("sample_id", "median")
    return x.join(med, "sample_id").groupBy("sample_id", "feature_id").agg(F.avg(F.col("value") - F.col("median")).alias("value"))
