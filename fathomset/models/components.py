"""Principal components of a long table with any number of features, by a randomised range finder.

The standardised table Z (samples × features) is only met as rows (sample, feature, z).  Random directions, which every task
derives from the feature's name, are folded into a table of samples × rank; the table is carried back and forth between
samples and features, made orthogonal by blockwise QR each time, until its span is that of the leading components.  The
driver holds rank × rank numbers, whatever the table's size.  With a rank of at least the number of features (or samples) the result
is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import exact_quantiles
from ..operators.effects import moments, top_variance
from ..session import checked_broadcast, settle

#: Directions besides the wanted ones, power rounds, and blocks whose triangles reach the driver at most.
OVERSAMPLE, ROUNDS, BLOCKS = 60, 3, 64


@dataclass
class Components:
    """scores (sample, pcs), loadings (feature_id, center, scale, load), explained shares; the largest loading of each is positive."""

    scores: DataFrame
    loadings: DataFrame
    shares: list[float]
    sample: str

    def project(self, fact: DataFrame) -> DataFrame:
        """Scores of new samples on the stored loadings; features without loadings are ignored, absent ones stand at the centre."""
        j = fact.join(checked_broadcast(self.loadings), "feature_id")
        z = (F.coalesce("value", "center") - F.col("center")) / F.col("scale")
        return _summed(j, self.sample, F.transform("load", lambda w: w * z)).withColumnRenamed("vec", "pcs")


def _summed(rows: DataFrame, key: str, vector: Column) -> DataFrame:
    return rows.groupBy(key).agg(vector_to_array(Summarizer.sum(array_to_vector(vector))).alias("vec"))


def _directions(rank: int) -> Column:
    """Standard normal numbers decided by the feature's name (Box and Muller)."""
    unit = lambda i, salt: (F.shiftrightunsigned(F.xxhash64("feature_id", i, F.lit(salt)), 11) + 0.5) / float(1 << 53)
    return F.transform(F.sequence(F.lit(1), F.lit(rank)), lambda i: F.sqrt(-2 * F.log(unit(i, 1))) * F.cos(2 * np.pi * unit(i, 2)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def triangle(table: DataFrame) -> np.ndarray:
    """R of the QR factorisation of a tall table's ``vec`` rows: block by block, task by task, then over at most ``BLOCKS`` parts."""
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                block = _matrix(batch.column(0))
                held = np.linalg.qr(block if held is None else np.concatenate([held, block]), mode="r")
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.list_(pa.float64()))], ["vec"])
    rows = table.select("vec").mapInArrow(reduce, "vec array<double>").coalesce(BLOCKS).mapInArrow(reduce, "vec array<double>")
    return np.linalg.qr(np.array([r["vec"] for r in rows.collect()]), mode="r")


def times(table: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """Every row's ``vec`` times a small matrix."""
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(_matrix(batch.column(1)) @ matrix), pa.list_(pa.float64()))], [key, "vec"])
    return table.select(key, "vec").mapInArrow(multiply, f"`{key}` {dict(table.dtypes)[key]}, vec array<double>")


def _orthogonal(table: DataFrame, key: str) -> DataFrame:
    _, s, v = np.linalg.svd(triangle(table), full_matrices=False)
    good = s > s.max(initial=0) * 1e-12
    return settle(times(table, key, v.T[:, good] / s[good]))


def standardised(fact: DataFrame, prefilter: int | None = None, sample: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """((sample, feature_id, z), (feature_id, center, scale)): median for NULL values, the ``prefilter`` features of largest variance, sd 0 counts as 1."""
    # a median is sought only where it fills something
    open_ = fact.where("value IS NULL").select("feature_id").distinct()
    medians = exact_quantiles(fact.join(checked_broadcast(open_), "feature_id", "left_semi"), ["feature_id"], "value", {"_median": 0.5}).select("feature_id", "_median")
    rows = settle(fact.join(checked_broadcast(medians), "feature_id", "left").select(sample, "feature_id", F.coalesce("value", "_median").alias("value")))
    m = moments(rows, ["feature_id"])
    if prefilter is not None:
        m = m.join(top_variance(m, prefilter).select("feature_id"), "feature_id", "left_semi")
    sd = F.sqrt(F.col("m2") / F.greatest(F.col("n") - 1, F.lit(1)))
    scale = settle(m.select("feature_id", F.col("mean").alias("center"), F.when(sd > 0, sd).otherwise(1.0).alias("scale")))
    z = rows.join(checked_broadcast(scale), "feature_id").select(sample, "feature_id", ((F.col("value") - F.col("center")) / F.col("scale")).alias("z"))
    return settle(z), scale


def components(fact: DataFrame, k: int, prefilter: int | None = None, sample: str = "sample_id", rank: int | None = None, rounds: int = ROUNDS) -> Components:
    """The leading ``k`` components of a long table (sample, feature_id, value)."""
    z, scale = standardised(fact, prefilter, sample)
    rank = rank or k + OVERSAMPLE
    carry = lambda table, on, to: settle(_summed(z.join(checked_broadcast(table), on), to, F.transform("vec", lambda v: v * F.col("z"))))
    y = settle(_summed(z, sample, F.transform(_directions(rank), lambda v: v * F.col("z"))))
    for _ in range(rounds):
        w = carry(_orthogonal(y, sample), sample, "feature_id")
        y = carry(_orthogonal(w, "feature_id"), "feature_id", sample)
    q = _orthogonal(y, sample)
    b = carry(q, sample, "feature_id")  # the transpose of Qᵀ Z, a row per feature
    _, s, v = np.linalg.svd(triangle(b), full_matrices=False)
    n = min(k, int((s > s.max(initial=0) * 1e-10).sum()))
    load = settle(times(b, "feature_id", v.T[:, :n] / s[:n]))
    largest = load.agg(*[F.max_by(F.col("vec")[j], F.struct(F.abs(F.col("vec")[j]), "feature_id")).alias(f"c{j}") for j in range(n)]).first()
    sign = np.array([1.0 if x >= 0 else -1.0 for x in largest])
    total = z.agg(F.sum(F.col("z") * F.col("z"))).first()[0]
    scores = times(q, sample, v.T[:, :n] * s[:n] * sign).withColumnRenamed("vec", "pcs")
    loadings = times(load, "feature_id", np.diag(sign)).withColumnRenamed("vec", "load").join(scale, "feature_id")
    return Components(settle(scores), settle(loadings), (s[:n] ** 2 / total).tolist(), sample)
