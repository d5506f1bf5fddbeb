"""Mean-difference scores of many labellings at once: a sample is one row with its vector and a bit for each labelling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labellings in one long, and rows that are multiplied at a time.
_BITS, _ROWS = 62, 2048


def label_bits(labels: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """``(keys, bits)`` from (keys, perm, flag): the flags of one row as longs of 62 labellings each, perm 0 first."""
    last = labels.agg(F.max("perm")).first()[0] or 0
    bit = F.when(F.col(flag), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("perm") % _BITS).cast("int"))).otherwise(F.lit(0).cast("long"))
    words = [F.sum(F.when(F.floor(F.col("perm") / _BITS) == i, bit).otherwise(F.lit(0).cast("long"))) for i in range(last // _BITS + 1)]
    return labels.groupBy(*keys).agg(F.array(*words).alias("bits"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with their values (rows × features, NaN where missing) and label words."""
    for a in range(0, batch.num_rows, _ROWS):
        part = batch.slice(a, _ROWS)
        values = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
        yield part, values, part.column("bits").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _flags(words: np.ndarray, n: int) -> np.ndarray:
    perm = np.arange(n)
    return (words[:, perm // _BITS] >> (perm % _BITS)) & 1


def weights(rows: DataFrame, key: str, n_labellings: int) -> DataFrame:
    """``(key, perm, w)``: mean of the labelled less mean of the others for each feature (NaN without either), from (key, vec, bits).

    Every task sums its rows first, so what is shuffled are labellings × features numbers of a task.
    """
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for part, x, words in _blocks(batch):
                own = part.column(key).to_numpy(zero_copy_only=False)
                seen = ~np.isnan(x)
                both = np.concatenate([np.where(seen, x, 0.0), seen], axis=1)
                flags = _flags(words, n_labellings).astype(float)
                for k in np.unique(own).tolist():
                    mine = own == k
                    found = np.concatenate([flags[mine].T @ both[mine], (1 - flags[mine]).T @ both[mine]], axis=1)
                    held[k] = held[k] + found if k in held else found
        for k, found in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * n_labellings, pa.int32()), pa.array(range(n_labellings), pa.int32()), pa.array(list(found), pa.list_(pa.float64()))],
                                             [key, "perm", "sums"])
    total = (rows.select(key, "vec", "bits").mapInArrow(sums, f"{key} int, perm int, sums array<double>")
             .groupBy(key, "perm").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("s")))
    size = F.floor(F.size("s") / 4).cast("int")
    mean = lambda i, first: F.coalesce(F.try_divide(F.get("s", i + first * size), F.get("s", i + (first + 1) * size)), F.lit(float("nan")))
    return total.select(key, "perm", F.transform(F.sequence(F.lit(0), size - 1), lambda i: mean(i, 0) - mean(i, 2)).alias("w"))


def scores(rows: DataFrame, key: str, table: DataFrame, arms: dict[str, tuple[int, int | None]]) -> DataFrame:
    """``(key, perm, arm, treated, score)`` of every row (key, vec, bits) and labelling; an arm is a range of features.

    The weights (labellings × features of each key) go to all tasks, as they are few; NULL where no feature has value and weight.
    """
    sent: dict = {}
    for r in table.orderBy(key, "perm").collect():
        sent.setdefault(r[key], []).append(r["w"])
    sent = {k: np.array(w, float) for k, w in sent.items()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x, words in _blocks(batch):
                own = part.column(key).to_numpy(zero_copy_only=False)
                for k in np.unique(own).tolist():
                    if k not in sent:
                        continue
                    w, mine = sent[k], own == k
                    flags = _flags(words[mine], len(w)).astype(bool)
                    for arm, (a, b) in arms.items():
                        v, u = x[mine, a:b], w[:, a:b]
                        out = np.round(np.where(np.isnan(v), 0.0, v) @ np.where(np.isnan(u), 0.0, u).T, 9)
                        none = ((~np.isnan(v)).astype(float) @ (~np.isnan(u)).astype(float).T) == 0
                        n = out.size
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(np.tile(np.arange(len(w), dtype=np.int32), len(out))),
                                                          pa.array([arm] * n), pa.array(flags.ravel()), pa.array(out.ravel(), mask=none.ravel())],
                                                         [key, "perm", "arm", "treated", "score"])
    return rows.select(key, "vec", "bits").mapInArrow(score, f"{key} int, perm int, arm string, treated boolean, score double")
