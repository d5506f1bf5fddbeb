"""Nested, grouped tuning: whatever is fitted (medians, variances, scales, panel, classifier) sees inner training rows only.

Frames hold one row per sample: sample_id, group_id, class, label (index of the class), features (vector; NaN is missing).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import unit_hash
from ..functions.ranking import exact_quantiles
from ..operators.splits import grouped_kfold
from ..session import settle
from .pipelines import C_GRID, INNER_FOLDS, BalancedAccuracy, RoundRobinPanel, VarianceTopK, classifier, long_probabilities, vector_long

# fixed values: what is tried for each kind of classifier (inverse penalty; threshold of the shrunken centroids, 0 for none)
GRIDS = {"logreg_l2": C_GRID, "logreg_l1": C_GRID, "centroid": [0.0, 0.5], "rf": [None]}


class ImputeModel(Model):
    def __init__(self, medians: list[float], input_col: str, output_col: str):
        super().__init__()
        self.medians, self.input_col, self.output_col = medians, input_col, output_col

    def _transform(self, dataset: DataFrame) -> DataFrame:
        filled = F.zip_with(vector_to_array(self.input_col), F.lit(self.medians), lambda v, m: F.when(F.isnan(v), m).otherwise(v))
        return dataset.withColumn(self.output_col, array_to_vector(filled))


class MedianImpute(Estimator):
    """NaN entries become the median of the position's other entries (0 where there is none); one number per position is kept.

    With ``positions`` only these are fitted and filled; entries elsewhere stay as they are, NaN too.
    """

    def __init__(self, input_col: str = "features", output_col: str = "filled", positions: list[int] | None = None):
        super().__init__()
        self.input_col, self.output_col, self.positions = input_col, output_col, positions

    def _fit(self, dataset: DataFrame) -> ImputeModel:
        width = dataset.select(F.size(vector_to_array(self.input_col)).alias("n")).first()["n"]
        own, found = range(width) if self.positions is None else self.positions, {}
        if len(own):
            long = vector_long(dataset, self.input_col).where(~F.isnan("value") & F.col("feature_id").cast("int").isin(*own))
            found = {int(r["feature_id"]): r["m"] for r in exact_quantiles(long, ["feature_id"], "value", {"m": 0.5}).collect()}
        return ImputeModel([found.get(i, 0.0) if i in own else float("nan") for i in range(width)], self.input_col, self.output_col)


def open_positions(rows: DataFrame, column: str = "features") -> list[int]:
    """Positions that are NaN in at least one row."""
    each = F.posexplode(vector_to_array(column)).alias("i", "value")
    return sorted(r["i"] for r in rows.select(each).where(F.isnan("value")).groupBy("i").count().collect())


class CentroidModel(Model):
    def __init__(self, centres: list[tuple[float, list[float]]], spread: list[float], n_labels: int, features: str):
        super().__init__()
        self.centres, self.spread, self.n_labels, self.features = centres, spread, n_labels, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(c).alias("c")) for label, c in self.centres])
        x, spread = F.col("_x"), F.lit(self.spread)

        def gap(centre: Column) -> Column:
            d = F.zip_with(F.zip_with(x, centre, lambda v, m: v - m), spread, lambda v, s: v / s)
            return F.aggregate(d, F.lit(0.0), lambda a, v: a + v * v)
        out = dataset.withColumn("_x", vector_to_array(self.features)).withColumn("_d", F.transform(rows, lambda r: F.struct(gap(r["c"]).alias("d"), r["label"].alias("label"))))
        best = F.array_min("_d")
        weight = lambda label: F.coalesce(F.filter(F.transform("_d", lambda s: F.struct(s["label"].alias("label"), F.exp((best["d"] - s["d"]) / 2).alias("e"))),
                                                   lambda s: s["label"] == label)[0]["e"], F.lit(0.0))
        raw = F.transform(F.sequence(F.lit(0), F.lit(self.n_labels - 1)), lambda i: weight(i.cast("double")))
        p = F.transform(raw, lambda v: v / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))
        return out.withColumn("probability", array_to_vector(p)).withColumn("prediction", best["label"]).drop("_x", "_d")


class ShrunkenCentroid(Estimator):
    """Nearest centroid; with a threshold, class means move towards the overall mean by so many standard errors, and no further.

    Without one, distances are plain; with one, they are in units of the pooled within-class deviation.  What is kept are
    classes × panel features numbers.
    """

    def __init__(self, threshold: float, n_labels: int, features: str = "panel"):
        super().__init__()
        self.threshold, self.n_labels, self.features = threshold, n_labels, features

    def _fit(self, dataset: DataFrame) -> CentroidModel:
        v = F.col(self.features)
        per = dataset.groupBy("label").agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(v)).alias("m"), vector_to_array(Summarizer.variance(v)).alias("v")).orderBy("label").collect()
        n, width = sum(r["n"] for r in per), len(per[0]["m"])
        if not self.threshold:
            return CentroidModel([(r["label"], r["m"]) for r in per], [1.0] * width, self.n_labels, self.features)
        mean = [sum(r["n"] * r["m"][i] for r in per) / n for i in range(width)]
        pooled = [(sum((r["n"] - 1) * r["v"][i] for r in per) / max(1, n - len(per))) ** 0.5 for i in range(width)]
        middle = sorted(pooled)[width // 2]
        centres = []
        for r in per:
            unit = [(max(1 / r["n"] - 1 / n, 1e-12) ** 0.5) * (s + middle) or 1.0 for s in pooled]
            d = [(m - o) / u for m, o, u in zip(r["m"], mean, unit, strict=True)]
            short = [max(abs(x) - self.threshold, 0.0) * (1 if x > 0 else -1) for x in d]
            centres.append((r["label"], [o + u * x for o, u, x in zip(mean, unit, short, strict=True)]))
        return CentroidModel(centres, [s + middle or 1.0 for s in pooled], self.n_labels, self.features)


@dataclass
class Tuned:
    preprocess: PipelineModel
    head: Model
    choice: float | None
    inner: list[tuple[float | None, float | None]]

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.head.transform(self.preprocess.transform(rows))


def preprocessing(k: int | None, prefilter: int, open_at: list[int] | None = None) -> Pipeline:
    """impute → variance prefilter → scale → class-aware panel."""
    steps = [MedianImpute(positions=open_at), VarianceTopK(prefilter, "filled", "kept"), StandardScaler(inputCol="kept", outputCol="scaled", withMean=True)]
    return Pipeline(stages=[*steps, RoundRobinPanel(k)] if k else steps)


def _head(kind: str, choice: float | None, rows: int, n_labels: int, features: str):
    if kind == "centroid":
        return ShrunkenCentroid(choice, n_labels, features)
    return classifier(kind, rows, features, **({} if choice is None else {"inverse_penalty": choice}))


def inner_fold(seed: int, folds: int = INNER_FOLDS) -> Column:
    return F.floor(unit_hash(seed, "group_id") * folds).cast("int")


def fit_tuned(kind: str, train: DataFrame, n_labels: int, k: int | None = 20, prefilter: int = 5000, folds: int = INNER_FOLDS, seed: int = 3,
              open_at: list[int] | None = None) -> Tuned:
    """The best of the kind's grid by balanced accuracy over inner folds of whole groups, fitted again on all training rows.

    Each inner fold is preprocessed once, from its own training rows, for the whole grid.  Without a choice to make, or with too
    few groups for inner folds, the first of the grid is fitted.  ``open_at`` names the positions that can be NaN in the rows
    trained on and scored (by default all): a median that fills nothing is not sought.
    """
    features, grid = "panel" if k else "scaled", GRIDS[kind]
    rows = settle(train.withColumn("inner", inner_fold(seed, folds)))
    groups = rows.agg(F.count_distinct("group_id")).first()[0]
    scores: dict = {c: [] for c in grid}
    if len(grid) > 1 and groups > folds:
        for fold in range(folds):  # a handful by definition
            ahead, held = rows.where(F.col("inner") != fold), rows.where(F.col("inner") == fold)
            if not held.head(1) or not ahead.head(1):
                continue
            pre = preprocessing(k, prefilter, open_at).fit(ahead)
            a, b = settle(pre.transform(ahead).select("label", features)), settle(pre.transform(held).select("label", features))
            n = a.count()
            with ThreadPoolExecutor(len(grid)) as pool:
                for c, s in zip(grid, pool.map(lambda c: BalancedAccuracy().evaluate(_head(kind, c, n, n_labels, features).fit(a).transform(b)), grid), strict=True):  # noqa: B023
                    scores[c].append(s)
    mean = {c: sum(s) / len(s) for c, s in scores.items() if s}
    choice = max(mean, key=mean.get) if mean else grid[0]  # of equal ones the first of the grid
    pre = preprocessing(k, prefilter, open_at).fit(rows)
    ready = settle(pre.transform(rows).select("label", features))
    return Tuned(pre, _head(kind, choice, ready.count(), n_labels, features).fit(ready), choice, [(c, mean.get(c)) for c in grid])


def nested_cv(data: DataFrame, kind: str, classes: list[str], k: int | None = 20, prefilter: int = 5000, outer: int = 5, inner: int = INNER_FOLDS,
              seed: int = 7) -> tuple[DataFrame, list[tuple[int, float | None, float | None]]]:
    """(out-of-fold probabilities, what each outer fold chose with its inner score).

    A row of an outer test group takes part in no fit: the outer fold is cut off before anything is fitted.
    """
    folds = settle(grouped_kfold(data, "class", "group_id", outer, seed).select("group_id", "fold"))
    rows = settle(data.join(folds, "group_id"))
    open_at = open_positions(rows)
    out, chosen = None, []
    for fold in range(outer):
        test = rows.where(F.col("fold") == fold)
        if not test.head(1):
            continue
        model = fit_tuned(kind, rows.where(F.col("fold") != fold), len(classes), k, prefilter, inner, seed, open_at)
        p = settle(long_probabilities(model.transform(test), classes, "fold", "sample_id", "group_id", "class"))
        chosen.append((fold, model.choice, dict(model.inner)[model.choice]))
        out = p if out is None else out.unionByName(p)
    return out, chosen
