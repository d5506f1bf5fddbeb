"""Spark ML pieces: panel selection inside a pipeline, tuned fits by grouped folds, out-of-fold prediction."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import (Imputer, OneHotEncoder, StandardScaler, StringIndexer, UnivariateFeatureSelector,
                                VectorAssembler, VectorSlicer)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.effects import moments, one_vs_rest, round_robin, top_variance

# fixed values: grid of inverse penalties, default inverse penalty, inner folds
C_GRID, C_DEFAULT, INNER_FOLDS = [0.01, 0.1, 1.0], 0.1, 3


def vector_long(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """A vector column as long rows; the feature id is the zero-padded position."""
    return df.select(*keep, F.posexplode(vector_to_array(column)).alias("_i", "value")).withColumn(
        "feature_id", F.lpad(F.col("_i").cast("string"), 6, "0")).drop("_i")


class ColumnPick(Model):
    """Keeps fixed vector positions; what :class:`VarianceTopK` and :class:`RoundRobinPanel` fit."""

    def __init__(self, input_col: str, output_col: str, positions: list[int]):
        super().__init__()
        self.positions = positions
        self._slicer = VectorSlicer(inputCol=input_col, outputCol=output_col, indices=positions)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self._slicer.transform(dataset)


class VarianceTopK(Estimator):
    """The k positions of largest variance on the training rows."""

    def __init__(self, k: int, input_col: str = "features", output_col: str = "kept"):
        super().__init__()
        self.k, self.input_col, self.output_col = k, input_col, output_col

    def _fit(self, dataset: DataFrame) -> ColumnPick:
        top = top_variance(moments(vector_long(dataset, self.input_col), ["feature_id"]), self.k)
        return ColumnPick(self.input_col, self.output_col, sorted(int(r["feature_id"]) for r in top.collect()))


class RoundRobinPanel(Estimator):
    """The k positions dealt class by class from one-vs-rest effect sizes; only k ids reach the driver."""

    def __init__(self, k: int, input_col: str = "scaled", output_col: str = "panel", label_col: str = "class"):
        super().__init__()
        self.k, self.input_col, self.output_col, self.label_col = k, input_col, output_col, label_col

    def _fit(self, dataset: DataFrame) -> ColumnPick:
        long = vector_long(dataset, self.input_col, F.col(self.label_col).alias("class")).withColumn("run", F.lit(0))
        picks = round_robin(one_vs_rest(moments(long, ["run", "class", "feature_id"]), ["run"]), self.k, ["run"])
        return ColumnPick(self.input_col, self.output_col, sorted(int(r["feature_id"]) for r in picks.collect()))


class BalancedAccuracy(Evaluator):
    """Mean recall over the labels present."""

    def _evaluate(self, dataset: DataFrame) -> float:
        per = dataset.groupBy("label").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("r"))
        return per.agg(F.avg("r")).first()[0]

    def isLargerBetter(self) -> bool:
        return True


def classifier(kind: str, n_train: int, features: str = "panel", inverse_penalty: float = C_DEFAULT, seed: int = 1):
    if kind in ("logreg_l2", "logreg_l1"):
        return LogisticRegression(featuresCol=features, family="multinomial", standardization=False, maxIter=60, tol=1e-5,
                                  regParam=1 / (inverse_penalty * n_train), elasticNetParam=1.0 if kind == "logreg_l1" else 0.0)
    if kind == "rf":
        return RandomForestClassifier(featuresCol=features, numTrees=40, maxDepth=8, featureSubsetStrategy="sqrt", seed=seed)
    raise ValueError(f"unknown model kind {kind}")


def panel_pipeline(kind: str, k: int | None, prefilter: int, n_train: int, inverse_penalty: float = C_DEFAULT) -> Pipeline:
    """variance prefilter → scale → class-aware panel → classifier, every step fitted on the training rows."""
    steps = [VarianceTopK(prefilter, "features", "kept"), StandardScaler(inputCol="kept", outputCol="scaled", withMean=True)]
    if k:
        steps.append(RoundRobinPanel(k))
    return Pipeline(stages=[*steps, classifier(kind, n_train, "panel" if k else "scaled", inverse_penalty)])


def indexed(df: DataFrame, classes: list[str]) -> DataFrame:
    """Label index by sorted class name (the class list is the model's own, bounded, dimension)."""
    m = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    return df.withColumn("label", F.element_at(m, F.col("class")))


def long_probabilities(scored: DataFrame, classes: list[str], *keep: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    return scored.select(*keep, F.explode(F.arrays_zip(names.alias("candidate"), vector_to_array("probability").alias("p"))).alias("_z")).select(
        *keep, F.col("_z.candidate").alias("candidate"), F.round("_z.p", 9).alias("p"))


def numeric_preparation(numeric: list[str]) -> Pipeline:
    """Median-imputed, scaled numbers as the vector ``_numz``."""
    filled = [f"{c}_f" for c in numeric]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=numeric, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_num"),
                            StandardScaler(inputCol="_num", outputCol="_numz", withMean=True)])


def covariate_pipeline(numeric: list[str], categorical: list[str], n_train: int) -> Pipeline:
    """Median-imputed, scaled numbers and one-hot categories into a penalised logistic regression."""
    stages, inputs = [], []
    if numeric:
        stages += numeric_preparation(numeric).getStages()
        inputs.append("_numz")
    if categorical:
        idx, hot = [f"{c}_i" for c in categorical], [f"{c}_h" for c in categorical]
        stages += [StringIndexer(inputCols=categorical, outputCols=idx, handleInvalid="keep"),
                   OneHotEncoder(inputCols=idx, outputCols=hot)]
        inputs += hot
    stages.append(VectorAssembler(inputCols=inputs, outputCol="all_features"))
    return Pipeline(stages=[*stages, classifier("logreg_l2", n_train, "all_features")])


def ftest_selector(k: int, features: str = "features") -> UnivariateFeatureSelector:
    """The F-test alternative to the class-aware panel, kept for contrast."""
    return UnivariateFeatureSelector(featuresCol=features, outputCol="panel", labelCol="label", selectionMode="numTopFeatures").setFeatureType(
        "continuous").setLabelType("categorical").setSelectionThreshold(k)
