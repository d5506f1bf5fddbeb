import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fathomset.models import tuning as T
from fathomset.models.pipelines import RoundRobinPanel, VarianceTopK, indexed
from fathomset.operators.splits import grouped_kfold

CLASSES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    rows = []
    for i in range(180):
        c, g = i % 3, f"g{i % 18}"
        x = [rng.gauss(2.0 * (j % 3 == c), 1.0) for j in range(8)] + [rng.gauss(0, 0.01) for _ in range(4)]
        if rng.random() < 0.2:
            x[rng.randrange(8)] = float("nan")
        rows.append((f"s{i}", g, CLASSES[c], x))
    df = spark.createDataFrame(rows, "sample_id string, group_id string, class string, x array<double>")
    return indexed(df.withColumn("features", array_to_vector("x")).drop("x"), CLASSES)


@pytest.mark.parametrize("kind", ["logreg_l1", "centroid"])
def test_no_test_row_reaches_a_fit(data, monkeypatch, kind):
    """Every frame given to any fit is recorded with its groups; none may hold a group of the fold that is tested."""
    seen = []
    watched = [(T.MedianImpute, "_fit"), (VarianceTopK, "_fit"), (RoundRobinPanel, "_fit"), (T.ShrunkenCentroid, "_fit"), (T.StandardScaler, "fit"), (LogisticRegression, "fit")]
    for owner, name in watched:
        plain = getattr(owner, name)

        def spy(self, rows, *rest, plain=plain, owner=owner):
            seen.append((owner.__name__, {r["group_id"] for r in rows.select("group_id").distinct().collect()} if "group_id" in rows.columns else None))
            return plain(self, rows, *rest)
        monkeypatch.setattr(owner, name, spy)
    test = {r["group_id"] for r in grouped_kfold(data, "class", "group_id", 5, 7).where("fold = 0").collect()}
    model = T.fit_tuned(kind, data.where(~F.col("group_id").isin(test)), 3, k=6, prefilter=8)
    fitted = [(n, g) for n, g in seen if g is not None]
    assert {"MedianImpute", "VarianceTopK", "RoundRobinPanel", "StandardScaler"} <= {n for n, _ in fitted}
    assert all(g and not g & test for _, g in fitted)
    # three inner fits of each step on parts of the training groups, then one on all of them
    sizes = [len(g) for n, g in fitted if n == "MedianImpute"]
    assert len(sizes) == 4 and sizes[-1] == 18 - len(test) and sum(sizes[:3]) == 2 * sizes[-1]
    assert len(model.inner) == len(T.GRIDS[kind]) and all(s is not None for _, s in model.inner)
    assert dict(model.inner)[model.choice] == max(s for _, s in model.inner)


def test_nested_scores(data):
    p, chosen = T.nested_cv(data, "logreg_l2", CLASSES, k=6, prefilter=8, outer=2)
    assert p.count() == 180 * 3 and [c[0] for c in chosen] == [0, 1]
    sums = p.groupBy("sample_id").agg(F.sum("p").alias("s"), F.max_by("candidate", "p").alias("call"), F.first("class").alias("class"))
    assert sums.where("abs(s - 1) > 1e-6").count() == 0
    assert sums.where("call = class").count() > 0.8 * 180


def test_impute_and_centroids(spark):
    df = spark.createDataFrame([(0.0, [1.0, float("nan")]), (0.0, [3.0, float("nan")]), (1.0, [float("nan"), float("nan")]), (1.0, [10.0, float("nan")])], "label double, x array<double>")
    df = df.withColumn("features", array_to_vector("x"))
    model = T.MedianImpute().fit(df)
    assert model.medians == [3.0, 0.0]
    assert [list(r.filled) for r in model.transform(df).collect()] == [[1.0, 0.0], [3.0, 0.0], [3.0, 0.0], [10.0, 0.0]]
    x = np.array([[0.0, 1.0], [1.0, 0.0], [4.0, 0.2], [5.0, 0.9]])
    rows = spark.createDataFrame([(float(i // 2), v.tolist()) for i, v in enumerate(x)], "label double, x array<double>").withColumn("panel", array_to_vector("x"))
    plain = T.ShrunkenCentroid(0.0, 2).fit(rows)
    assert np.allclose([c for _, c in plain.centres], [x[:2].mean(axis=0), x[2:].mean(axis=0)])
    shrunk = T.ShrunkenCentroid(0.5, 2).fit(rows)
    pooled = np.sqrt((x[:2].var(axis=0, ddof=1) + x[2:].var(axis=0, ddof=1)) / 2)
    unit = np.sqrt(1 / 2 - 1 / 4) * (pooled + sorted(pooled)[1])
    d = (x[:2].mean(axis=0) - x.mean(axis=0)) / unit
    assert np.allclose(shrunk.centres[0][1], x.mean(axis=0) + unit * np.sign(d) * np.maximum(np.abs(d) - 0.5, 0))
    assert [r.prediction for r in shrunk.transform(rows).collect()] == [0.0, 0.0, 1.0, 1.0]


def test_medians_are_sought_only_where_a_row_is_open(data, monkeypatch):
    full = T.open_positions(data)
    assert full and set(full) <= set(range(8))
    sought, plain = [], T.exact_quantiles

    def spy(long, *rest, **more):
        sought.append({int(r[0]) for r in long.select("feature_id").distinct().collect()})
        return plain(long, *rest, **more)
    monkeypatch.setattr(T, "exact_quantiles", spy)
    every, some = T.MedianImpute().fit(data), T.MedianImpute(positions=full).fit(data)
    assert sought == [set(range(12)), set(full)]
    rows = lambda m: sorted((r["sample_id"], tuple(r["filled"].toArray().tolist())) for r in m.transform(data).collect())
    assert rows(every) == rows(some)
    T.MedianImpute(positions=[]).fit(data)
    assert len(sought) == 2
