import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomset.models.components import components, triangle


def long(spark, x, samples=None):
    names = samples or [f"s{i:04d}" for i in range(len(x))]
    rows = [(names[i], f"f{j:05d}", None if np.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "sample_id string, feature_id string, value double")


def exact(x, k):
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0, ddof=1) > 0, x.std(axis=0, ddof=1), 1)
    u, s, v = np.linalg.svd(z, full_matrices=False)
    sign = np.array([1 if r[np.abs(r).argmax()] >= 0 else -1 for r in v[:k]])
    return u[:, :k] * s[:k] * sign, v[:k].T * sign, s[:k] ** 2 / (s ** 2).sum()


def test_exact_where_the_rank_covers_the_features(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(70, 12)) @ rng.normal(size=(12, 12))
    x[:, 5] = 3.0  # no variance
    x[3, 2] = np.nan
    filled = x.copy()
    filled[3, 2] = np.nanmedian(x[:, 2])
    got = components(long(spark, x), 4)
    scores, load, shares = exact(filled, 4)
    assert np.allclose([r.pcs for r in got.scores.orderBy("sample_id").collect()], scores, atol=1e-8)
    assert np.allclose([r.load for r in got.loadings.orderBy("feature_id").collect()], load, atol=1e-8)
    assert got.shares == pytest.approx(shares, rel=1e-9)
    # samples of the table itself fall on their scores
    again = got.project(long(spark, x[4:9]))
    assert np.allclose([r.pcs for r in again.orderBy("sample_id").collect()], scores[4:9], atol=1e-8)


def test_wide_table_and_new_samples(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3000)) * 3 + rng.normal(size=(60, 3000))
    got = components(long(spark, x[:50]), 3, rank=20)
    scores, load, shares = exact(x[:50], 3)
    assert np.allclose([r.pcs for r in got.scores.orderBy("sample_id").collect()], scores, rtol=1e-4, atol=1e-3)
    assert got.shares == pytest.approx(shares, rel=1e-6)
    new = np.array([r.pcs for r in got.project(long(spark, x[50:])).orderBy("sample_id").collect()])
    z = (x[50:] - x[:50].mean(axis=0)) / x[:50].std(axis=0, ddof=1)
    assert np.allclose(new, z @ load, rtol=1e-3, atol=1e-2)


def test_prefilter_and_rank_deficiency(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 2)) * [5, 4]
    x = np.concatenate([base, base * 2, rng.normal(size=(30, 6)) * 0.01], axis=1)
    got = components(long(spark, x), 5, prefilter=4)
    assert len(got.shares) == 2 and sum(got.shares) == pytest.approx(1.0)
    assert sorted(r.feature_id for r in got.loadings.collect()) == [f"f{j:05d}" for j in range(4)]


def test_triangle(spark):
    x = np.random.default_rng(4).normal(size=(200, 5))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "vec array<double>").repartition(7)
    r = triangle(df)
    assert np.allclose(r.T @ r, x.T @ x)


def test_medians_are_sought_only_where_a_value_is_missing(spark, monkeypatch):
    from fathomset.models import components as K
    rows = [(f"s{i}", f"f{j}", None if (i, j) in {(0, 1), (3, 1)} else float(i * (j + 1) % 7)) for i in range(8) for j in range(3)]
    fact = spark.createDataFrame(rows, "sample_id string, feature_id string, value double")
    sought, plain = [], K.exact_quantiles

    def spy(df, *rest, **more):
        sought.append({r[0] for r in df.select("feature_id").distinct().collect()})
        return plain(df, *rest, **more)
    monkeypatch.setattr(K, "exact_quantiles", spy)
    z, scale = K.standardised(fact)
    assert sought == [{"f1"}]
    assert z.count() == 24 and z.where("z IS NULL").count() == 0
    assert {r["feature_id"] for r in scale.collect()} == {"f0", "f1", "f2"}
