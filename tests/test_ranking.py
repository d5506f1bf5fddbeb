"""The sliced (skew-safe) order statistics equal brute force, also with a third of the rows tied."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomset.functions import ranking as R
from fathomset.functions.hashing import unit_hash
from fathomset.operators.matrices import mark_duplicates


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    g = np.where(rng.uniform(size=900) < 0.5, "hot", rng.choice(["a", "b"], 900))
    v = np.where(rng.uniform(size=900) < 0.33, 7.0, np.round(rng.normal(size=900) * 5, 1))
    pdf = pd.DataFrame({"id": [f"r{i:04d}" for i in range(900)], "g": g, "v": v})
    return pdf, spark.createDataFrame(pdf).repartition(5, "id")


@pytest.mark.parametrize("slices", [1, 200])
def test_average_ranks(skewed, slices):
    pdf, df = skewed
    got = R.average_ranks(df, ["g"], "v", slices=slices).toPandas().set_index("id")["avg_rank"].sort_index()
    want = pdf.assign(r=pdf.groupby("g")["v"].rank()).set_index("id")["r"].sort_index()
    assert np.allclose(got.to_numpy(), want.to_numpy())


@pytest.mark.parametrize("slices", [1, 200])
@pytest.mark.parametrize("keys", [["g"], []])
def test_exact_quantiles(skewed, slices, keys):
    pdf, df = skewed
    got = R.exact_quantiles(df, keys, "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9}, slices=slices).toPandas()
    for _, row in got.iterrows():
        x = pdf[pdf["g"] == row["g"]]["v"] if keys else pdf["v"]
        assert np.allclose([row["q1"], row["q2"], row["q9"]], np.quantile(x, [0.25, 0.5, 0.9]))


@pytest.mark.parametrize("slices", [1, 200])
def test_dense_index_is_a_permutation(skewed, slices):
    _, df = skewed
    t = R.dense_index(df.withColumn("u", unit_hash(1, "id")), ["g"], "u", "id", slices=slices).toPandas()
    for _, part in t.groupby("g"):
        assert sorted(part["idx"]) == list(range(len(part))) and set(part["n_total"]) == {len(part)}
        assert part.sort_values(["u", "id"])["idx"].tolist() == list(range(len(part)))


@pytest.mark.parametrize("slices", [1, 200])
def test_benjamini_hochberg(spark, slices):
    p = np.round(np.random.default_rng(5).beta(0.4, 2, 120), 3)
    df = spark.createDataFrame(pd.DataFrame({"i": range(120), "p": p}))
    got = R.benjamini_hochberg(df, [], "p", slices=slices).toPandas().sort_values("i")["p_adj"].to_numpy()
    o = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[o] * 120 / np.arange(1, 121))[::-1])[::-1]
    want = np.empty(120)
    want[o] = np.minimum(q, 1)
    assert np.allclose(got, want)


def test_hash_ignores_partitioning(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("k"))
    a = {r["k"]: r["u"] for r in df.withColumn("u", unit_hash(9, "k")).collect()}
    b = {r["k"]: r["u"] for r in df.repartition(7).withColumn("u", unit_hash(9, "k")).collect()}
    assert a == b and 0.4 < np.mean(list(a.values())) < 0.6


@pytest.mark.parametrize("slices", [1, 8, 200])
def test_null_keys_keep_their_rows(spark, slices):
    rows = [(None if i % 5 == 0 else "k" if i % 2 else "m", None if i % 7 == 0 else float(i % 11) - 5, i, f"f{i % 3}") for i in range(50)]
    df = spark.createDataFrame(rows, "g string, v double, o long, f string").repartition(6)
    pdf = pd.DataFrame(rows, columns=["g", "v", "o", "f"])
    known = pdf.dropna(subset=["v"])
    ranks = R.value_ranks(df, ["g"], "v", slices=slices).toPandas()
    assert ranks["n_eq"].sum() == len(known)
    got = R.average_ranks(df, ["g"], "v", slices=slices).toPandas().set_index("o")["avg_rank"].sort_index()
    want = known.assign(r=known.groupby("g", dropna=False)["v"].rank()).set_index("o")["r"].sort_index()
    assert np.allclose(got.to_numpy(), want.to_numpy()) and len(got) == len(known)
    assert R.exact_quantiles(df, ["g"], "v", {"m": 0.5}, slices=slices).count() == 3
    t = R.dense_index(df.withColumn("u", unit_hash(1, "o")), ["g"], "u", "o", slices=slices).toPandas()
    assert len(t) == 50 and all(sorted(x["idx"]) == list(range(len(x))) for _, x in t.groupby("g", dropna=False))


def test_no_duplicate_is_lost(spark):
    rows = [(None if i % 4 == 0 else "a", "x", None if i == 9 else i) for i in range(50)]
    df = spark.createDataFrame(rows, "file string, feature_id string, ordinal long")
    for table in (df, df.withColumn("ordinal", F.struct(F.lit(0).alias("block"), "ordinal"))):
        names = [(r["file"], r["feature_id"]) for r in mark_duplicates(table, "feature_id", "ordinal", ["file"]).collect()]
        assert len(names) == len(set(names)) == 50
        assert (None, "x__dup12") in names and ("a", "x__dup36") in names


def test_slices_never_decrease(spark):
    v = np.sort(np.concatenate([np.random.default_rng(1).normal(size=300) ** 9, [0.0, -0.0, 5e-324, 2.0, np.nextafter(2, 1), np.nextafter(2, 3), np.inf, -np.inf, 1e308], 2.0 ** np.arange(-60, 60)]))
    for slices in (1, 7, 4096):
        got = spark.createDataFrame(pd.DataFrame({"v": v})).select(R.value_slice(F.col("v"), slices).alias("s"), "v").toPandas().sort_values("v")["s"]
        assert (np.diff(got.to_numpy()) >= 0).all()
    tiny = spark.createDataFrame(pd.DataFrame({"p": np.arange(1, 1001) * 1e-9})).select(R.value_slice(F.col("p")).alias("s"))
    assert tiny.distinct().count() > 900


def test_one_key_with_most_rows(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 10 == 0, F.lit("b")).otherwise("a").alias("g"), (F.col("id") * 37 % 991).cast("double").alias("v"), "id")
    pdf = df.toPandas()
    got = R.average_ranks(df, ["g"], "v").toPandas().set_index("id")["avg_rank"].sort_index()
    assert np.allclose(got.to_numpy(), pdf.groupby("g")["v"].rank().to_numpy())


def test_whole_table_order(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("a"), F.concat(F.lit("s"), F.col("id") * 7 % 500).alias("b")).repartition(6)
    got = R.in_order(df, ["a", "b"], "at").toPandas().sort_values(["a", "b"])["at"].tolist()
    assert got == list(range(500))
