import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomset.llm.whitening import slabs_of, whiten


def slow(x, k):
    """Covariance by plain sums, eigenvectors by numpy, rows one by one."""
    n, mean = len(x), x.mean(axis=0)
    c = x - mean
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:k]
    return c @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize("block_entries, slab_blocks", [(1 << 18, 1 << 16), (40, 3)])
def test_equals_numpy(spark, block_entries, slab_blocks):
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(90, 5)) @ rng.normal(size=(5, 5)) * 64).astype(int) + 1_000_000
    x = np.concatenate([x, x[:6]])
    docs = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(x)], "vec_id long, x array<long>, whitened string").repartition(4)
    got = sorted(whiten(docs, "x", components=4, block_entries=block_entries, slab_blocks=slab_blocks).collect(), key=lambda r: r.vec_id)
    values, explained = slow(x.astype(float), 4)
    mine = np.array([r["whitened_"]["values"] for r in got])
    signs = np.sign((mine * values).sum(axis=0))
    assert len(got) == 96 and np.allclose(mine * signs, values, atol=1e-8)
    w = got[0]["whitened_"]
    assert np.allclose(w.explained, explained, rtol=1e-9) and w.identity_error < 1e-8 and w.n == 96
    sums = x.sum(axis=0)
    for r, v in zip(got, x, strict=True):
        assert int(r["whitened_"].deviation) == sum((96 * int(a) - int(s)) ** 2 for a, s in zip(v, sums, strict=True))


def test_awkward_vectors(spark):
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.25], [3.0, -1.0], [9.0, 1.0]]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [1.0], [1.0, 2.0, 3.0]]
    rows = [(None if i == 2 else i % 3, v, i) for i, v in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int").withColumn("a.b", F.lit("x")).withColumn("index", F.lit(1)).withColumn("part", F.lit(2))
    got = {r["cell"]: r for r in whiten(docs).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and got[0]["a.b"] == "x" and got[0]["index"] == 1
    assert got[1]["whitened"]["values"] == got[3]["whitened"]["values"] and len(got[0]["whitened"]["values"]) == 2
    assert whiten(docs.limit(0)).collect() == []
    same = whiten(spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], "id long, embedding array<double>")).collect()
    assert [(r["whitened"]["values"], r["whitened"].deviation) for r in same] == [([], 0.0)] * 2
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(5)], "id long, embedding array<double>")).collect()
    assert {len(r["whitened"]["values"]) for r in line} == {1} and line[0]["whitened"].identity_error < 1e-9


def test_slabs():
    got = slabs_of([(2, 5), (0, 10), (1, 1), (5, 40)], 4, 4)
    assert [(s.parts, s.rows) for s in got] == [([(0, 0), (1, 12)], 16), ([(2, 0)], 8), ([(5, 0)], 40)]
