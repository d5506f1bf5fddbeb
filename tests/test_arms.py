import numpy as np
import pytest

from fathomset.models import arms as D


def test_weights_and_scores_of_many_labellings(spark):
    """Means, weights and scores against numpy; 70 labellings need two longs; missing values and a feature without values."""
    rng = np.random.default_rng(3)
    n, width, perms = 60, 6, 70
    x = rng.normal(size=(n, width))
    x[:, 5] = np.nan
    x[4, 1] = np.nan
    flag = rng.random((perms, n)) < 0.5
    task = np.where(np.arange(n) < 40, 1, 2)
    lists = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    labels = spark.createDataFrame([(p, int(task[i]), i, bool(flag[p, i])) for p in range(perms) for i in range(n)], "perm int, task int, sample int, treated boolean")
    bits = D.label_bits(labels, ["task", "sample"], "treated")
    vectors = spark.createDataFrame([(int(task[i]), i, lists[i]) for i in range(n)], "task int, sample int, vec array<double>")
    rows = vectors.join(bits, ["task", "sample"]).repartition(5)
    table = D.weights(rows, "task", perms)
    got = {(r.task, r.perm): np.array(r.w) for r in table.collect()}
    assert len(got) == 2 * perms
    want = {}
    for k in (1, 2):
        for p in range(perms):
            one, rest = x[(task == k) & flag[p], :5], x[(task == k) & ~flag[p], :5]
            want[k, p] = np.nanmean(one, axis=0) - np.nanmean(rest, axis=0)
            assert np.allclose(got[k, p][:5], want[k, p]) and np.isnan(got[k, p][5])
    found = D.scores(rows, "task", table, {"both": (0, None), "b": (3, None), "none": (5, None)}).collect()
    assert len(found) == n * perms * 3
    assert all(r.score is None for r in found if r.arm == "none")
    for arm, a in (("both", 0), ("b", 3)):
        for k, p in ((1, 0), (2, 69)):
            mine = sorted((r.score, r.treated) for r in found if (r.arm, r.task, r.perm) == (arm, k, p))
            s = (np.nan_to_num(x[task == k][:, a:5]) * want[k, p][a:]).sum(axis=1)
            assert [v for v, _ in mine] == pytest.approx(sorted(s), abs=1e-8)
            assert sum(t for _, t in mine) == flag[p, task == k].sum()
