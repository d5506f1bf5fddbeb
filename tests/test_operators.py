"""Small literal frames with known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomset.operators import audit as A
from fathomset.operators import certify as K
from fathomset.operators import claims as L
from fathomset.operators import conformal as C
from fathomset.operators import effects as X
from fathomset.operators import ledger as G
from fathomset.operators import matrices as Q
from fathomset.operators import splits as S


def test_two_chains_of_classes(spark):
    """Days link elm to oak and to fir, and ivy to yew; operators link other pairs; kits link none."""
    days = {"elm": ["mon", "tue"], "oak": ["mon"], "fir": ["tue"], "ivy": ["wed"], "yew": ["wed"]}
    operators = {"elm": "ada", "oak": "ada", "ivy": "ada", "fir": "bob", "yew": "bob"}
    rows = []
    for n, (c, own) in enumerate(days.items()):
        for i in range(4 + 2 * n):  # classes of unequal size
            rows += [(c, "day", own[i % len(own)]), (c, "operator", operators[c]), (c, "kit", f"kit-{c}"), (c, "room", "r")]
    cov = spark.createDataFrame(rows, "class string, variable string, level string")
    pairs = A.sharing_pairs(A.class_levels(cov))
    linked = lambda v: {tuple(r) for r in A.estimable_pairs(pairs, v).collect()}
    assert linked(["day"]) == {("elm", "oak"), ("elm", "fir"), ("ivy", "yew")}
    assert linked(["day", "operator", "room"]) == {("elm", "oak")} and linked(["kit"]) == set()
    t = A.nesting_table(cov).toPandas().set_index("variable")
    assert t["n_pairs_sharing"].to_dict() == {"day": 3, "operator": 4, "kit": 0, "room": 10} and set(t["n_pairs_total"]) == {10}
    assert t["max_levels_per_class"].to_dict() == {"day": 2, "operator": 1, "kit": 1, "room": 1}
    assert t.loc["day", "n_levels_shared"] == 3 and t.loc["day", "classes_in_one_level"] == 4
    assert t.loc["kit", "cramers_v"] == 1 and t.loc["room", "cramers_v"] == 0 and 0 < t.loc["day", "cramers_v"] < 1


def test_grouped_folds_and_roles(spark):
    rows = [(f"s{g}-{c}", f"g{g}", c) for g in range(30) for c in "ABCD"]
    smp = spark.createDataFrame(rows, "sample_id string, group_id string, class string")
    folds = S.grouped_kfold(smp, n_splits=5)
    assert folds.select("group_id").distinct().count() == 30 == folds.count()
    assert sorted(r["fold"] for r in folds.select("fold").distinct().collect()) == [0, 1, 2, 3, 4]
    roles = S.fold_roles(folds, 5, 0.3)
    S.assert_no_leak(roles)
    share = roles.where("role <> 'test'").groupBy("fold").agg(F.avg((F.col("role") == "cal").cast("int")).alias("s")).toPandas()["s"]
    assert ((share > 0.2) & (share < 0.4)).all()
    again = S.grouped_kfold(smp.repartition(7), n_splits=5)
    assert folds.exceptAll(again).count() == 0


def test_planted_markers_prefix_and_exclusion(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 40))
    for c in range(4):
        x[c * 15:(c + 1) * 15, c * 5:(c + 1) * 5] += 4
    rows = [(0, f"f{j:02d}", f"k{i // 15}", float(x[i, j])) for i in range(60) for j in range(40)]
    fact = spark.createDataFrame(rows, "run int, feature_id string, class string, value double")
    scores = X.one_vs_rest(X.moments(fact, ["run", "class", "feature_id"]), ["run"])
    picks = lambda k, ex=None: [r["feature_id"] for r in X.round_robin(scores, k, ["run"], ex).orderBy("pick").collect()]
    p15, p7 = picks(15), picks(7)
    assert p15[:7] == p7 and [int(f[1:]) // 5 for f in p15[:4]] == [0, 1, 2, 3]
    ex = spark.createDataFrame([("k0", p15[0])], "class string, feature_id string")
    assert picks(15, ex)[0] != p15[0]
    one = scores.where(f"class = 'k0' AND feature_id = '{p15[0]}'").first()["score"]
    j = int(p15[0][1:])
    want = abs(x[:15, j].mean() - x[15:, j].mean()) / (math.sqrt((x[:15, j].var() + x[15:, j].var()) / 2) + 1e-6)
    assert one == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("slices", [1, 4])
def test_quantile_ladder(spark, slices):
    sizes = [1, 5, 8, 9, 12, 18, 19, 22, 50, 200]
    rows = [(n, float(i + 1)) for n in sizes for i in range(n)]
    df = spark.createDataFrame(rows, "run int, score double").repartition(3)
    t = C.thresholds(df, ["run"], [0.1, 0.05], slices=slices).toPandas()
    q = {(r.run, r.alpha): r.q for r in t.itertuples()}
    for n in sizes:
        for a in (0.1, 0.05):
            k = math.ceil((n + 1) * (1 - a) - 1e-9)
            assert q[(n, a)] == (math.inf if k > n else k), (n, a)


def test_unseen_labels_are_dropped_and_counted(spark):
    rows = [(f"{c}{i}", c, k, 0.5) for c in "ABC" for i in range(10) for k in "AB"]
    probs = spark.createDataFrame(rows, "sample_id string, class string, candidate string, p double").withColumn("run", F.lit(1))
    assert C.lac_scores(probs).count() == 20
    smp = probs.select("run", "sample_id", "class").distinct()
    assert C.unseen_labels(smp, probs, ["run"]).count() == 10


def test_floored_contains_marginal_and_class_sets(spark):
    rng = np.random.default_rng(2)
    rows = [(1, "abc"[i % 3], float(rng.uniform() * (1 + i % 3))) for i in range(300)]
    scores = spark.createDataFrame(rows, "run int, class string, score double")
    cls = spark.createDataFrame([(1, c) for c in "abcd"], "run int, candidate string")
    m = C.thresholds(scores, ["run"], [0.1]).first()["q"]
    own = {r["candidate"]: r["q"] for r in C.class_thresholds(scores, ["run"], [0.1], cls).collect()}
    flo = {r["candidate"]: r["q"] for r in C.class_thresholds(scores, ["run"], [0.1], cls, floored=True).collect()}
    assert own["d"] == m and all(flo[c] == max(own[c], m) for c in "abcd")


def test_certificate(spark):
    e = spark.createDataFrame([("s", 5, 100, 30), ("s", 10, 100, 2), ("s", 20, 100, 0), ("s", 50, 100, 0)], "run string, k int, n long, n_err long")
    t = K.certify_table(e, ["run"], [(0.05, 0.05)], "exact").toPandas().set_index("k")
    assert t.loc[20, "ucb"] == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)  # closed form at zero errors
    assert K.certify(e, ["run"], [(0.05, 0.05)], "exact").first()["certified_k"] == 20


def test_class_restricted_feature_survives_stacking(spark):
    smp = spark.createDataFrame([(f"s{i}", "A" if i < 5 else "B") for i in range(10)], "sample_id string, class string")
    rows = [(f"s{i}", "common", 50.0) for i in range(10)] + [(f"s{i}", "only_a", 40.0) for i in range(5)]
    counts = spark.createDataFrame(rows, "sample_id string, feature_id string, value double")
    full = counts.join(smp, "sample_id")
    st = Q.stack_counts(full, smp, 10, 0.2).toPandas()
    assert set(st["feature_id"]) == {"common", "only_a"} and len(st) == 20
    assert (st[(st["class"] == "B") & (st["feature_id"] == "only_a")]["value"] == 0).all()
    assert Q.stacking_report(full, smp, 10, 0.2).first().asDict() == {"n_any": 2, "n_all": 1, "n_recovered": 1, "n_union": 2}


def test_claims_and_minimum_labelled(spark):
    names = spark.createDataFrame([("kidney", ["KIDNEY"]), ("brain", ["CORTEX", "HIPPOC"])], "name string, classes array<string>")
    s = spark.createDataFrame([("Kidneys",), ("brain tissue",), (" NA ",), ("moon",), (None,)], "label string")
    kinds = [r["claim_kind"] for r in L.map_claims(s, names).collect()]
    assert kinds == ["class", "superclass", "none", "not_in_reference", "none"]
    assert [L.min_labelled(a) for a in (0.05, 0.1, 0.2, 0.5)] == [19, 9, 4, 3]


def test_table_differences(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, float("inf"), None), (3, 5.0, "z")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-9, "x"), (2, float("inf"), None), (4, 5.0, "z")], "k int, v double, s string")
    d = {r["k"]: r["difference"] for r in G.table_differences(a, b, ["k"]).collect()}
    assert d == {3: "only in first", 4: "only in second"}


def test_moments_survive_a_large_offset(spark):
    x = np.random.default_rng(4).normal(size=300) + 1e7
    fact = spark.createDataFrame([(f"g{i % 10}", "f", float(v)) for i, v in enumerate(x)], "group_id string, feature_id string, value double")
    m = X.pool(X.moments(fact, ["group_id", "feature_id"]), ["feature_id"]).first()
    assert m["m2"] / m["n"] == pytest.approx(x.var(), rel=1e-6)


def test_profiles(spark):
    rows = [(n, i, float(v)) for n, vs in {"up": [1, 2, 3, 5], "down": [5, 4, 2, 1], "flat": [1, 1.1, 1, 1.1], "mixed": [1, 5, 0, 4]}.items() for i, v in enumerate(vs)]
    t = A.classify_profile(spark.createDataFrame(rows, "name string, w int, v double"), ["name"], "w", "v", 0.5)
    assert {r["name"]: r["shape"] for r in t.collect()} == {"up": "INCREASING", "down": "DECREASING", "flat": "FLAT", "mixed": "NON-MONOTONE"}


def test_drawn_subsets(spark):
    ids = spark.range(60).select(F.concat(F.lit("p"), "id").alias("pid"))
    got = {}
    for r in S.sampled_combinations(ids, "pid", 5, 300, 4).collect():
        got.setdefault(r["draw"], set()).add(r["pid"])
    assert len(got) == 300 and all(len(v) == 5 for v in got.values()) and len({frozenset(v) for v in got.values()}) == 300
    few = {}
    for r in S.sampled_combinations(ids.limit(6), "pid", 3, 15, 4).collect():  # of 20 in all
        few.setdefault(r["draw"], set()).add(r["pid"])
    assert len({frozenset(v) for v in few.values()}) == 15 and all(len(v) == 3 for v in few.values())
    every = S.sampled_combinations(ids.limit(5), "pid", 2, 99, 4).collect()
    assert len({r["draw"] for r in every}) == 10 and len(every) == 20


def test_pairs_of_a_gene_are_combined_where_they_are_made(spark):
    fact = spark.createDataFrame([(s, f, float(10 * s + f)) for s in range(5) for f in range(3)], "sample_id int, feature_id int, value double")
    mapping = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "c")], "feature_id int, gene string")
    got = Q.collapse(fact, mapping, ["sample_id"])
    assert {(r["sample_id"], r["gene"]): r["value"] for r in got.collect()} == {
        (s, g): 10.0 * s + m for s in range(5) for g, m in (("a", 0.5), ("b", 1.5), ("c", 2.0))}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "hashpartitioning" in line and "gene" in line]


def test_panel_calls_leave_a_missing_value_out(spark):
    from fathomset.models.centroid import panel_calls
    fact = spark.createDataFrame([("s", "g", "b", "f1", 5.0), ("s", "g", "b", "f2", None)], "sample_id string, group_id string, class string, feature_id string, value double")
    roles = spark.createDataFrame([(0, "test", "g")], "fold int, role string, group_id string")
    table = spark.createDataFrame([(0, c, f, m, 1.0) for c, m in (("a", 0.0), ("b", 5.0)) for f in ("f1", "f2")], "fold int, candidate string, feature_id string, mu double, sd double")
    panel = spark.createDataFrame([(0, "f1", 1), (0, "f2", 2)], "fold int, feature_id string, pick int")
    got = {r["k"]: r["call"] for r in panel_calls(fact, roles, table, panel, (1, 2)).collect()}
    assert got == {1: "b", 2: "b"}
