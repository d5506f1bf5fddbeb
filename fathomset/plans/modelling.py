"""Models as jobs."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.hashing import unit_hash
from ..models import arms as D
from ..models import centroid as N
from ..models import pipelines as P
from ..models import tuning as T
from ..models.components import components
from ..operators import audit as A
from ..operators import conformal as C
from ..operators import effects as X
from ..operators import matrices as Q
from ..operators import metrics as M
from ..operators import resample as R
from ..operators import splits as S
from ..session import checked_broadcast, settle
from .auditing import _two_layers
from .calibrating import ALPHAS, EVAL, IN_SET, MARG
from .claiming import LIN, _linear
from .harmonising import _qc
from .lenses import V_DIST, V_FACT, V_FIT, V_FOLDS, V_SAMPLES, events_e, fact_v, orders_o, roles_v, samples_v, u_sql
from .registry import query
from .selecting import FOLD_PANEL

CLASSES = [f"c{i}" for i in range(10)]
#: Labellings behind the null of a panel's accuracy and behind the 95th percentile of the best arm.
PANEL_PERMUTATIONS, ARM_PERMUTATIONS = 20, 200


# ---- closed-form models --------------------------------------------------------------------------------------------
def _panel_calls(k_values: str) -> str:
    return f""",
pk AS (SELECT k.k::INT AS k, p.fold, p.feature_id FROM panel p, (VALUES {k_values}) k(k) WHERE p.pick <= k.k),
kd AS (SELECT pk.k, r.fold, f.sample_id, f.class, c.candidate, round(sum(((f.value - c.mu) / c.sd) * ((f.value - c.mu) / c.sd)), 9) AS d2 FROM fact f JOIN roles r USING (group_id) JOIN pk ON pk.fold = r.fold AND pk.feature_id = f.feature_id
  JOIN cen c ON c.fold = r.fold AND c.feature_id = f.feature_id WHERE r.role = 'test' GROUP BY ALL),
kc AS (SELECT k, fold, sample_id, class, candidate AS call FROM (SELECT *, row_number() OVER (PARTITION BY k, fold, sample_id ORDER BY d2, candidate) AS r FROM kd) WHERE r = 1)"""


@query("panel_curve", "M5 M6 M4 W2", FOLD_PANEL + _panel_calls("(5), (10), (20)") + """
SELECT k, fold, count(*) AS n, round(avg((class = call)::INT), 6) AS accuracy FROM kc GROUP BY ALL""")
def panel_curve(spark, sf):
    """One ranking serves every panel size: a smaller panel is the prefix of the larger one."""
    fact, roles = fact_v(spark, sf), roles_v(spark, sf)
    fits = settle(N.fold_moments(fact, roles))
    panel = settle(X.round_robin(X.one_vs_rest(fits, ["fold"]), 20, ["fold"]))
    sizes = panel.withColumn("k", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20)))).where("pick <= k").select("k", "fold", "feature_id")
    table = settle(N.centroids(fits, ["fold"]).join(sizes, ["fold", "feature_id"]))
    who = roles.where("role = 'test'").select("fold", "group_id")
    near = fact.join(checked_broadcast(who), "group_id").join(checked_broadcast(table), ["fold", "feature_id"])
    d = (F.col("value") - F.col("mu")) / F.col("sd")
    dist = near.groupBy("k", "fold", "sample_id", "class", "candidate").agg(F.round(F.sum(d * d), 9).alias("d2"))
    call = dist.groupBy("k", "fold", "sample_id", "class").agg(F.min_by("candidate", F.struct("d2", "candidate")).alias("call"))
    return call.groupBy("k", "fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("class") == F.col("call")).cast("int")), 6).alias("accuracy"))


@query("pair_features", "M7", f"""WITH {V_SAMPLES}, p AS (SELECT class, a.i AS i, b.j AS j, (embedding[a.i + 1] > embedding[b.j + 1])::INT AS higher FROM smp, range(64) a(i), range(64) b(j) WHERE a.i < b.j AND b.j < len(embedding))
SELECT class, i::INT AS i, j::INT AS j, round(avg(higher), 6) AS share, count(*) AS n FROM p GROUP BY ALL""")
def pair_features(spark, sf):
    # k(k−1)/2 indicators inside one sample's panel of k features: bounded by the panel, no self-join
    at = lambda first: F.sequence(first, F.size("embedding") - 1)
    higher = lambda i, j: (F.get("embedding", i) > F.get("embedding", j)).cast("int")
    pairs = F.flatten(F.transform(F.slice(at(F.lit(0)), F.lit(1), F.size("embedding") - 1), lambda i: F.transform(
        at(i + 1), lambda j: F.struct(i.alias("i"), j.alias("j"), higher(i, j).alias("higher")))))
    return samples_v(spark, sf).select("class", F.explode(pairs).alias("p")).groupBy("class", F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(
        F.round(F.avg("p.higher"), 6).alias("share"), F.count(F.lit(1)).alias("n"))


@query("rank_representation", "M7 W5", f"""WITH {V_FACT} SELECT sample_id, feature_id, round((rank() OVER (PARTITION BY sample_id ORDER BY value) + (count(*) OVER (PARTITION BY sample_id, value) - 1) / 2.0) / count(*) OVER (PARTITION BY sample_id), 6) AS r FROM fact""")
def rank_representation(spark, sf):
    from ..functions.ranking import average_ranks
    r = average_ranks(fact_v(spark, sf), ["sample_id"], "value", slices=1)  # one sample's features per partition
    return r.select("sample_id", "feature_id", F.round(F.col("avg_rank") / F.col("n_total"), 6).alias("r"))


def _layer_dist(n: int, cond: str) -> str:
    return V_DIST.replace("dist AS", f"dist{n} AS").replace("FROM dist)", f"FROM dist{n})").replace("ex AS", f"ex{n} AS").replace(
        "FROM ex)", f"FROM ex{n})").replace("probs AS", f"probs{n} AS").replace("WHERE r.role IN", f"WHERE {cond} AND r.role IN")


@query("late_fusion", "M9", f"WITH {V_FACT}{V_FOLDS}{V_FIT}" + _layer_dist(1, "f.feature_id < 'f32'") + _layer_dist(2, "f.feature_id >= 'f32'") + """,
m AS (SELECT fold, sample_id, class, candidate, (a.p + b.p) / 2 AS p FROM probs1 a JOIN probs2 b USING (fold, role, sample_id, class, candidate) WHERE role = 'test'),
arms AS (SELECT 'single:a' AS arm, fold, sample_id, class, candidate, p FROM probs1 WHERE role = 'test' UNION ALL SELECT 'single:b', fold, sample_id, class, candidate, p FROM probs2 WHERE role = 'test' UNION ALL SELECT 'late', fold, sample_id, class, candidate, p FROM m)
SELECT arm, count(*) AS n, round(avg((class = candidate)::INT), 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY arm, fold, sample_id ORDER BY round(p, 9) DESC, candidate) AS r FROM arms) WHERE r = 1 GROUP BY arm""")
def late_fusion(spark, sf):
    arms = None
    for name, p in _layer_probs(spark, sf):
        one = p.select(F.lit(name).alias("arm"), "fold", "sample_id", "class", "candidate", "p")
        arms = one if arms is None else arms.unionByName(one)
    both = arms.groupBy("fold", "sample_id", "class", "candidate").agg(F.round(F.sum("p") / 2, 9).alias("p")).withColumn("arm", F.lit("late"))
    call = M.calls(arms.unionByName(both), ["arm", "fold", "sample_id", "class"])
    return call.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("class") == F.col("call")).cast("int")), 6).alias("accuracy"))


def _layer_probs(spark, sf):
    fact, roles = fact_v(spark, sf), roles_v(spark, sf)
    table = settle(N.centroids(settle(N.fold_moments(fact, roles)), ["fold"]))
    for name, cond in (("single:a", "feature_id < 'f32'"), ("single:b", "feature_id >= 'f32'")):
        yield name, settle(N.centroid_probs(fact.where(cond), roles, table.where(cond), ["test"]))


@query("early_fusion", "M9 J6", f"""WITH {V_FACT}{V_FOLDS}{V_FIT}, bd AS (SELECT r.fold, f.sample_id, f.class, c.candidate, round(sum(((f.value - c.mu) / c.sd) * ((f.value - c.mu) / c.sd) / CASE WHEN f.feature_id < 'f16' THEN 16 ELSE 48 END), 9) AS d2
  FROM fact f JOIN roles r USING (group_id) JOIN cen c ON c.fold = r.fold AND c.feature_id = f.feature_id WHERE r.role = 'test' GROUP BY ALL)
SELECT fold, count(*) AS n, round(avg((class = candidate)::INT), 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY fold, sample_id ORDER BY d2, candidate) AS r FROM bd) WHERE r = 1 GROUP BY fold""")
def early_fusion(spark, sf):
    """Two feature blocks side by side, each weighted by 1/√(block size)."""
    fact, roles = fact_v(spark, sf), roles_v(spark, sf)
    table = settle(N.centroids(settle(N.fold_moments(fact, roles)), ["fold"])).withColumn("assay", F.when(F.col("feature_id") < "f16", "a").otherwise("b"))
    size = table.groupBy("assay").agg(F.count_distinct("feature_id").alias("_n"))
    table = settle(table.join(size, "assay").withColumn("sd", F.col("sd") * F.sqrt("_n")).drop("_n", "assay"))
    who = roles.where("role = 'test'").select("fold", "group_id")
    d = (F.col("value") - F.col("mu")) / F.col("sd")
    dist = fact.join(checked_broadcast(who), "group_id").join(checked_broadcast(table), ["fold", "feature_id"]).groupBy(
        "fold", "sample_id", "class", "candidate").agg(F.round(F.sum(d * d), 9).alias("d2"))
    call = dist.groupBy("fold", "sample_id", "class").agg(F.min_by("candidate", F.struct("d2", "candidate")).alias("call"))
    return call.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("class") == F.col("call")).cast("int")), 6).alias("accuracy"))


@query("oof_scores", "M18", f"""WITH {V_FACT}{V_FOLDS}{V_FIT}, ab AS (SELECT fold, feature_id, max(mu) FILTER (WHERE candidate = 'c0') AS m0, max(mu) FILTER (WHERE candidate = 'c1') AS m1, max(sd) AS sd FROM cen GROUP BY ALL)
SELECT sample_id, f.class, r.fold, round(sum((value - (m0 + m1) / 2) / sd * (m1 - m0) / sd) / sqrt(sum((m1 - m0) / sd * (m1 - m0) / sd)), 6) AS projection, round(sqrt(sum((value - m0) / sd * (value - m0) / sd) / count(*)), 6) AS distance
FROM fact f JOIN roles r USING (group_id) JOIN ab ON ab.fold = r.fold AND ab.feature_id = f.feature_id WHERE r.role = 'test' AND f.class IN ('c0', 'c1') GROUP BY ALL""")
def oof_scores(spark, sf):
    """Held-out position along the axis between two class centroids, and distance to the first of them."""
    fact, roles = fact_v(spark, sf).where("class IN ('c0', 'c1')"), roles_v(spark, sf)
    cen = settle(N.centroids(settle(N.fold_moments(fact_v(spark, sf), roles)), ["fold"]))
    pick = lambda c: F.max(F.when(F.col("candidate") == c, F.col("mu")))
    ab = settle(cen.groupBy("fold", "feature_id").agg(pick("c0").alias("m0"), pick("c1").alias("m1"), F.max("sd").alias("sd")))
    x0, w = (F.col("value") - F.col("m0")) / F.col("sd"), (F.col("m1") - F.col("m0")) / F.col("sd")
    mid = (F.col("value") - (F.col("m0") + F.col("m1")) / 2) / F.col("sd")
    return (fact.join(checked_broadcast(roles.where("role = 'test'").select("fold", "group_id")), "group_id").join(checked_broadcast(ab), ["fold", "feature_id"])
            .groupBy("sample_id", "class", "fold").agg(F.round(F.sum(mid * w) / F.sqrt(F.sum(w * w)), 6).alias("projection"),
                                                       F.round(F.sqrt(F.sum(x0 * x0) / F.count(F.lit(1))), 6).alias("distance")))


def _scaled_sql(name: str, part: str) -> str:
    return f""",
z_{name} AS (SELECT f.sample_id, f.class, f.feature_id, CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END AS z FROM fx f JOIN smp USING (sample_id) WINDOW w AS (PARTITION BY {part}f.feature_id)),
l_{name} AS (SELECT sample_id, class, candidate, round(sum(z_{name}.z * w) + any_value(b), 9) AS logit FROM z_{name} JOIN co USING (feature_id) JOIN b USING (candidate) GROUP BY ALL)"""


@query("scaling_sensitivity", "C16 A5", f"WITH {V_SAMPLES}{LIN}" + _scaled_sql("whole", "") + _scaled_sql("batch", "smp.batch, ") + _scaled_sql("label", "f.class, ") + """,
u AS (SELECT 'whole set' AS scaling, * FROM l_whole UNION ALL SELECT 'each batch', * FROM l_batch UNION ALL SELECT 'each label', * FROM l_label)
SELECT scaling, count(*) AS n, round(avg((class = candidate)::INT), 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY scaling, sample_id ORDER BY logit DESC, candidate) AS r FROM u) WHERE r = 1 GROUP BY scaling""")
def scaling_sensitivity(spark, sf):
    """Accuracy of one stored model when features are scaled over the whole set, per batch, or per label."""
    _, coef, b, _ = _linear(spark, sf)
    f, out = fact_v(spark, sf), None
    for name, on in (("whole set", ["feature_id"]), ("each batch", ["batch", "feature_id"]), ("each label", ["class", "feature_id"])):
        z = Q.zscore(f, Q.feature_scale(f, on), on).withColumn("scaling", F.lit(name))
        out = z.select("scaling", "sample_id", "class", "feature_id", "value") if out is None else out.unionByName(
            z.select("scaling", "sample_id", "class", "feature_id", "value"))
    lg = N.linear_logits(out, coef, b, ["scaling", "sample_id", "class"]).withColumn("logit", F.round("logit", 9))
    call = lg.groupBy("scaling", "sample_id", "class").agg(F.min_by("candidate", F.struct(-F.col("logit"), F.col("candidate"))).alias("call"))
    return call.groupBy("scaling").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("class") == F.col("call")).cast("int")), 6).alias("accuracy"))


@query("composition_sensitivity", "C16 R10", f"WITH {V_SAMPLES}{LIN}" + f""",
g AS (SELECT d.draw::INT AS draw, s.sample_id, s.class, row_number() OVER (PARTITION BY d.draw ORDER BY {u_sql(95, 'd.draw', 's.sample_id')}, s.sample_id) AS rn, 8 + floor({u_sql('95n', 'd.draw')} * 60) AS size FROM smp s, range(12) d(draw) WHERE phase = 0),
k AS (SELECT * FROM g WHERE rn <= size), v AS (SELECT draw FROM k GROUP BY draw HAVING count(DISTINCT class) >= 3),
z2 AS (SELECT draw, sample_id, k.class, feature_id, CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END AS zz FROM k SEMI JOIN v USING (draw) JOIN fx USING (sample_id) WINDOW w AS (PARTITION BY draw, feature_id)),
l2 AS (SELECT draw, sample_id, z2.class, candidate, round(sum(zz * w) + any_value(b), 9) AS logit FROM z2 JOIN co USING (feature_id) JOIN b USING (candidate) GROUP BY ALL),
a AS (SELECT draw, count(*) AS n, avg((class = candidate)::INT) AS acc FROM (SELECT *, row_number() OVER (PARTITION BY draw, sample_id ORDER BY logit DESC, candidate) AS r FROM l2) WHERE r = 1 GROUP BY draw)
SELECT count(*) AS n_subsets, min(n) AS min_size, max(n) AS max_size, round(quantile_cont(acc, 0.05), 6) AS p05, round(quantile_cont(acc, 0.5), 6) AS p50, round(quantile_cont(acc, 0.95), 6) AS p95 FROM a""")
def composition_sensitivity(spark, sf):
    """Within-set scaling over random subsets of random size (at least 8 samples, at least 3 classes)."""
    from ..functions.ranking import dense_index
    _, coef, b, _ = _linear(spark, sf)
    s = samples_v(spark, sf).where("phase = 0").select("sample_id", "class", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("draw"))
    g = dense_index(s.withColumn("_u", unit_hash(95, "draw", "sample_id")), ["draw"], "_u", "sample_id")
    k = settle(g.where(F.col("idx") < 8 + F.floor(unit_hash("95n", "draw") * 60)).select("draw", "sample_id", "class"))
    ok = k.groupBy("draw").agg(F.count_distinct("class").alias("c")).where("c >= 3").select("draw")
    f = fact_v(spark, sf).select("sample_id", "feature_id", "value").join(k.join(ok, "draw", "left_semi"), "sample_id")
    z = Q.zscore(f, Q.feature_scale(f, ["draw", "feature_id"]), ["draw", "feature_id"])
    lg = N.linear_logits(z, coef, b, ["draw", "sample_id", "class"]).withColumn("logit", F.round("logit", 9))
    call = lg.groupBy("draw", "sample_id", "class").agg(F.min_by("candidate", F.struct(-F.col("logit"), F.col("candidate"))).alias("call"))
    a = call.groupBy("draw").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("class") == F.col("call")).cast("int")).alias("acc"))
    q = lambda p: F.round(F.percentile("acc", F.lit(p)), 6)  # noqa: E731  (one row per draw)
    return a.agg(F.count(F.lit(1)).alias("n_subsets"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"))


INVARIANT = V_FACT + f""",
g0 AS (SELECT group_id, row_number() OVER (ORDER BY {u_sql(33, 'group_id')}, group_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM smp WHERE phase IN (0, 1))),
roles AS (SELECT 0 AS fold, group_id, CASE WHEN rn <= greatest(1, round(n * 0.4)) THEN 'cal' ELSE 'fit' END AS role FROM g0 UNION ALL SELECT DISTINCT 0, group_id, 'test' FROM smp WHERE phase >= 2)"""


@query("invariance_coverage", "C18 C4 R3", f"WITH {INVARIANT}{V_FIT}{V_DIST}{MARG}" + f""",
st AS (SELECT role, alpha, sample_id, max(CASE WHEN candidate = class THEN {IN_SET}::INT END) AS covered, sum({IN_SET}::INT) AS set_size FROM probs JOIN th USING (fold) GROUP BY ALL) SELECT role, alpha, {EVAL} FROM st GROUP BY ALL""")
def invariance_coverage(spark, sf):
    """Fit and calibrate on one state (phases 0–1), then ask whether coverage holds in the other."""
    from ..functions.ranking import dense_index
    s = samples_v(spark, sf).select("group_id", "phase").distinct()
    early = dense_index(s.where("phase IN (0, 1)").select("group_id").withColumn("_u", unit_hash(33, "group_id")), [], "_u", "group_id")
    take = F.greatest(F.lit(1), F.round(F.col("n_total") * 0.4))
    roles = settle(early.select(F.lit(0).alias("fold"), "group_id", F.when(F.col("idx") < take, "cal").otherwise("fit").alias("role")).unionByName(
        s.where("phase >= 2").select(F.lit(0).alias("fold"), "group_id", F.lit("test").alias("role"))))
    fact = fact_v(spark, sf)
    probs = settle(N.centroid_probs(fact, roles, settle(N.centroids(settle(N.fold_moments(fact, roles)), ["fold"]))))
    q = C.thresholds(C.lac_scores(probs.where("role = 'cal'")), ["fold"], ALPHAS)
    return C.evaluate_sets(C.prediction_sets(probs, q, ["fold"], ["role", "sample_id"]), ["role", "alpha"])


def _accuracy(fact, roles, label):
    cen = settle(N.centroids(settle(N.fold_moments(fact, roles)), ["fold"]))
    call = M.calls(N.centroid_probs(fact, roles, cen, ["test"]), ["fold", "sample_id", "class"])
    return call.agg(F.round(F.avg((F.col("class") == F.col("call")).cast("double")), 6).alias("accuracy")).select(F.lit(label).alias("arm"), "accuracy")


@query("confound_diagnostics", "M12 A28 A13")
def confound_diagnostics(spark, sf):
    """Accuracy as fitted, from the missingness pattern alone, with training class means removed, and by chance."""
    fact, roles = fact_v(spark, sf), roles_v(spark, sf)
    missing = fact.withColumn("value", (F.abs("value") < 0.02).cast("double"))
    means = N.fold_moments(fact, roles).where("fold = 0").select("class", "feature_id", "mean")
    centred = fact.join(checked_broadcast(settle(means)), ["class", "feature_id"]).withColumn("value", F.col("value") - F.col("mean")).drop("mean")
    chance = samples_v(spark, sf).agg((1 / F.count_distinct("class")).alias("a")).select(F.lit("chance").alias("arm"), F.round("a", 6).alias("accuracy"))
    out = _accuracy(fact, roles, "as fitted").unionByName(_accuracy(missing, roles, "missingness only"))
    return out.unionByName(_accuracy(centred, roles.where("fold = 0"), "class means removed")).unionByName(chance)


@query("panel_permutation_null", "R17 R12")
def panel_permutation_null(spark, sf):
    """Accuracy of a 10-feature panel on permuted labels against the observed one (draw 0), same held-out fold."""
    s = samples_v(spark, sf).select("sample_id", "sex", "class")
    lab = R.permuted(s, ["sex"], ["class"], PANEL_PERMUTATIONS, 96).select(F.col("perm").alias("fold"), "sample_id", "class").unionByName(
        s.select(F.lit(0).alias("fold"), "sample_id", "class"))
    roles = roles_v(spark, sf).where("fold = 0").select("group_id", F.when(F.col("role") == "test", "test").otherwise("fit").alias("role"))
    f = fact_v(spark, sf).select("sample_id", "group_id", "feature_id", "value").join(settle(lab), "sample_id").join(checked_broadcast(settle(roles)), "group_id")
    fits = settle(X.moments(f.where("role = 'fit'"), ["fold", "class", "feature_id"]))
    cen = settle(N.centroids(fits, ["fold"], X.round_robin(X.one_vs_rest(fits, ["fold"]), 10, ["fold"])))
    d = (F.col("value") - F.col("mu")) / F.col("sd")
    dist = f.where("role = 'test'").join(checked_broadcast(cen), ["fold", "feature_id"]).groupBy("fold", "sample_id", "class", "candidate").agg(F.round(F.sum(d * d), 9).alias("d2"))
    call = dist.groupBy("fold", "sample_id", "class").agg(F.min_by("candidate", F.struct("d2", "candidate")).alias("call"))
    acc = settle(call.groupBy("fold").agg(F.avg((F.col("class") == F.col("call")).cast("double")).alias("acc")))
    obs = acc.where("fold = 0").select("acc").scalar()
    return acc.where("fold > 0").withColumn("o", obs).groupBy("o").agg(
        F.round(F.avg("acc"), 6).alias("null_mean"), F.round(R.permutation_p(acc, F.col("o"), "acc", False), 6).alias("p_value")).select(
        F.round("o", 6).alias("observed"), "null_mean", "p_value")


@query("representation_grid", "M14 M7 A17 M13")
def representation_grid(spark, sf):
    """Representation × selector: cost on held-out source individuals against gain on the other sex."""
    from ..functions.ranking import average_ranks
    s = samples_v(spark, sf).select("group_id", "sex").distinct()
    u = unit_hash(97, "group_id") < 0.3
    roles = settle(s.select(F.lit(0).alias("fold"), "group_id", F.when(F.col("sex") == "female", "test").when(u, "cal").otherwise("fit").alias("role")))
    fact = fact_v(spark, sf)
    ranked = average_ranks(fact, ["sample_id"], "value", slices=1).withColumn("value", F.col("avg_rank") / F.col("n_total")).drop("avg_rank", "n_total")
    qc_bad = settle(X.excluded_features(fact.where("sex = 'male'"), _qc(spark, sf), None, 0.3))
    out = None
    for rep, data in (("zscore", fact), ("rank", ranked)):
        fits = settle(N.fold_moments(data, roles))
        for sel, excluded in (("plain", None), ("qc-aware", qc_bad)):
            panel = X.round_robin(X.one_vs_rest(fits, ["fold"]), 15, ["fold"], excluded)
            p = N.centroid_probs(data, roles, settle(N.centroids(fits, ["fold"], panel)))
            m = M.calls(p, ["role", "sample_id", "class"]).groupBy("role").agg(F.avg((F.col("class") == F.col("call")).cast("double")).alias("a"))
            one = m.groupBy().pivot("role", ["cal", "test"]).agg(F.round(F.first("a"), 6)).select(
                F.lit(rep).alias("representation"), F.lit(sel).alias("selector"), F.col("cal").alias("source_accuracy"), F.col("test").alias("target_accuracy"))
            out = one if out is None else out.unionByName(one)
    return out


@query("duration_arms", "M15 M21 R13")
def duration_arms(spark, sf):
    """Two-group task (phase p against phase 0) for every duration and arm; the best arm against a permutation null."""
    from pyspark.sql.window import Window as W
    s = samples_v(spark, sf).where("size(embedding) > 0").withColumn("duration", F.explode(F.sequence(F.lit(1), F.lit(4)))).where("phase IN (0, duration)")
    s = settle(s.select("duration", "sample_id", "group_id", "sex", (F.col("phase") > 0).alias("treated"), F.transform("embedding", lambda v: v.cast("double")).alias("vec")))
    who = s.select("sample_id", "duration", "sex", "treated", F.col("duration").alias("task"), F.col("sample_id").alias("sample")).distinct()
    lab = R.permuted_flags(who, ["duration", "sex"], "treated", ARM_PERMUTATIONS, 98, carry=["task", "sample"]).unionByName(
        who.select(F.lit(0).alias("perm"), "task", "sample", "treated"))
    bits = D.label_bits(lab, ["task", "sample"], "treated")
    x = settle(s.join(bits, (F.col("duration") == F.col("task")) & (F.col("sample_id") == F.col("sample"))).select(
        "duration", "vec", "bits", (unit_hash(99, "group_id") < 0.4).alias("test")))
    w = D.weights(x.where("NOT test"), "duration", ARM_PERMUTATIONS + 1)
    sc = D.scores(x.where("test"), "duration", w, {"both": (0, None), "a": (0, 32), "b": (32, None)})
    a = settle(M.auroc(sc, ["perm", "duration", "arm"], "score", "treated"))
    null = a.where("perm > 0").groupBy("perm", "duration").agg(F.max("auroc").alias("best")).groupBy("duration").agg(F.percentile("best", F.lit(0.95)).alias("null_95"))
    best = a.where("perm = 0").withColumn("r", F.row_number().over(W.partitionBy("duration").orderBy(F.desc("auroc"), "arm")))  # one row per arm
    single = F.max(F.when(F.col("arm") != "both", F.col("auroc")))
    rule = a.where("perm = 0").groupBy("duration").agg((F.max(F.when(F.col("arm") == "both", F.col("auroc"))) > single).alias("fusion_beats_single"))
    return best.where("r = 1").join(null, "duration").join(rule, "duration").select(
        "duration", F.col("arm").alias("best_arm"), F.round("auroc", 6).alias("auroc"), F.round("null_95", 6).alias("null_95"),
        (F.col("auroc") > F.col("null_95")).alias("above_null"), "fusion_beats_single")


# ---- fitted by Spark ML --------------------------------------------------------------------------------------------
def _vectors(spark, sf):
    s = samples_v(spark, sf).withColumn("features", array_to_vector(F.transform("embedding", lambda v: v.cast("double"))))
    return P.indexed(s.drop("embedding"), CLASSES)


def _cross_validated(spark, sf, kind, k, n_folds=5, seed=7):
    folds = settle(S.grouped_kfold(samples_v(spark, sf), "class", "group_id", n_folds, seed).select("group_id", "fold"))
    data = settle(_vectors(spark, sf).join(folds, "group_id"))
    out = None
    for fold in range(n_folds):  # a handful of folds by definition; each fit is a distributed job
        train = data.where(F.col("fold") != fold)
        model = P.panel_pipeline(kind, k, 48, train.count()).fit(train)
        p = P.long_probabilities(model.transform(data.where(F.col("fold") == fold)), CLASSES, "fold", "sample_id", "group_id", "class")
        out = p if out is None else out.unionByName(p)
    return out


def _cv_metrics(p, kind):
    return M.classification_metrics(M.calls(p, ["fold", "sample_id", "class"]), ["fold"]).withColumn("model", F.lit(kind))


@query("logreg_cv", "M1 M4 A2 W2")
def logreg_cv(spark, sf):
    return _cv_metrics(_cross_validated(spark, sf, "logreg_l2", 20), "logreg_l2")


@query("rf_cv", "M1 M4")
def rf_cv(spark, sf):
    return _cv_metrics(_cross_validated(spark, sf, "rf", 20), "rf")


def _nested(spark, sf, kind):
    """Each outer fold's choice, its inner score and what it reaches on the fold itself."""
    p, chosen = T.nested_cv(_vectors(spark, sf), kind, CLASSES, 20, 48)
    own = spark.createDataFrame([(f, None if c is None else float(c), None if s is None else round(float(s), 6)) for f, c, s in chosen],
                                "fold int, choice double, inner_balanced_accuracy double")
    m = M.classification_metrics(M.calls(p, ["fold", "sample_id", "class"]), ["fold"])
    return m.join(own, "fold").withColumn("model", F.lit(kind))


@query("tuned_logreg", "M2 M1 M4")
def tuned_logreg(spark, sf):
    return _nested(spark, sf, "logreg_l2")


@query("tuned_lasso", "M2 M1 M4")
def tuned_lasso(spark, sf):
    return _nested(spark, sf, "logreg_l1")


@query("tuned_centroid", "M2 M1 M3")
def tuned_centroid(spark, sf):
    return _nested(spark, sf, "centroid")


@query("ftest_selector", "M5")
def ftest_selector(spark, sf):
    v = _vectors(spark, sf)
    model = P.ftest_selector(20).fit(v)
    return spark.createDataFrame([(int(i),) for i in sorted(model.selectedFeatures)], "position int")


@query("pca_variance", "M8")
def pca_variance(spark, sf):
    found = components(fact_v(spark, sf), 5)
    top = found.loadings.select("feature_id", F.posexplode("load").alias("j", "w")).groupBy("j").agg(F.max_by("feature_id", F.struct(F.abs("w"), "feature_id")).alias("top_feature"))
    share = spark.createDataFrame([(j, round(v, 6)) for j, v in enumerate(found.shares)], "j int, share double")
    return top.join(share, "j").select((F.col("j") + 1).alias("pc"), "share", "top_feature")


@query("projected_samples", "M8")
def projected_samples(spark, sf):
    """Components of four phases; the samples of the fifth are placed among them by the stored loadings."""
    fact = fact_v(spark, sf)
    placed = components(fact.where("phase < 4"), 2).project(fact.where("phase = 4"))
    return placed.select("sample_id", F.round(F.col("pcs")[0], 6).alias("pc1"), F.round(F.col("pcs")[1], 6).alias("pc2"))


@query("locate_covariate", "A33 M8 A12 A13")
def locate_covariate(spark, sf):
    """Per class: the component on which the batch has the largest share of variance after removing the design means."""
    scores = components(fact_v(spark, sf), 5).scores
    who = samples_v(spark, sf).select("sample_id", "class", "sex", "phase", "batch")
    x = settle(scores.join(who, "sample_id").select("sample_id", "class", "sex", "phase", "batch", F.posexplode("pcs").alias("pc", "value")).withColumn(
        "feature_id", F.col("pc").cast("string")))
    res = Q.residualise(x, ["class", "sex", "phase"])
    r = A.r2_categorical(res, ["class", "pc"], ["batch"]).withColumnRenamed("r2", "r2_batch_given_design")
    d = A.r2_categorical(x, ["class", "pc"], ["sex", "phase"]).select("class", "pc", F.col("r2").alias("r2_design"))
    j = r.join(d, ["class", "pc"])
    best = j.groupBy("class").agg(F.max_by(F.struct("pc", "r2_batch_given_design", "r2_design"), F.struct(F.col("r2_batch_given_design"), -F.col("pc"))).alias("b"))
    return best.select("class", (F.col("b.pc") + 1).alias("pc"), F.round("b.r2_batch_given_design", 6).alias("r2_batch_given_design"), F.round("b.r2_design", 6).alias("r2_design"))


@query("stacked_fusion", "M9")
def stacked_fusion(spark, sf):
    """A logistic regression on the out-of-fold class probabilities of both layers, tested on held-out folds."""
    wide = None
    for name, p in _layer_probs(spark, sf):
        tag = name[-1]
        one = p.groupBy("fold", "group_id", "sample_id", "class").pivot("candidate", CLASSES).agg(F.first("p")).select(
            "fold", "group_id", "sample_id", "class", *[F.col(c).alias(f"{tag}_{c}") for c in CLASSES])
        wide = one if wide is None else wide.join(one.drop("group_id", "class"), ["fold", "sample_id"])
    cols = [f"{t}_{c}" for t in "ab" for c in CLASSES]
    data = settle(P.indexed(VectorAssembler(inputCols=cols, outputCol="stack").transform(wide.na.fill(0.0, cols)), CLASSES))
    train, test = data.where("fold <> 0"), data.where("fold = 0")
    model = P.classifier("logreg_l2", train.count(), "stack", 1.0).fit(train)
    return model.transform(test).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("accuracy"))


def _grouped_auroc(data, pipeline_for, n_folds=5, seed=5):
    """Held-out AUROC with whole groups per fold."""
    d = settle(data.withColumn("fold", F.floor(unit_hash(seed, "group_id") * n_folds).cast("int")))
    ev, rows = BinaryClassificationEvaluator(labelCol="label"), []
    for fold in range(n_folds):
        train = d.where(F.col("fold") != fold)
        model = pipeline_for(train.count()).fit(train)
        rows.append((fold, round(float(ev.evaluate(model.transform(d.where(F.col("fold") == fold)))), 6)))
    return d.sparkSession.createDataFrame(rows, "fold int, auroc double")


@query("covariate_auroc", "M10 A4")
def covariate_auroc(spark, sf):
    """Can collection covariates alone tell urgent orders apart? Numeric and one-hot covariates, grouped folds."""
    o = orders_o(spark, sf).withColumn("label", F.col("class").isin("1-URGENT", "2-HIGH").cast("double"))
    return _grouped_auroc(o, lambda n: P.covariate_pipeline(["price", "balance"], ["status", "segment", "nation"], n))


def _grouped_aurocs(data, sets, n_folds=5, seed=5):
    """``_grouped_auroc`` of several sets of numeric columns on the same folds: each fold imputes and scales their columns once, for all sets."""
    columns = list(dict.fromkeys(c for own in sets.values() for c in own))
    d = settle(data.withColumn("fold", F.floor(unit_hash(seed, "group_id") * n_folds).cast("int")))
    sizes, rows = {r["fold"]: r["count"] for r in d.groupBy("fold").count().collect()}, []
    for fold in range(n_folds):
        n = sum(sizes.values()) - sizes.get(fold, 0)
        ready = settle(P.numeric_preparation(columns).fit(d.where(F.col("fold") != fold)).transform(d).select("label", "fold", "_numz"))

        def auroc(name):
            own = VectorSlicer(inputCol="_numz", outputCol="all_features", indices=[columns.index(c) for c in sets[name]]).transform(ready)  # noqa: B023
            model = P.classifier("logreg_l2", n, "all_features").fit(own.where(F.col("fold") != fold))  # noqa: B023
            found = BinaryClassificationEvaluator(labelCol="label").evaluate(model.transform(own.where(F.col("fold") == fold)))  # noqa: B023
            return fold, round(float(found), 6), name  # noqa: B023

        with ThreadPoolExecutor(len(sets)) as pool:
            rows += pool.map(auroc, sets)
    return d.sparkSession.createDataFrame(rows, "fold int, auroc double, features string")


@query("qc_only_baseline", "M11")
def qc_only_baseline(spark, sf):
    """Technical, composition and all QC numbers as the only features, on the same grouped folds."""
    e = events_e(spark, sf).withColumn("label", (F.col("class") == "purchase").cast("double")).withColumn(
        "hour", F.col("hour").cast("double")).withColumn("dom", F.col("dom").cast("double")).withColumn("k", F.col("k").cast("double"))
    return _grouped_aurocs(e, {"technical": ["hour", "dom"], "composition": ["value", "k"], "all": ["hour", "dom", "value", "k"]})


@query("discordance_model", "M19 A29")
def discordance_model(spark, sf):
    """Predict which (gene, individual) pairs disagree between layers from gene covariates: coefficients, drop-one loss, importance."""
    a, b = _two_layers(spark, sf)
    j = settle(a.withColumnRenamed("value", "x").join(b.withColumnRenamed("value", "y"), ["gene", "specimen_id"]))
    g = j.groupBy("gene").agg(F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"), F.stddev_samp("x").alias("sd_a"))
    names = ["mean_a", "mean_b", "sd_a", "x"]
    d = j.join(g, "gene").withColumn("label", (F.abs(F.col("x") - F.col("y")) > 30).cast("double"))
    d = settle(VectorAssembler(inputCols=names, outputCol="raw").transform(d))
    d = settle(StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(d).transform(d).withColumn("test", unit_hash(6, "gene") < 0.3))
    train, test, ev = d.where("NOT test"), d.where("test"), BinaryClassificationEvaluator(labelCol="label")
    lr = LogisticRegression(maxIter=30, regParam=1e-3)
    full = lr.fit(train)
    top = ev.evaluate(full.transform(test))
    forest = RandomForestClassifier(numTrees=20, maxDepth=5, seed=1).fit(train)
    rows = []
    for i, n in enumerate(names):
        keep = VectorAssembler(inputCols=[c for c in names if c != n], outputCol="less")
        less = LogisticRegression(featuresCol="less", maxIter=30, regParam=1e-3).fit(keep.transform(train))
        rows.append((n, round(abs(float(full.coefficients[i])), 6), round(float(top - ev.evaluate(less.transform(keep.transform(test)))), 6),
                     round(float(forest.featureImportances[i]), 6)))
    return spark.createDataFrame(rows, "covariate string, abs_coefficient double, drop_one_loss double, importance double")
