"""Effect sizes, ranks, panels and the flagship question."""

from pyspark.sql import functions as F

from ..models.centroid import centroid_probs, centroids, fold_moments
from ..operators import conformal as C
from ..operators import effects as X
from ..session import settle
from .lenses import V_DIST, V_FACT, V_FIT, V_FOLDS, fact_v, roles_v
from .registry import query

OVR = """,
cs AS (SELECT class, feature_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM fact GROUP BY ALL),
ovr AS (SELECT a.class, a.feature_id, round(coalesce(abs(a.m - r.m) / (sqrt((a.v + r.v) / 2) + 1e-6), 0), 9) AS score FROM cs a
  JOIN (SELECT c.class, f.feature_id, avg(f.value) AS m, var_pop(f.value) AS v FROM (SELECT DISTINCT class FROM fact) c
        JOIN fact f ON f.class <> c.class GROUP BY ALL) r USING (class, feature_id))"""
OVR_FOLD = """,
fcls AS (SELECT fold, class, feature_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM fitrows GROUP BY ALL),
fovr AS (SELECT a.fold, a.class, a.feature_id, CASE WHEN a.n >= 2 AND r.n >= 2 THEN
    round(abs(a.m - r.m) / (sqrt((a.v + r.v) / 2) + 1e-6), 9) ELSE 0 END AS score FROM fcls a
  JOIN (SELECT c.fold, c.class, f.feature_id, count(*) AS n, avg(f.value) AS m, var_pop(f.value) AS v FROM (SELECT DISTINCT fold, class FROM fitrows) c
        JOIN fitrows f ON f.fold = c.fold AND f.class <> c.class GROUP BY ALL) r USING (fold, class, feature_id)),
frank AS (SELECT fold, feature_id, row_number() OVER (PARTITION BY fold, class ORDER BY score DESC, feature_id) AS rk,
    dense_rank() OVER (PARTITION BY fold ORDER BY class) - 1 AS ci, class FROM fovr),
fn AS (SELECT fold, max(ci) + 1 AS n_cls FROM frank GROUP BY fold)"""
PANEL = """,
pick(fold, step, chosen, feature_id, picked_for) AS (
  SELECT fold, 0, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR FROM fn
  UNION ALL
  SELECT fold, step + 1, list_append(chosen, feature_id), feature_id, class FROM (
    SELECT p.fold, p.step, p.chosen, r.feature_id, r.class, row_number() OVER (PARTITION BY p.fold ORDER BY r.rk) AS z
    FROM pick p JOIN fn USING (fold) JOIN frank r ON r.fold = p.fold AND r.ci = p.step % fn.n_cls
    WHERE p.step < 20 AND NOT list_contains(p.chosen, r.feature_id)) WHERE z = 1),
panel AS (SELECT fold, step AS pick, feature_id, picked_for FROM pick WHERE step > 0)"""
FOLD_PANEL = f"WITH RECURSIVE {V_FACT}{V_FOLDS}{V_FIT}{OVR_FOLD}{PANEL}"


def fold_panel(spark, sf, k=20):
    """(per-fold fit moments, per-fold panel of k features), from the fit individuals only."""
    fits = fold_moments(fact_v(spark, sf), roles_v(spark, sf)).transform(settle)
    return fits, X.round_robin(X.one_vs_rest(fits, ["fold"]), k, ["fold"])


@query("variance_topk", "A2", f"""WITH {V_FACT} SELECT feature_id, round(var_pop(value), 9) AS variance FROM fact GROUP BY ALL
ORDER BY variance DESC, feature_id LIMIT 20""")
def variance_topk(spark, sf):
    return X.top_variance(X.moments(fact_v(spark, sf), ["feature_id"]), 20)


@query("ovr_scores", "A3", f"WITH {V_FACT}{OVR} SELECT class, feature_id, round(score, 6) AS score FROM ovr")
def ovr_scores(spark, sf):
    s = X.one_vs_rest(X.moments(fact_v(spark, sf), ["class", "feature_id"]))
    return s.withColumn("score", F.round("score", 6))


@query("class_rank", "W1", f"""WITH {V_FACT}{OVR} SELECT * FROM (SELECT class, feature_id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY class ORDER BY score DESC, feature_id) AS rank FROM ovr) WHERE rank <= 10""")
def class_rank(spark, sf):
    s = X.one_vs_rest(X.moments(fact_v(spark, sf), ["class", "feature_id"]))
    return X.class_ranks(s, 10).withColumn("score", F.round("score", 6))


@query("roundrobin_panel", "W2", FOLD_PANEL + " SELECT * FROM panel")
def roundrobin_panel(spark, sf):
    return fold_panel(spark, sf)[1]


@query("panel_consistency", "A26", FOLD_PANEL + """
SELECT feature_id, count(DISTINCT fold) AS n_folds, count(DISTINCT fold) / 5.0 AS share, count(DISTINCT fold) = 5 AS in_all
FROM panel GROUP BY feature_id""")
def panel_consistency(spark, sf):
    return X.selection_consistency(fold_panel(spark, sf)[1], 5)


@query("panel_coverage", "R1 A3 W2 M3 R2 C1 W3 C3 A9", FOLD_PANEL + f""",
pcen AS (SELECT c.* FROM cen c SEMI JOIN panel USING (fold, feature_id)){V_DIST.replace('JOIN cen c', 'JOIN pcen c')},
sc AS (SELECT fold, round(1 - p, 9) AS score FROM probs WHERE role = 'cal' AND candidate = class),
rk AS (SELECT fold, a.alpha, score, row_number() OVER (PARTITION BY fold, a.alpha ORDER BY score) AS rn, count(*) OVER (PARTITION BY fold, a.alpha) AS n
       FROM sc, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) a(alpha)),
th AS (SELECT fold, alpha, coalesce(max(CASE WHEN rn = greatest(1, ceil((n + 1) * (1 - alpha) - 1e-9)) THEN score END), 'infinity'::DOUBLE) AS q FROM rk GROUP BY ALL),
st AS (SELECT fold, alpha, sample_id, class, max(CASE WHEN candidate = class THEN (q = 'infinity' OR p >= round(1 - q, 9))::INT END) AS covered,
         sum((q = 'infinity' OR p >= round(1 - q, 9))::INT) AS set_size FROM probs JOIN th USING (fold) WHERE role = 'test' GROUP BY ALL)
SELECT alpha, class, count(*) AS n, count(covered) AS n_seen, round(avg(covered), 6) AS coverage, round(avg(set_size), 6) AS mean_size,
  round(avg((set_size = 1)::INT), 6) AS singleton_share, round(avg((set_size = 0)::INT), 6) AS empty_share
FROM st GROUP BY GROUPING SETS ((alpha), (alpha, class))""")
def panel_coverage(spark, sf):
    fact, roles = fact_v(spark, sf), roles_v(spark, sf)
    fits = settle(fold_moments(fact, roles))
    panel = X.round_robin(X.one_vs_rest(fits, ["fold"]), 20, ["fold"])
    probs = settle(centroid_probs(fact, roles, settle(centroids(fits, ["fold"], panel))))
    q = C.thresholds(C.lac_scores(probs.where("role = 'cal'")), ["fold"], [0.05, 0.1, 0.2])
    sets = C.prediction_sets(probs.where("role = 'test'"), q, ["fold"], ["fold", "sample_id"])
    return C.evaluate_sets(sets, ["alpha"], per_class=True)
