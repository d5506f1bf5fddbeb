"""Conformal thresholds, sets, coverage, shift and recalibration."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..models.centroid import centroid_probs, centroids, top_two
from ..operators import certify as K
from ..operators import conformal as C
from ..operators import metrics as M
from ..operators import splits as S
from ..operators.effects import moments, pool
from ..session import checked_broadcast, settle
from .lenses import V_FACT, V_PROBS, V_SAMPLES, fact_v, probs_v, samples_v, u_sql
from .registry import query

ALPHAS = [0.05, 0.1, 0.2]
A_SQL = "(VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) a(alpha)"
K_SQL = "greatest(1, ceil((n + 1) * (1 - alpha) - 1e-9))"
INF = "'infinity'::DOUBLE"
IN_SET = "(q = 'infinity' OR p >= round(1 - q, 9))"
EVAL = """count(*) AS n, count(covered) AS n_seen, round(avg(covered), 6) AS coverage, round(avg(set_size), 6) AS mean_size,
  round(avg((set_size = 1)::INT), 6) AS singleton_share, round(avg((set_size = 0)::INT), 6) AS empty_share"""
BASE = f"WITH {V_PROBS}"
CAL = """,
sc AS (SELECT fold, sample_id, group_id, class, round(1 - p, 9) AS score FROM probs WHERE role = 'cal' AND candidate = class)"""


def th_sql(name: str, src: str, keys: str) -> str:
    """Threshold per keys and α from a score table."""
    return f""",
{name} AS (SELECT {keys}, alpha, count(*)::BIGINT AS n_cal, coalesce(max(CASE WHEN rn = {K_SQL} THEN score END), {INF}) AS q FROM (
  SELECT {keys}, alpha, score, row_number() OVER (PARTITION BY {keys}, alpha ORDER BY score) AS rn,
         count(*) OVER (PARTITION BY {keys}, alpha) AS n FROM {src}, {A_SQL}) GROUP BY {keys}, alpha)"""


MARG = CAL + th_sql("th", "sc", "fold")
MOND = MARG + th_sql("own", "sc", "fold, class") + """,
grid AS (SELECT DISTINCT fold, candidate FROM probs),
mth AS (SELECT g.fold, t.alpha, g.candidate, coalesce(o.q, t.q) AS q, coalesce(o.n_cal, 0)::BIGINT AS n_cal, t.q AS qm FROM grid g JOIN th t USING (fold)
        LEFT JOIN own o ON o.fold = g.fold AND o.alpha = t.alpha AND o.class = g.candidate)"""


def sets_sql(q: str, on: str) -> str:
    return f""",
st AS (SELECT fold, alpha, sample_id, group_id, class, list_sort(list(candidate) FILTER (WHERE {IN_SET})) AS members,
         max(CASE WHEN candidate = class THEN {IN_SET}::INT END) AS covered, sum({IN_SET}::INT) AS set_size
       FROM probs JOIN {q} USING ({on}) WHERE role = 'test' GROUP BY ALL)"""


def scored(spark, sf):
    """Probabilities of lens V plus the calibration scores of each fold."""
    probs = settle(probs_v(spark, sf))
    return probs, C.lac_scores(probs.where("role = 'cal'")).select("fold", "sample_id", "group_id", "class", "score")


def test_sets(probs, q, on=("fold",), member=None):
    return C.prediction_sets(probs.where("role = 'test'"), q, list(on), ["fold", "sample_id", "group_id"], member)


@query("centroid_probs", "M3 M16", BASE + """
SELECT fold, sample_id, candidate, round(p, 6) AS p, round(d2, 6) AS d2 FROM probs WHERE role = 'test'""")
def centroid_probs_q(spark, sf):
    return probs_v(spark, sf).where("role = 'test'").select(
        "fold", "sample_id", "candidate", F.round("p", 6).alias("p"), F.round("d2", 6).alias("d2"))


@query("lac_quantile", "C1 W3", BASE + MARG + " SELECT fold, alpha, n_cal, q FROM th")
def lac_quantile(spark, sf):
    return C.thresholds(scored(spark, sf)[1], ["fold"], ALPHAS)


@query("lac_quantile_infinite", "W3", BASE + CAL + f"""
SELECT fold, 0.001::DOUBLE AS alpha, count(*)::BIGINT AS n_cal, CASE WHEN ceil((count(*) + 1) * 0.999 - 1e-9) > count(*) THEN {INF} ELSE max(score) END AS q
FROM sc GROUP BY fold""")
def lac_quantile_infinite(spark, sf):
    return C.thresholds(scored(spark, sf)[1], ["fold"], [0.001])


@query("mondrian_quantile", "W4", BASE + MOND + " SELECT fold, alpha, candidate, n_cal, q FROM mth")
def mondrian_quantile(spark, sf):
    probs, scores = scored(spark, sf)
    return C.class_thresholds(scores, ["fold"], ALPHAS, probs)


@query("floored_quantile", "W4", BASE + MOND + " SELECT fold, alpha, candidate, n_cal, greatest(q, qm) AS q FROM mth")
def floored_quantile(spark, sf):
    probs, scores = scored(spark, sf)
    return C.class_thresholds(scores, ["fold"], ALPHAS, probs, floored=True)


APS = f""",
bf AS (SELECT *, round(sum(p) OVER (PARTITION BY fold, sample_id ORDER BY p DESC, candidate ROWS UNBOUNDED PRECEDING) - p, 9) AS before FROM probs),
asc_ AS (SELECT fold, sample_id, class, round(before + {u_sql(17, 'fold', 'sample_id')} * p, 9) AS score FROM bf WHERE role = 'cal' AND candidate = class)"""


@query("aps_scores", "C2 W9", BASE + APS + " SELECT fold, sample_id, class, round(score, 6) AS score FROM asc_")
def aps_scores(spark, sf):
    s = C.aps_scores(probs_v(spark, sf).where("role = 'cal'"), ["fold", "sample_id"])
    return s.select("fold", "sample_id", "class", F.round("score", 6).alias("score"))


@query("aps_coverage", "C2 C3 C4 W9", BASE + APS + th_sql("th", "asc_", "fold") + f""",
st AS (SELECT fold, alpha, sample_id, class, max(CASE WHEN candidate = class THEN (before <= q)::INT END) AS covered,
       sum((before <= q)::INT) AS set_size FROM bf JOIN th USING (fold) WHERE role = 'test' GROUP BY ALL)
SELECT alpha, {EVAL} FROM st GROUP BY alpha""")
def aps_coverage(spark, sf):
    probs = settle(probs_v(spark, sf))
    q = C.thresholds(C.aps_scores(probs.where("role = 'cal'"), ["fold", "sample_id"]), ["fold"], ALPHAS)
    before = C.mass_before(probs.where("role = 'test'"), ["fold", "sample_id"])
    return C.evaluate_sets(test_sets(before, q, member=F.col("before") <= F.col("q")), ["alpha"])


@query("prediction_sets", "C3", BASE + MARG + sets_sql("th", "fold") + """
SELECT fold, alpha, sample_id, class, coalesce(array_to_string(members, ';'), '') AS members, set_size::INT AS set_size FROM st""")
def prediction_sets(spark, sf):
    probs, scores = scored(spark, sf)
    return test_sets(probs, C.thresholds(scores, ["fold"], ALPHAS)).select(
        "fold", "alpha", "sample_id", "class", F.concat_ws(";", "members").alias("members"), "set_size")


@query("coverage_by_class", "A9 C4", BASE + MARG + sets_sql("th", "fold") + f"""
SELECT alpha, class, {EVAL} FROM st GROUP BY GROUPING SETS ((alpha), (alpha, class))""")
def coverage_by_class(spark, sf):
    probs, scores = scored(spark, sf)
    return C.evaluate_sets(test_sets(probs, C.thresholds(scores, ["fold"], ALPHAS)), ["alpha"], per_class=True)


@query("coverage_mondrian", "C3 C4", BASE + MOND + sets_sql("mth", "fold, candidate") + f"""
SELECT alpha, class, {EVAL} FROM st GROUP BY GROUPING SETS ((alpha), (alpha, class))""")
def coverage_mondrian(spark, sf):
    probs, scores = scored(spark, sf)
    q = C.class_thresholds(scores, ["fold"], ALPHAS, probs).drop("n_cal")
    return C.evaluate_sets(test_sets(probs, q, ["fold", "candidate"]), ["alpha"], per_class=True)


@query("calibration_grid", "C4 R5", BASE + MOND + f""",
one AS (SELECT fold, group_id, arg_min(sample_id, u) AS sample_id FROM (
   SELECT fold, group_id, sample_id, {u_sql(13, 'fold', 'sample_id')} AS u FROM sc) GROUP BY ALL),
sc1 AS (SELECT sc.* FROM sc JOIN one USING (fold, group_id, sample_id)){th_sql('th1', 'sc1', 'fold')},
cfg AS (SELECT 'marginal' AS variant, 'pooled' AS calibration, fold, alpha, candidate, th.q FROM th JOIN grid USING (fold)
  UNION ALL SELECT 'mondrian', 'pooled', fold, alpha, candidate, q FROM mth
  UNION ALL SELECT 'floored', 'pooled', fold, alpha, candidate, greatest(q, qm) FROM mth
  UNION ALL SELECT 'marginal', 'one_per_group', fold, alpha, candidate, th1.q FROM th1 JOIN grid USING (fold)),
st AS (SELECT variant, calibration, fold, alpha, sample_id, class, max(CASE WHEN candidate = class THEN {IN_SET}::INT END) AS covered,
       sum({IN_SET}::INT) AS set_size FROM probs JOIN cfg USING (fold, candidate) WHERE role = 'test' GROUP BY ALL)
SELECT variant, calibration, alpha, {EVAL} FROM st GROUP BY ALL""")
def calibration_grid(spark, sf):
    probs, scores = scored(spark, sf)
    classes = probs.select("fold", "candidate").distinct()
    marginal = C.thresholds(scores, ["fold"], ALPHAS).join(classes, "fold")
    single = (scores.withColumn("_u", S.unit_hash(13, "fold", "sample_id")).groupBy("fold", "group_id")
              .agg(F.min_by("score", "_u").alias("score")))
    tables = [("marginal", "pooled", marginal),
              ("mondrian", "pooled", C.class_thresholds(scores, ["fold"], ALPHAS, probs)),
              ("floored", "pooled", C.class_thresholds(scores, ["fold"], ALPHAS, probs, floored=True)),
              ("marginal", "one_per_group", C.thresholds(single, ["fold"], ALPHAS).join(classes, "fold"))]
    cfg = None
    for variant, mode, q in tables:
        part = q.select(F.lit(variant).alias("variant"), F.lit(mode).alias("calibration"), "fold", "alpha", "candidate", "q")
        cfg = part if cfg is None else cfg.unionByName(part)
    sets = C.prediction_sets(probs.where("role = 'test'"), cfg, ["fold", "candidate"],
                             ["variant", "calibration", "fold", "sample_id"])
    return C.evaluate_sets(sets, ["variant", "calibration", "alpha"])


# ---- metrics on the same predictions ---------------------------------------------------------------------------
CALLS = """,
calls AS (SELECT fold, sample_id, group_id, class, max(p) AS call_p, max(CASE WHEN candidate = class THEN p END) AS p_true,
   arg_min(candidate, rk) AS call, arg_min(CASE WHEN rk = 2 THEN candidate END, rk) AS runner_up FROM (
   SELECT *, row_number() OVER (PARTITION BY fold, sample_id ORDER BY p DESC, candidate) AS rk FROM probs WHERE role = 'test') GROUP BY ALL)"""


@query("metrics_by_fold", "A6 A8", BASE + CALLS + """,
pc AS (SELECT fold, c.class, sum((calls.class = c.class)::INT) AS support, sum((call = c.class)::INT) AS called,
   sum((calls.class = c.class AND call = c.class)::INT) AS hit FROM calls, (SELECT DISTINCT class FROM smp) c GROUP BY ALL),
m AS (SELECT fold, avg(hit / support) FILTER (WHERE support > 0) AS bal, avg(2.0 * hit / (support + called)) FILTER (WHERE support + called > 0) AS f1 FROM pc GROUP BY fold)
SELECT fold, count(*) AS n, round(avg((call = calls.class)::INT), 6) AS accuracy, round(any_value(bal), 6) AS balanced_accuracy,
  round(any_value(f1), 6) AS macro_f1, round(-avg(ln(greatest(p_true, 1e-9))), 6) AS log_loss FROM calls JOIN m USING (fold) GROUP BY fold""")
def metrics_by_fold(spark, sf):
    probs = probs_v(spark, sf).where("role = 'test'").transform(settle)
    return M.classification_metrics(M.calls(probs, ["fold", "sample_id", "group_id", "class"]), ["fold"])


@query("fold_summary", "A8", BASE + CALLS + """,
f AS (SELECT fold, avg((call = class)::INT) AS acc FROM calls GROUP BY fold)
SELECT 'centroid' AS model, 'accuracy' AS metric, round(avg(round(acc, 6)), 6) AS mean, round(stddev_samp(round(acc, 6)), 6) AS sd, count(*) AS n_folds FROM f""")
def fold_summary(spark, sf):
    probs = probs_v(spark, sf).where("role = 'test'").transform(settle)
    m = M.classification_metrics(M.calls(probs, ["fold", "sample_id", "group_id", "class"]), ["fold"])
    return M.fold_summary(m.withColumn("model", F.lit("centroid")), ["model"], ["accuracy"])


@query("confusion", "A7", BASE + CALLS + """
SELECT class, call, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY class), 6) AS share FROM calls GROUP BY class, call""")
def confusion(spark, sf):
    probs = probs_v(spark, sf).where("role = 'test'").transform(settle)
    return M.confusion(M.calls(probs, ["fold", "sample_id", "group_id", "class"]))


@query("soft_confusion", "A7", BASE + " SELECT class, candidate, round(avg(p), 6) AS mean_p FROM probs WHERE role = 'test' GROUP BY ALL")
def soft_confusion(spark, sf):
    return probs_v(spark, sf).where("role = 'test'").groupBy("class", "candidate").agg(F.round(F.avg("p"), 6).alias("mean_p"))


@query("confusable_pairs", "A7", BASE + CALLS + """
SELECT least(class, call) AS class_a, greatest(class, call) AS class_b, count(*) AS n FROM calls WHERE class <> call GROUP BY ALL
ORDER BY n DESC, class_a, class_b LIMIT 10""")
def confusable_pairs(spark, sf):
    probs = probs_v(spark, sf).where("role = 'test'").transform(settle)
    return M.confusable_pairs(M.calls(probs, ["fold", "sample_id", "group_id", "class"]), 10)


@query("label_accuracy", "A27", BASE + CALLS + """,
w AS (SELECT class, call, count(*) AS n, row_number() OVER (PARTITION BY class ORDER BY count(*) DESC, call) AS r FROM calls GROUP BY class, call),
x AS (SELECT class, call AS main_wrong, row_number() OVER (PARTITION BY class ORDER BY count(*) DESC, call) AS r FROM calls WHERE class <> call GROUP BY class, call)
SELECT c.class, count(*) AS n, round(avg((c.call = c.class)::INT), 6) AS accuracy, any_value(w.call) AS most_frequent,
  round(max(w.n) / count(*), 6) AS most_frequent_share, any_value(x.main_wrong) AS main_wrong
FROM calls c JOIN w ON w.class = c.class AND w.r = 1 LEFT JOIN x ON x.class = c.class AND x.r = 1 GROUP BY c.class""")
def label_accuracy(spark, sf):
    probs = probs_v(spark, sf).where("role = 'test'").transform(settle)
    return M.label_accuracy(M.calls(probs, ["fold", "sample_id", "group_id", "class"]))


@query("error_list", "A35", BASE + CALLS + """
SELECT class, call, sex, phase, count(*) AS n, count(DISTINCT calls.group_id) AS n_groups FROM calls JOIN smp USING (sample_id, class)
WHERE call <> class GROUP BY ALL""")
def error_list(spark, sf):
    probs = probs_v(spark, sf).where("role = 'test'").transform(settle)
    calls = M.calls(probs, ["fold", "sample_id", "group_id", "class"])
    return M.error_list(calls, samples_v(spark, sf).select("sample_id", "sex", "phase"), ["sex", "phase"])


@query("binary_auroc", "A6 A21", f"""WITH {V_PROBS},
b AS (SELECT fold, p, (class = 'c0') AS pos FROM probs WHERE role = 'test' AND candidate = 'c0'),
r AS (SELECT fold, pos, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS ar FROM b)
SELECT fold, round((sum(ar) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0)
   / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 6) AS auroc FROM r GROUP BY fold""")
def binary_auroc(spark, sf):
    b = probs_v(spark, sf).where("role = 'test' AND candidate = 'c0'").select(
        "fold", "p", (F.col("class") == "c0").alias("positive"))
    return M.auroc(b, ["fold"], "p", "positive").select("fold", F.round("auroc", 6).alias("auroc"))


# ---- shift, recalibration, transfer -----------------------------------------------------------------------------
SHIFT = V_FACT + f""",
tr AS (SELECT DISTINCT group_id, row_number() OVER (ORDER BY u, group_id) AS rn, count(*) OVER () AS n FROM (
   SELECT DISTINCT group_id, {u_sql(31, 'group_id')} AS u FROM smp WHERE sex = 'male')),
roles AS (SELECT 0 AS fold, group_id, CASE WHEN rn <= greatest(1, round(n * 0.3)) THEN 'cal' ELSE 'fit' END AS role FROM tr
  UNION ALL SELECT DISTINCT 0, group_id, 'test' FROM smp WHERE sex = 'female')"""
SEEN = "SELECT fold, class, feature_id, value FROM fact JOIN roles USING (group_id) WHERE role = 'fit' AND class <> 'c9'"


def _shift_probs(spark, sf):
    """Fit on one sex without class c9, calibrate on its held-out individuals, test on the other sex."""
    s = samples_v(spark, sf)
    male = s.where("sex = 'male'").select("group_id").distinct().withColumn("_u", S.unit_hash(31, "group_id"))
    idx = S.dense_index(male, [], "_u", "group_id")
    roles = idx.select(F.lit(0).alias("fold"), "group_id", F.when(
        F.col("idx") < F.greatest(F.lit(1), F.round(F.col("n_total") * 0.3)), "cal").otherwise("fit").alias("role"))
    roles = roles.unionByName(s.where("sex = 'female'").select(
        F.lit(0).alias("fold"), "group_id", F.lit("test").alias("role")).distinct())
    roles = settle(roles)
    fact = fact_v(spark, sf)
    fits = pool(moments(fact.where("class <> 'c9'"), ["group_id", "class", "feature_id"])
                .join(roles.where("role = 'fit'"), "group_id"), ["fold", "class", "feature_id"])
    return settle(centroid_probs(fact, roles, settle(centroids(settle(fits), ["fold"]))))


from .lenses import V_DIST, V_FIT  # noqa: E402

SHIFT_PROBS = SHIFT + V_FIT.replace("WHERE r.role = 'fit'", "WHERE r.role = 'fit' AND f.class <> 'c9'") + V_DIST


@query("shift_coverage", "C5 C8 U3", f"WITH {SHIFT_PROBS}{MARG}" + f""",
st AS (SELECT role, alpha, sample_id, class, max(CASE WHEN candidate = class THEN {IN_SET}::INT END) AS covered, sum({IN_SET}::INT) AS set_size
       FROM probs JOIN th USING (fold) GROUP BY ALL)
SELECT role, alpha, {EVAL} FROM st GROUP BY role, alpha""")
def shift_coverage(spark, sf):
    probs = _shift_probs(spark, sf)
    q = C.thresholds(C.lac_scores(probs.where("role = 'cal'")), ["fold"], ALPHAS)
    return C.evaluate_sets(C.prediction_sets(probs, q, ["fold"], ["role", "sample_id"]), ["role", "alpha"])


@query("calibration_dropped", "C1 C5", f"WITH {SHIFT_PROBS}" + """
SELECT role, count(DISTINCT sample_id) FILTER (WHERE class IN (SELECT candidate FROM probs)) AS n_scored,
  count(DISTINCT sample_id) FILTER (WHERE class NOT IN (SELECT candidate FROM probs)) AS n_dropped FROM probs GROUP BY role""")
def calibration_dropped(spark, sf):
    probs = _shift_probs(spark, sf)
    per = probs.groupBy("role", "sample_id").agg(F.max((F.col("candidate") == F.col("class")).cast("int")).alias("seen"))
    return per.groupBy("role").agg(F.sum("seen").alias("n_scored"), F.sum(1 - F.col("seen")).alias("n_dropped"))


DRAWS = f""",
ids AS (SELECT DISTINCT group_id FROM probs WHERE role = 'test'),
dr AS (SELECT nr.n_recal::INT AS n_recal, d.draw::INT AS draw, group_id, row_number() OVER (PARTITION BY nr.n_recal, d.draw ORDER BY {u_sql(41, 'nr.n_recal', 'd.draw', 'group_id')}, group_id) AS rn
  FROM ids, (VALUES (1), (3), (5)) nr(n_recal), range(10) d(draw)),
ch AS (SELECT n_recal, draw, group_id, rn <= n_recal AS chosen FROM dr),
rs AS (SELECT n_recal, draw, round(1 - p, 9) AS score FROM probs JOIN ch USING (group_id) WHERE role = 'test' AND candidate = class AND chosen),
rq AS (SELECT n_recal, draw, max(n) AS n_scores, coalesce(max(CASE WHEN rn = greatest(1, ceil((n + 1) * 0.9 - 1e-9)) THEN score END), {INF}) AS q_t FROM (
  SELECT *, row_number() OVER (PARTITION BY n_recal, draw ORDER BY score) AS rn, count(*) OVER (PARTITION BY n_recal, draw) AS n FROM rs) GROUP BY ALL)"""
DRAW_COV = f""",
st AS (SELECT n_recal, draw, sample_id, max(CASE WHEN candidate = class THEN (q_t = 'infinity' OR p >= round(1 - q_t, 9))::INT END) AS cov_t,
   max(CASE WHEN candidate = class THEN {IN_SET}::INT END) AS cov_s, sum((q_t = 'infinity' OR p >= round(1 - q_t, 9))::INT) AS size_t, sum({IN_SET}::INT) AS size_s
  FROM probs JOIN ch USING (group_id) JOIN rq USING (n_recal, draw) JOIN th USING (fold) WHERE role = 'test' AND NOT chosen AND alpha = 0.1 AND class <> 'c9' GROUP BY ALL),
pd AS (SELECT n_recal, draw, avg(cov_t) AS cov_t, avg(cov_s) AS cov_s, avg((size_t = 0)::INT) AS empty_t, avg((size_s = 0)::INT) AS empty_s, avg(size_t) AS size_t FROM st GROUP BY ALL)
SELECT n_recal, count(*) AS draws, round(avg(cov_t), 6) AS coverage_recalibrated, round(avg(cov_s), 6) AS coverage_source, round(avg(empty_t), 6) AS empty_recalibrated,
  round(avg(empty_s), 6) AS empty_source, round(avg(size_t), 6) AS set_size_recalibrated FROM pd GROUP BY n_recal"""


def _draws(probs, n_recals=(1, 3, 5), n_draws=10, seed=41):
    """(n_recal, draw, group, chosen): hash-ranked draws of target individuals, without replacement."""
    ids = probs.where("role = 'test'").select("group_id").distinct()
    d = (ids.withColumn("n_recal", F.explode(F.array(*[F.lit(n) for n in n_recals])))
         .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
         .withColumn("_u", S.unit_hash(seed, "n_recal", "draw", "group_id")))
    return S.dense_index(d, ["n_recal", "draw"], "_u", "group_id").select(
        "n_recal", "draw", "group_id", (F.col("idx") < F.col("n_recal")).alias("chosen"))


def _recalibrated(probs, draws):
    pick = draws.where("chosen").select("n_recal", "draw", "group_id")
    scores = C.lac_scores(probs.where("role = 'test'")).join(pick, "group_id")
    return C.thresholds(scores, ["n_recal", "draw"], [0.1]).select(
        "n_recal", "draw", F.col("q").alias("q_t"), F.col("n_cal").alias("n_scores"))


@query("recalibration_thresholds", "C9 R10 S20", f"WITH {SHIFT_PROBS}{DRAWS}" + """
SELECT n_recal, draw, n_scores, q_t, q_t < 'infinity' AS finite FROM rq""")
def recalibration_thresholds(spark, sf):
    probs = _shift_probs(spark, sf)
    return _recalibrated(probs, _draws(probs)).withColumn("finite", F.col("q_t") < F.lit(float("inf")))


@query("recalibration_draws", "C9 C11", f"WITH {SHIFT_PROBS}{MARG}{DRAWS}{DRAW_COV}")
def recalibration_draws(spark, sf):
    probs = _shift_probs(spark, sf)
    q_s = C.thresholds(C.lac_scores(probs.where("role = 'cal'")), ["fold"], [0.1]).select("fold", "q")
    draws = settle(_draws(probs))
    # one row per sample (its probabilities as an array) meets the draws, not one per sample and class
    own = F.max(F.when(F.col("candidate") == F.col("class"), F.col("p")))
    rows = probs.where("role = 'test' AND class <> 'c9'").groupBy("fold", "sample_id", "group_id").agg(
        F.collect_list("p").alias("ps"), own.alias("p_true"))
    per = (rows.join(draws.where("NOT chosen").drop("chosen"), "group_id")
           .join(checked_broadcast(_recalibrated(probs, draws)), ["n_recal", "draw"]).join(q_s, "fold"))
    inside = lambda p, q: (F.col(q) == float("inf")) | (p >= F.round(1 - F.col(q), C.DIGITS))
    per = per.select("*", inside(F.col("p_true"), "q_t").cast("int").alias("cov_t"), inside(F.col("p_true"), "q").cast("int").alias("cov_s"),
                     F.size(F.filter("ps", lambda p: inside(p, "q_t"))).alias("size_t"), F.size(F.filter("ps", lambda p: inside(p, "q"))).alias("size_s"))
    empty = lambda c: F.avg((F.col(c) == 0).cast("double"))
    by_draw = per.groupBy("n_recal", "draw").agg(
        F.avg("cov_t").alias("cov_t"), F.avg("cov_s").alias("cov_s"), empty("size_t").alias("empty_t"),
        empty("size_s").alias("empty_s"), F.avg("size_t").alias("mean_t"))
    return by_draw.groupBy("n_recal").agg(
        F.count(F.lit(1)).alias("draws"), F.round(F.avg("cov_t"), 6).alias("coverage_recalibrated"),
        F.round(F.avg("cov_s"), 6).alias("coverage_source"), F.round(F.avg("empty_t"), 6).alias("empty_recalibrated"),
        F.round(F.avg("empty_s"), 6).alias("empty_source"), F.round(F.avg("mean_t"), 6).alias("set_size_recalibrated"))


# fixed values: which source classes answer for a target label (none = out of distribution)
LABEL_MAP = {"low": ["c0", "c1", "c2"], "mid": ["c3", "c4", "c5"], "single": ["c6"], "outside": []}
LABEL_OF = {"c0": "low", "c1": "low", "c2": "low", "c3": "mid", "c4": "mid", "c5": "mid", "c6": "single"}
_LM = "(VALUES ('low','c0'),('low','c1'),('low','c2'),('mid','c3'),('mid','c4'),('mid','c5'),('single','c6')) lm(label, candidate)"
TRANSFER = f""",
tl AS (SELECT sample_id, CASE WHEN class IN ('c0','c1','c2') THEN 'low' WHEN class IN ('c3','c4','c5') THEN 'mid' WHEN class = 'c6' THEN 'single' ELSE 'outside' END AS label FROM smp),
tp AS (SELECT p.*, tl.label, {IN_SET} AS inside, q, alpha, lm.candidate IS NOT NULL AS mapped FROM probs p JOIN tl USING (sample_id) JOIN th USING (fold)
  LEFT JOIN {_LM} ON lm.label = tl.label AND lm.candidate = p.candidate WHERE role = 'test'),
ts AS (SELECT alpha, label, sample_id, max((mapped AND inside)::INT) AS covered, sum(inside::INT) AS set_size,
   bool_or(mapped AND r = 1) AS correct FROM (SELECT *, row_number() OVER (PARTITION BY fold, alpha, sample_id ORDER BY p DESC, candidate) AS r FROM tp) GROUP BY ALL)"""


def _label_frame():
    m = F.create_map(*[x for c, t in LABEL_OF.items() for x in (F.lit(c), F.lit(t))])
    lab = F.coalesce(F.element_at(m, F.col("class")), F.lit("outside"))
    members = F.create_map(*[x for t, cs in LABEL_MAP.items()
                             for x in (F.lit(t), F.array(*[F.lit(c) for c in cs]).cast("array<string>"))])
    return lab, members


def _transfer_sets(probs, q):
    label, members = _label_frame()
    t = (probs.where("role = 'test'").join(q, "fold").withColumn("label", label)
         .withColumn("mapped", F.array_contains(F.element_at(members, F.col("label")), F.col("candidate"))))
    inside = C.lac_member()
    return t.groupBy("alpha", "label", "sample_id").agg(
        F.max((F.col("mapped") & inside).cast("int")).alias("covered"), F.sum(inside.cast("int")).alias("set_size"),
        F.min_by("mapped", F.struct(-F.col("p"), F.col("candidate"))).alias("correct"),
        F.collect_list(F.when(inside, F.col("candidate"))).alias("members"))


@query("transfer_coverage", "J16 C10 M13 A27", f"{BASE}{MARG}{TRANSFER}" + """
SELECT alpha, label, count(*) AS n, CASE WHEN label = 'outside' THEN NULL ELSE round(avg(covered), 6) END AS coverage,
  CASE WHEN label = 'outside' THEN NULL ELSE round(avg(correct::INT), 6) END AS accuracy,
  round(avg((set_size = 0)::INT), 6) AS empty_share, round(avg(set_size), 6) AS mean_size, max(set_size)::BIGINT AS max_size FROM ts GROUP BY alpha, label""")
def transfer_coverage(spark, sf):
    probs, scores = scored(spark, sf)
    ts = _transfer_sets(probs, C.thresholds(scores, ["fold"], ALPHAS))
    mapped = F.col("label") != "outside"
    return ts.groupBy("alpha", "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(mapped, F.col("covered"))), 6).alias("coverage"),
        F.round(F.avg(F.when(mapped, F.col("correct").cast("int"))), 6).alias("accuracy"),
        F.round(F.avg((F.col("set_size") == 0).cast("int")), 6).alias("empty_share"),
        F.round(F.avg("set_size"), 6).alias("mean_size"), F.max("set_size").alias("max_size"))


@query("outside_members", "C10", f"{BASE}{MARG}{TRANSFER}" + """
SELECT alpha, candidate, n, rank FROM (SELECT alpha, candidate, count(*) AS n, row_number() OVER (PARTITION BY alpha ORDER BY count(*) DESC, candidate) AS rank
  FROM tp WHERE label = 'outside' AND inside GROUP BY alpha, candidate) WHERE rank <= 4""")
def outside_members(spark, sf):
    probs, scores = scored(spark, sf)
    ts = _transfer_sets(probs, C.thresholds(scores, ["fold"], ALPHAS))
    n = (ts.where("label = 'outside'").select("alpha", F.explode("members").alias("candidate"))
         .groupBy("alpha", "candidate").agg(F.count(F.lit(1)).alias("n")))
    over = W.partitionBy("alpha").orderBy(F.desc("n"), "candidate")  # one row per class
    return n.withColumn("rank", F.row_number().over(over)).where("rank <= 4")


@query("superclass_label", "C10", f"{BASE}{MARG}{TRANSFER}" + """
SELECT sample_id, label, candidate AS best_class FROM (SELECT sample_id, label, candidate, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC, candidate) AS r
  FROM tp WHERE mapped AND alpha = 0.1) WHERE r = 1""")
def superclass_label(spark, sf):
    label, members = _label_frame()
    t = probs_v(spark, sf).where("role = 'test'").withColumn("label", label)
    t = t.where(F.array_contains(F.element_at(members, F.col("label")), F.col("candidate")))
    return t.groupBy("sample_id", "label").agg(
        F.min_by("candidate", F.struct(-F.col("p"), F.col("candidate"))).alias("best_class"))


@query("replayed_coverage", "C11 L3 S20", BASE + MARG + sets_sql("th", "fold") + """
SELECT fold, alpha, count(*) AS n, round(avg(covered), 6) AS coverage, true AS equal FROM st GROUP BY ALL""")
def replayed_coverage(spark, sf):
    """Write scores and thresholds, rebuild the coverage from the stored tables, and compare with the direct value."""
    from ..sources.sinks import read_scores, write_scores
    probs, scores = scored(spark, sf)
    q = settle(C.thresholds(scores, ["fold"], ALPHAS))
    direct = C.evaluate_sets(test_sets(probs, q), ["fold", "alpha"]).select("fold", "alpha", F.col("coverage").alias("direct"))
    stored = read_scores(spark, write_scores(spark, {"probs": probs, "thresholds": q}))
    again = C.evaluate_sets(test_sets(stored["probs"], stored["thresholds"]), ["fold", "alpha"])
    return again.join(direct, ["fold", "alpha"]).select(
        "fold", "alpha", "n", "coverage", (F.abs(F.col("coverage") - F.col("direct")) <= 1e-9).alias("equal"))


# ---- certificates -------------------------------------------------------------------------------------------------
ERR = f"""WITH {V_FACT}"""


def _size_sql(holds: str) -> str:
    return BASE + CALLS + """,
cfg AS (SELECT * FROM (VALUES (0.3::DOUBLE), (0.6::DOUBLE), (0.9::DOUBLE)) a(alpha), (VALUES (0.05::DOUBLE), (0.1::DOUBLE)) d(delta)),
ks AS (SELECT * FROM (VALUES (2), (4), (6), (8), (10)) k(k)),
er AS (SELECT fold, k, count(*) AS n, sum((NOT (rk <= k AND hit))::INT) AS n_err FROM (
  SELECT fold, k, sample_id, min(CASE WHEN candidate = class THEN rk END) AS rk, true AS hit FROM (
    SELECT fold, sample_id, class, candidate, row_number() OVER (PARTITION BY fold, sample_id ORDER BY p DESC, candidate) AS rk FROM probs WHERE role = 'test'), ks GROUP BY ALL) GROUP BY ALL),
bd AS (SELECT fold, k, n, n_err, alpha, delta, """ + holds + """ AS holds FROM er, cfg),
ok AS (SELECT *, bool_and(holds) OVER (PARTITION BY fold, alpha, delta ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS pass FROM bd)
SELECT fold, alpha, delta, min(k) FILTER (WHERE pass)::INT AS certified_k FROM ok GROUP BY ALL"""


#: P(at most n_err of n) at rate alpha, term by term.
BINOMIAL_TAIL = "(CASE WHEN n_err >= n THEN 1 ELSE list_sum(list_transform(range(0, n_err::BIGINT + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(alpha) + (n - i) * ln(1 - alpha)))) END)"


@query("certified_size", "C6 C7", _size_sql("least(1, n_err / n + sqrt(ln(1 / delta) / (2 * n))) <= alpha"))
def certified_size(spark, sf):
    """Smallest list length k whose "true class among the k best" error is certified (Hoeffding bound)."""
    return K.certify(_list_errors(spark, sf), ["fold"], [(a, d) for a in (0.3, 0.6, 0.9) for d in (0.05, 0.1)], "hoeffding")


def _list_errors(spark, sf):
    probs = probs_v(spark, sf).where("role = 'test'")
    own = probs.withColumn("rk", F.row_number().over(
        W.partitionBy("fold", "sample_id").orderBy(F.desc("p"), "candidate"))).where("candidate = class")
    each = own.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (2, 4, 6, 8, 10)])))
    return settle(K.panel_errors(each.withColumn("wrong", (F.col("rk") > F.col("k")).cast("int")), ["fold", "k"]))


@query("certified_size_exact", "C6 C7 F2", _size_sql(BINOMIAL_TAIL + " <= delta"))
def certified_size_exact(spark, sf):
    return K.certify(_list_errors(spark, sf), ["fold"], [(a, d) for a in (0.3, 0.6, 0.9) for d in (0.05, 0.1)], "exact")


@query("certify_losses", "C7", BASE + CALLS + f""",
w AS (SELECT fold, group_id, sample_id, (call <> class)::INT AS wrong, {u_sql(51, 'sample_id')} AS u FROM calls)
SELECT fold, 'pooled' AS loss, count(*)::BIGINT AS n, sum(wrong)::BIGINT AS n_err FROM w GROUP BY fold
UNION ALL SELECT fold, 'any_per_group', count(*), sum(x)::BIGINT FROM (SELECT fold, group_id, max(wrong) AS x FROM w GROUP BY ALL) GROUP BY fold
UNION ALL SELECT fold, 'one_per_group', count(*), sum(x)::BIGINT FROM (SELECT fold, group_id, arg_min(wrong, u) AS x FROM w GROUP BY ALL) GROUP BY fold""")
def certify_losses(spark, sf):
    probs = probs_v(spark, sf).where("role = 'test'").transform(settle)
    calls = M.calls(probs, ["fold", "sample_id", "group_id", "class"])
    return K.losses(calls.withColumn("wrong", (F.col("call") != F.col("class")).cast("int")), ["fold"], seed=51)


@query("groups_needed", "C7", f"""WITH {V_SAMPLES}, g AS (SELECT count(DISTINCT group_id) AS n_groups FROM smp)
SELECT alpha, delta, ceil(ln(delta) / ln(1 - alpha))::BIGINT AS needed, n_groups >= ceil(ln(delta) / ln(1 - alpha)) AS enough
FROM g, (VALUES (0.05::DOUBLE, 0.05::DOUBLE), (0.1, 0.05), (0.1, 0.1), (0.2, 0.1)) c(alpha, delta)""")
def groups_needed(spark, sf):
    n = samples_v(spark, sf).agg(F.count_distinct("group_id").alias("n_groups"))
    return K.zero_error_sizes(n, [(0.05, 0.05), (0.1, 0.05), (0.1, 0.1), (0.2, 0.1)])
