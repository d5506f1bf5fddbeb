"""Certified panel sizes from the stored errors of real k-feature panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models.centroid import centroids, fold_moments, panel_calls
from ..operators import certify as K
from ..operators import effects as X
from ..operators.splits import fold_roles
from ..session import settle
from .calibrating import BINOMIAL_TAIL
from .lenses import CAL_FRAC, N_FOLDS, SEED_CAL, V_FACT, V_FIT, V_FOLDS, fact_v, folds_v, u_sql
from .registry import query
from .selecting import OVR_FOLD, PANEL

#: Panel sizes, repeats of the calibration split, and the (α, δ) pairs of the grid with the one certificates use.
SIZES, REPEATS, ALPHA, DELTA = (2, 4, 8, 12, 16, 20), 2, 0.95, 0.1
GRID = [(a, d) for a in (0.6, 0.9, 0.95) for d in (0.05, 0.1)]
K_OF_INTEREST = 16

_ROLES = f"""
roles AS (
  SELECT (f.k * {REPEATS} + r.r)::INT AS fold, group_id, 'test' AS role FROM folds, range({N_FOLDS}) f(k), range({REPEATS}) r(r) WHERE folds.fold = f.k
  UNION ALL
  SELECT fold, group_id, CASE WHEN rn <= greatest(1, round(n * {CAL_FRAC})) THEN 'cal' ELSE 'fit' END FROM (
    SELECT (f.k * {REPEATS} + r.r)::INT AS fold, group_id, count(*) OVER (PARTITION BY f.k, r.r) AS n,
           row_number() OVER (PARTITION BY f.k, r.r ORDER BY ('0x' || substr(md5(concat_ws(':', ({SEED_CAL} + r.r)::VARCHAR, f.k, group_id)), 1, 8))::BIGINT / 4294967296::DOUBLE, group_id) AS rn
    FROM folds, range({N_FOLDS}) f(k), range({REPEATS}) r(r) WHERE folds.fold <> f.k))"""
_FOLDS = V_FOLDS[:V_FOLDS.index("roles AS (")]
_SIZES = ", ".join(f"({k})" for k in SIZES)
_ERRORS = f"WITH RECURSIVE {V_FACT}{_FOLDS}{_ROLES}{V_FIT}{OVR_FOLD}{PANEL}" + f""",
pk AS (SELECT k.k::INT AS k, p.fold, p.feature_id FROM panel p, (VALUES {_SIZES}) k(k) WHERE p.pick <= k.k),
kd AS (SELECT pk.k, r.fold, r.role, f.group_id, f.sample_id, f.class, c.candidate, round(sum(((f.value - c.mu) / c.sd) * ((f.value - c.mu) / c.sd)), 9) AS d2 FROM fact f JOIN roles r USING (group_id) JOIN pk ON pk.fold = r.fold AND pk.feature_id = f.feature_id
  JOIN cen c ON c.fold = r.fold AND c.feature_id = f.feature_id WHERE r.role IN ('test', 'cal') GROUP BY ALL),
kc AS (SELECT k, fold, role, group_id, sample_id, (class <> candidate)::INT AS wrong FROM (SELECT *, row_number() OVER (PARTITION BY k, fold, role, sample_id ORDER BY d2, candidate) AS r FROM kd) WHERE r = 1),
ku AS (SELECT *, {u_sql(51, 'sample_id')} AS u FROM kc WHERE role = 'cal'),
er AS (SELECT fold // {REPEATS} AS fold, fold % {REPEATS} AS repeat, loss, k, n, n_err FROM (
  SELECT fold, 'pooled' AS loss, k, count(*) AS n, sum(wrong) AS n_err FROM ku GROUP BY fold, k
  UNION ALL SELECT fold, 'any_per_group', k, count(*), sum(x) FROM (SELECT fold, k, group_id, max(wrong) AS x FROM ku GROUP BY ALL) GROUP BY fold, k
  UNION ALL SELECT fold, 'one_per_group', k, count(*), sum(x) FROM (SELECT fold, k, group_id, arg_min(wrong, u) AS x FROM ku GROUP BY ALL) GROUP BY fold, k)),
te AS (SELECT fold // {REPEATS} AS fold, fold % {REPEATS} AS repeat, k, avg(wrong) AS test_err FROM kc WHERE role = 'test' GROUP BY ALL)"""
def _certified(pairs: list[tuple[float, float]]) -> str:
    values = ", ".join(f"({a}::DOUBLE, {d}::DOUBLE)" for a, d in pairs)
    return f""",
bd AS (SELECT fold, repeat, loss, k, alpha, delta, {BINOMIAL_TAIL} <= delta AS holds FROM er, (VALUES {values}) g(alpha, delta)),
ok AS (SELECT *, bool_and(holds) OVER (PARTITION BY fold, repeat, loss, alpha, delta ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS pass FROM bd),
ce AS (SELECT fold, repeat, loss, alpha, delta, min(k) FILTER (WHERE pass) AS certified_k FROM ok GROUP BY ALL)"""


def stored_errors(spark, sf):
    """(calibration errors by split, loss and k; test error by split and k): every panel is fitted and dealt on fit individuals only."""
    fact, folds = fact_v(spark, sf), folds_v(spark, sf).transform(settle)
    roles = None
    for r in range(REPEATS):  # a parameter, not data
        one = fold_roles(folds, N_FOLDS, CAL_FRAC, seed=SEED_CAL + r).withColumn("fold", F.col("fold") * REPEATS + r)
        roles = one if roles is None else roles.unionByName(one)
    roles = settle(roles)
    fits = settle(fold_moments(fact, roles))
    panel = settle(X.round_robin(X.one_vs_rest(fits, ["fold"]), max(SIZES), ["fold"]))
    calls = settle(panel_calls(fact, roles, centroids(fits, ["fold"]), panel, SIZES).withColumn("wrong", (F.col("call") != F.col("class")).cast("int"))
                   .withColumn("repeat", F.col("fold") % REPEATS).withColumn("fold", F.floor(F.col("fold") / REPEATS).cast("int")))
    run = ["fold", "repeat", "k"]
    errors = K.losses(calls.where("role = 'cal'"), run, seed=51)
    return settle(errors), calls.where("role = 'test'").groupBy(*run).agg(F.avg("wrong").alias("test_err"))


@query("panel_certificates", "C6 C7 M6", _ERRORS + _certified([(ALPHA, DELTA)]) + f"""
SELECT ce.fold::INT AS fold, ce.repeat::INT AS repeat, loss, certified_k IS NOT NULL AS certified, certified_k::DOUBLE AS certified_k, round(test_err, 6) AS test_err, coalesce(test_err <= {ALPHA}, false) AS test_within_alpha
FROM ce LEFT JOIN te ON te.fold = ce.fold AND te.repeat = ce.repeat AND te.k = certified_k""")
def panel_certificates(spark, sf):
    """Certified size of every split under three losses, and whether the test individuals keep it."""
    errors, test = stored_errors(spark, sf)
    return K.validity(K.certify(errors, ["fold", "repeat", "loss"], [(ALPHA, DELTA)]), test, ["fold", "repeat"]).select(
        "fold", "repeat", "loss", F.col("certified_k").isNotNull().alias("certified"), F.col("certified_k").cast("double").alias("certified_k"),
        F.round("test_err", 6).alias("test_err"), F.coalesce("test_within_alpha", F.lit(False)).alias("test_within_alpha"))


@query("certified_distribution", "C6 C7", _ERRORS + _certified([(ALPHA, DELTA)]) + f"""
SELECT loss, k.k::INT AS k, count(*) AS n_splits, round(avg((certified_k IS NOT NULL AND certified_k <= k.k)::INT), 6) AS frac_certified FROM ce, (VALUES {_SIZES}) k(k) GROUP BY ALL""")
def certified_distribution(spark, sf):
    """Share of the splits that certify at most k features."""
    errors, _ = stored_errors(spark, sf)
    return K.size_distribution(K.certify(errors, ["fold", "repeat", "loss"], [(ALPHA, DELTA)]), SIZES).withColumn("frac_certified", F.round("frac_certified", 6))


@query("certificate_grid", "C6 C7", _ERRORS + _certified(GRID) + f"""
SELECT loss, alpha, delta, count(*) AS n_splits, round(avg((certified_k IS NOT NULL AND certified_k <= {K_OF_INTEREST})::INT), 6) AS frac_certified_k,
  round(avg((certified_k IS NOT NULL)::INT), 6) AS frac_any_certified, median(certified_k)::DOUBLE AS median_certified_k FROM ce GROUP BY ALL""")
def certificate_grid(spark, sf):
    """The (α, δ) pairs on the same stored errors: nothing is fitted again."""
    errors, _ = stored_errors(spark, sf)
    return K.grid_summary(K.certify(errors, ["fold", "repeat", "loss"], GRID), K_OF_INTEREST)
