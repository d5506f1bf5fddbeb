"""Splits, subsets and draw weights."""

from pyspark.sql import functions as F

from ..operators import splits as S
from .lenses import (CAL_FRAC, N_FOLDS, V_FOLDS, V_SAMPLES, folds_v, roles_v, samples_v, u_sql)
from .registry import query


@query("grouped_kfold", "R1", f"WITH {V_SAMPLES}{V_FOLDS} SELECT group_id, class, fold FROM folds")
def grouped_kfold(spark, sf):
    return folds_v(spark, sf)


@query("fit_cal_split", "R2", f"WITH {V_SAMPLES}{V_FOLDS} SELECT fold, group_id, role FROM roles")
def fit_cal_split(spark, sf):
    return roles_v(spark, sf)


@query("fit_cal_split_count", "R2", f"""WITH {V_SAMPLES}{V_FOLDS}
SELECT fold, role, count(*) AS n_groups FROM (
  SELECT fold, CASE WHEN role = 'test' THEN 'test' WHEN row_number() OVER (PARTITION BY fold, role = 'test'
      ORDER BY {u_sql(12, 'fold', 'group_id')}, group_id) <= 7 THEN 'cal' ELSE 'fit' END AS role FROM roles) GROUP BY ALL""")
def fit_cal_split_count(spark, sf):
    return S.fold_roles(folds_v(spark, sf), N_FOLDS, n_cal=7).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n_groups"))


_SEX = f"""WITH {V_SAMPLES}
SELECT DISTINCT s.split, group_id, CASE WHEN sex = s.tr THEN 'train' ELSE 'test' END AS role
FROM smp, (VALUES ('train_male_test_female', 'male'), ('train_female_test_male', 'female')) s(split, tr)"""


@query("leave_one_sex_out", "R3", _SEX)
def leave_one_sex_out(spark, sf):
    male, female = F.col("sex") == "male", F.col("sex") == "female"
    return S.shift_roles(samples_v(spark, sf), {"train_male_test_female": (male, female),
                                                "train_female_test_male": (female, male)})


@query("leave_one_level_out", "R3", f"""WITH {V_SAMPLES}
SELECT DISTINCT 'holdout_phase_' || l AS split, group_id, CASE WHEN phase = l THEN 'test' ELSE 'train' END AS role
FROM smp, range(5) t(l)""")
def leave_one_level_out(spark, sf):
    return S.leave_one_level_out(samples_v(spark, sf), "phase", list(range(5)))


@query("controls_to_treated", "R3 U4", f"""WITH {V_SAMPLES}, r AS (
SELECT DISTINCT 'train_control_test_treated' AS split, group_id, CASE WHEN phase = 0 THEN 'train' ELSE 'test' END AS role FROM smp)
SELECT split, role, count(DISTINCT group_id) AS n_groups, (SELECT count(*) FROM (SELECT group_id FROM r GROUP BY group_id HAVING count(DISTINCT role) > 1)) AS n_leaked
FROM r GROUP BY split, role""")
def controls_to_treated(spark, sf):
    roles = S.shift_roles(samples_v(spark, sf), {"train_control_test_treated": (F.col("phase") == 0, F.col("phase") != 0)})
    leaked = S.leaked_groups(roles, "split").agg(F.count(F.lit(1))).scalar()
    return roles.groupBy("split", "role").agg(F.count_distinct("group_id").alias("n_groups")).withColumn("n_leaked", leaked)


@query("leak_check", "R4 U4", f"""WITH {V_SAMPLES}{V_FOLDS}
SELECT fold, group_id, count(DISTINCT role) AS n_roles FROM roles GROUP BY ALL HAVING count(DISTINCT role) > 1""")
def leak_check(spark, sf):
    return S.leaked_groups(roles_v(spark, sf))


@query("describe_splits", "R4", f"""WITH {V_SAMPLES}{V_FOLDS}
SELECT fold, role, count(*) AS n_samples, count(DISTINCT group_id) AS n_groups, count(DISTINCT smp.class) AS n_classes
FROM smp JOIN roles USING (group_id) GROUP BY ALL""")
def describe_splits(spark, sf):
    return S.describe_splits(samples_v(spark, sf), roles_v(spark, sf))


@query("one_per_group", "R5", f"""WITH {V_SAMPLES}
SELECT group_id, sample_id FROM (SELECT group_id, sample_id, row_number() OVER (PARTITION BY group_id
  ORDER BY {u_sql(13, 'sample_id')}, sample_id) AS r FROM smp) WHERE r = 1""")
def one_per_group(spark, sf):
    return S.one_per_group(samples_v(spark, sf))


@query("random_subset", "R10", f"""WITH {V_SAMPLES}
SELECT class, sample_id FROM (SELECT class, sample_id, row_number() OVER (PARTITION BY class
  ORDER BY {u_sql(21, 'class', 'sample_id')}, sample_id) AS r FROM smp) WHERE r <= 8""")
def random_subset(spark, sf):
    return S.random_subset(samples_v(spark, sf).select("class", "sample_id"), ["class"], "sample_id", 8, 21)


@query("all_subsets", "R11", f"""WITH {V_SAMPLES}, ids AS (SELECT DISTINCT batch FROM smp)
SELECT a.batch || ';' || b.batch || ';' || c.batch AS draw, unnest([a.batch, b.batch, c.batch]) AS batch
FROM ids a JOIN ids b ON a.batch < b.batch JOIN ids c ON b.batch < c.batch""")
def all_subsets(spark, sf):
    return S.small_combinations(samples_v(spark, sf).select("batch").distinct(), "batch", 3)


#: Individuals in a drawn subset, and subsets.
SUBSET_SIZE, SUBSETS = 5, 40


@query("sampled_subsets", "R11", f"""WITH RECURSIVE {V_SAMPLES}, ids AS (SELECT group_id, row_number() OVER (ORDER BY {u_sql(17, 'group_id')}, group_id) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM smp)),
bt AS (SELECT c, i, CASE WHEN c < i THEN 0 ELSE round(exp(lgamma(c + 1) - lgamma(i + 1) - lgamma(c - i + 1)))::BIGINT END AS v FROM (SELECT max(n) AS n FROM ids), range(0, n + 1) a(c), range(1, {SUBSET_SIZE + 1}) b(i)),
tt AS (SELECT v AS total FROM bt WHERE i = {SUBSET_SIZE} AND c = (SELECT max(n) FROM ids)),
tr AS (SELECT id, floor(({u_sql(17, 't.id')} + {u_sql('17b', 't.id')} / 4294967296.0::DOUBLE) * total)::BIGINT AS rank FROM range({4 * SUBSETS + 16}) t(id), tt),
rk AS (SELECT rank FROM tr GROUP BY rank ORDER BY min(id) LIMIT {SUBSETS}),
walk(draw, i, r, c) AS (SELECT rank, {SUBSET_SIZE}, rank, -1::BIGINT FROM rk
  UNION ALL SELECT draw, i, r, c FROM (SELECT w.draw, w.i - 1 AS i, w.r - b.v AS r, b.c, row_number() OVER (PARTITION BY w.draw ORDER BY b.c DESC) AS z
    FROM walk w JOIN bt b ON b.i = w.i AND b.v <= w.r AND b.c < (SELECT max(n) FROM ids) WHERE w.i > 0) WHERE z = 1)
SELECT draw, group_id FROM walk JOIN ids ON ids.idx = walk.c WHERE c >= 0""")
def sampled_subsets(spark, sf):
    """Different subsets of five individuals, without listing all of them."""
    return S.sampled_combinations(samples_v(spark, sf), "group_id", SUBSET_SIZE, SUBSETS, 17)


@query("unseen_classes", "U3", f"""WITH {V_SAMPLES}
SELECT DISTINCT class FROM smp WHERE class NOT IN ('c0', 'c1') EXCEPT SELECT class FROM smp WHERE phase = 0 AND sex = 'male' AND batch = 'b3'""")
def unseen_classes(spark, sf):
    s = samples_v(spark, sf)
    target = s.where(~F.col("class").isin("c0", "c1")).select("class")
    return target.distinct().join(
        s.where("phase = 0 AND sex = 'male' AND batch = 'b3'").select("class"), "class", "left_anti")
