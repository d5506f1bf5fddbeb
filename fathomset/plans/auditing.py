"""Design audit on orders, events and line items."""

from pyspark.sql import functions as F

from ..functions.ranking import average_ranks, exact_quantiles
from ..functions.special import correlation_p
from ..functions.text import any_date, clock_hours, well_position
from ..operators import audit as A
from ..operators.matrices import log_cpm
from ..session import checked_broadcast, settle
from .lenses import (E_ROWS, K_COUNTS, K_LINES, O_ROWS, V_FACT, V_SAMPLES, counts_k, events_e, fact_v, lines_k, orders_o,
                     samples_v, supplier_class, table)
from .registry import query

VARS = ["status", "segment", "nation", "yr"]
CELLS = """,
cov AS (SELECT class, variable, level FROM (SELECT class, status, segment, nation, yr::VARCHAR AS yr FROM ord) UNPIVOT (level FOR variable IN (status, segment, nation, yr)))"""


def gamma_sf_sql(a: str, x: str) -> str:
    """DuckDB text of the upper incomplete gamma function, by the series of the lower one (six digits)."""
    return (f"(CASE WHEN {x} <= 0 THEN 1 WHEN {x} > 250 + 4 * ({a}) THEN 0 ELSE greatest(0, 1 - list_sum(list_transform(range(0, 900), "
            f"lambda i: exp(({a} + i) * ln({x}) - ({x}) - lgamma({a} + i + 1))))) END)")


def t_two_sided_sql(t: str, df: str) -> str:
    """DuckDB text of Student's two-sided tail, by the series of the incomplete beta function."""
    y, q = f"({t} * {t} / ({df} + {t} * {t}))", f"({df} / 2.0)"
    return (f"(CASE WHEN {y} <= 0 THEN 1 ELSE greatest(0, 1 - list_sum(list_transform(range(0, 600), "
            f"lambda i: exp((0.5 + i) * ln({y}) + {q} * ln(1 - {y}) + lgamma(0.5 + {q} + i) - lgamma(1.5 + i) - lgamma({q}))))) END)")


def _covariates(spark, sf):
    """(sample, class, variable, level) rows of the orders lens."""
    o = orders_o(spark, sf).withColumn("yr", F.col("yr").cast("string"))
    return o.unpivot(["sample_id", "class"], VARS, "variable", "level")


_V_SQL = """
SELECT variable, count_ AS n, n_a, n_b, round(sqrt(greatest(0, r - 1) / (least(n_a, n_b) - 1)), 6) AS v FROM (
  SELECT variable, sum(n) AS count_, count(DISTINCT class) AS n_a, count(DISTINCT level) AS n_b, sum(n * n / (ra * cb)) AS r FROM (
    SELECT *, sum(n) OVER (PARTITION BY variable, class) AS ra, sum(n) OVER (PARTITION BY variable, level) AS cb
    FROM (SELECT variable, class, level, count(*)::DOUBLE AS n FROM cov GROUP BY ALL)) GROUP BY variable)"""


@query("cramers_v", "A10", f"WITH {O_ROWS}{CELLS}{_V_SQL}".replace("count_ AS n", "count_::BIGINT AS n"))
def cramers_v(spark, sf):
    v = A.cramers_v(A.contingency(_covariates(spark, sf), ["variable"], "class", "level"), ["variable"])
    return v.select("variable", "n", "n_a", "n_b", F.round("v", 6).alias("v"))


@query("association_chi2", "A10 F2", f"WITH {O_ROWS}{CELLS}" + f"""
SELECT variable, round(n * (r - 1), 6) AS chi2, ((n_a - 1) * (n_b - 1))::BIGINT AS dof, round(greatest(0, r - 1) / (least(n_a, n_b) - 1), 6) AS v2,
  round(CASE WHEN n_a > 1 AND n_b > 1 THEN {gamma_sf_sql('(n_a - 1) * (n_b - 1) / 2.0', 'greatest(0, n * (r - 1)) / 2')} END, 6) AS p_value FROM (
  SELECT variable, sum(n) AS n, count(DISTINCT class) AS n_a, count(DISTINCT level) AS n_b, sum(n * n / (ra * cb)) AS r FROM (
    SELECT *, sum(n) OVER (PARTITION BY variable, class) AS ra, sum(n) OVER (PARTITION BY variable, level) AS cb
    FROM (SELECT variable, class, level, count(*)::DOUBLE AS n FROM cov GROUP BY ALL)) GROUP BY variable)""")
def association_chi2(spark, sf):
    v = A.cramers_v(A.contingency(_covariates(spark, sf), ["variable"], "class", "level"), ["variable"])
    return v.select("variable", F.round("chi2", 6).alias("chi2"), ((F.col("n_a") - 1) * (F.col("n_b") - 1)).alias("dof"),
                    F.round(F.col("v") ** 2, 6).alias("v2"), F.round("p_value", 6).alias("p_value"))


# suppliers: class = nation; processing variables of the lines they ship
KCOV = f"""WITH {K_LINES}, base AS (SELECT nation AS class, group_id, yr, status, l_suppkey % 4 AS plate, l_suppkey % 11 AS lane FROM lines JOIN cls USING (group_id)),
cov AS (SELECT class, variable, level FROM (SELECT class, yr::VARCHAR AS yr, status, 'p' || plate AS plate, 'l' || lane AS lane FROM base) UNPIVOT (level FOR variable IN (yr, status, plate, lane))),
lv AS (SELECT DISTINCT variable, class, level FROM cov),
pr AS (SELECT DISTINCT a.variable, a.class AS class_a, b.class AS class_b FROM lv a JOIN lv b ON a.variable = b.variable AND a.level = b.level AND a.class < b.class)"""


def _kcov(spark, sf):
    li = lines_k(spark, sf).join(supplier_class(spark, sf), "group_id")
    return li.select(F.col("nation").alias("class"), F.col("yr").cast("string").alias("yr"), "status",
                     F.concat(F.lit("p"), F.col("l_suppkey") % 4).alias("plate"),
                     F.concat(F.lit("l"), F.col("l_suppkey") % 11).alias("lane")).unpivot(
        ["class"], ["yr", "status", "plate", "lane"], "variable", "level")


@query("shared_pairs", "J12", KCOV + " SELECT variable, class_a, class_b FROM pr")
def shared_pairs(spark, sf):
    return A.sharing_pairs(A.class_levels(_kcov(spark, sf)))


@query("estimable_pairs", "J13", KCOV + """
SELECT class_a, class_b FROM pr WHERE variable IN ('plate', 'lane', 'status') GROUP BY ALL HAVING count(DISTINCT variable) = 3""")
def estimable_pairs(spark, sf):
    return A.estimable_pairs(A.sharing_pairs(A.class_levels(_kcov(spark, sf))), ["plate", "lane", "status"])


@query("nesting_table", "A11 A10 J12", KCOV + """,
pc AS (SELECT variable, class, count(*) AS l FROM lv GROUP BY ALL), pl AS (SELECT variable, level, count(*) AS c FROM lv GROUP BY ALL),
c1 AS (SELECT variable, count(*) AS n_classes, quantile_cont(l, 0.5)::DOUBLE AS median_levels_per_class, max(l) AS max_levels_per_class, count(*) FILTER (WHERE l = 1) AS classes_in_one_level FROM pc GROUP BY ALL),
l1 AS (SELECT variable, count(*) AS n_levels, max(c) AS max_classes_per_level, count(*) FILTER (WHERE c > 1) AS n_levels_shared FROM pl GROUP BY ALL),
cv AS (SELECT variable, CASE WHEN least(count(DISTINCT class), count(DISTINCT level)) > 1 THEN sqrt(greatest(0, sum(n * n / (ra * cb)) - 1) / (least(count(DISTINCT class), count(DISTINCT level)) - 1)) ELSE 0 END AS v FROM (
  SELECT *, sum(n) OVER (PARTITION BY variable, class) AS ra, sum(n) OVER (PARTITION BY variable, level) AS cb FROM (SELECT variable, class, level, count(*)::DOUBLE AS n FROM cov GROUP BY ALL)) GROUP BY variable)
SELECT variable, n_levels, n_classes, median_levels_per_class, max_levels_per_class, max_classes_per_level, n_levels_shared, classes_in_one_level, round(v, 6) AS cramers_v,
  (SELECT count(*) FROM pr WHERE pr.variable = c1.variable) AS n_pairs_sharing, (n_classes * (n_classes - 1) / 2)::BIGINT AS n_pairs_total FROM c1 JOIN l1 USING (variable) JOIN cv USING (variable)""")
def nesting_table(spark, sf):
    return A.nesting_table(_kcov(spark, sf))


@query("design_comparison", "L5", KCOV.replace("WITH ", f"WITH {O_ROWS}, ", 1) + """,
oc AS (SELECT DISTINCT class, variable, level FROM (SELECT class, status, segment, nation FROM ord) UNPIVOT (level FOR variable IN (status, segment, nation))),
op AS (SELECT DISTINCT a.variable, a.class AS ca, b.class AS cb FROM oc a JOIN oc b ON a.variable = b.variable AND a.level = b.level AND a.class < b.class),
oe AS (SELECT ca, cb FROM op GROUP BY ALL HAVING count(DISTINCT variable) = 3), ke AS (SELECT class_a, class_b FROM pr WHERE variable IN ('plate', 'lane', 'status') GROUP BY ALL HAVING count(DISTINCT variable) = 3),
oo AS (SELECT count(DISTINCT class) AS c FROM oc), kk AS (SELECT count(DISTINCT class) AS c FROM lv)
SELECT 'orders' AS dataset, (SELECT count(*) FROM oe) AS n_estimable, (c * (c - 1) / 2)::BIGINT AS n_total, round((SELECT count(*) FROM oe) / (c * (c - 1) / 2), 6) AS share FROM oo
UNION ALL SELECT 'suppliers', (SELECT count(*) FROM ke), (c * (c - 1) / 2)::BIGINT, round((SELECT count(*) FROM ke) / (c * (c - 1) / 2), 6) FROM kk""")
def design_comparison(spark, sf):
    out = None
    for name, cov, variables in (("orders", _covariates(spark, sf), ["status", "segment", "nation"]),
                                 ("suppliers", _kcov(spark, sf), ["plate", "lane", "status"])):
        lv = A.class_levels(cov.where(F.col("variable").isin(variables)))
        c = lv.agg(F.count_distinct("class").alias("c")).select((F.col("c") * (F.col("c") - 1) / 2).cast("long").alias("n_total"))
        n = A.estimable_pairs(A.sharing_pairs(lv), variables).agg(F.count(F.lit(1)).alias("n"))
        part = c.select(F.lit(name).alias("dataset"), n.scalar().alias("n_estimable"), "n_total").withColumn(
            "share", F.round(F.col("n_estimable") / F.col("n_total"), 6))
        out = part if out is None else out.unionByName(part)
    return out


R2 = """round(sum(n * (m - g) * (m - g)) / (sum(n * (m - g) * (m - g)) + sum(w)), 6)"""


@query("r2_categorical", "A12", f"""WITH {V_FACT}, x AS (SELECT feature_id, factor, level, value FROM (SELECT feature_id, value, class, batch, sex, sex || '/' || phase AS design FROM fact) UNPIVOT (level FOR factor IN (class, batch, sex, design))),
l AS (SELECT factor, feature_id, level, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS w FROM x GROUP BY ALL)
SELECT factor, feature_id, sum(n)::BIGINT AS n, {R2} AS r2 FROM (SELECT *, sum(n * m) OVER (PARTITION BY factor, feature_id) / sum(n) OVER (PARTITION BY factor, feature_id) AS g FROM l) GROUP BY ALL""")
def r2_categorical(spark, sf):
    f = fact_v(spark, sf).withColumn("design", F.concat_ws("/", "sex", "phase"))
    x = f.unpivot(["feature_id", "value"], ["class", "batch", "sex", "design"], "factor", "level")
    return A.r2_categorical(x, ["factor", "feature_id"], ["level"]).withColumn("r2", F.round("r2", 6))


@query("r2_numeric", "A12", f"WITH {V_FACT} SELECT feature_id, count(*) AS n, round(corr(value, phase) * corr(value, phase), 6) AS r2 FROM fact GROUP BY ALL")
def r2_numeric(spark, sf):
    return A.r2_numeric(fact_v(spark, sf), ["feature_id"], "phase").withColumn("r2", F.round("r2", 6))


@query("covariate_design", "A12 A10", f"""WITH {O_ROWS}, l AS (SELECT class AS level, count(*) AS n, avg(balance) AS m, var_pop(balance) * count(*) AS w FROM ord GROUP BY class)
SELECT 'balance' AS covariate, {R2} AS shared FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS g FROM l)""")
def covariate_design(spark, sf):
    o = orders_o(spark, sf).withColumn("covariate", F.lit("balance"))
    return A.r2_categorical(o, ["covariate"], ["class"], "balance").select("covariate", F.round("r2", 6).alias("shared"))


# ---- typed covariates on the events -----------------------------------------------------------------------------
TXT = f"""WITH {E_ROWS}, t AS (SELECT sample_id, class, dom, group_id, CASE WHEN k % 50 = 0 THEN 'n/a' ELSE value::VARCHAR END AS num, lpad(hour::VARCHAR, 2, '0') || ':' || lpad(minute(ts)::VARCHAR, 2, '0') AS clock,
  CASE dom % 2 WHEN 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d') END AS day1, strftime(ts, '%m/%d/%Y') AS day2, 'u' || sample_id AS ident, 'k' || (k % 6) AS kind6, 'same' AS fixed,
  CASE WHEN dom <= 15 THEN 'w' || (k % 3) ELSE NULL END AS early FROM ev),
lg AS (SELECT sample_id, class, dom, variable, level FROM t UNPIVOT INCLUDE NULLS (level FOR variable IN (num, clock, day1, day2, ident, kind6, fixed, early))),
kd AS (SELECT variable, count(level) AS n, CASE WHEN count(level) = 0 THEN 'empty' WHEN count(try_cast(level AS DOUBLE)) >= 0.9 * count(level) THEN 'numeric'
   WHEN bool_and(level IS NULL OR regexp_full_match(level, '\\d{{1,2}}:\\d{{2}}(:\\d{{2}})?')) THEN 'time' WHEN count(coalesce(try_strptime(level, '%Y-%m-%d'), try_strptime(level, '%m/%d/%Y'))) >= 0.9 * count(level) THEN 'datetime' ELSE 'categorical' END AS kind,
   coalesce(min(level) = max(level), true) AS constant FROM lg GROUP BY variable)"""


def _text_covariates(spark, sf):
    e = events_e(spark, sf).select(
        "sample_id", "class", "dom", F.when(F.col("k") % 50 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("num"),
        F.date_format("ts", "HH:mm").alias("clock"), F.date_format("ts", "yyyy-MM-dd").alias("day1"),
        F.date_format("ts", "MM/dd/yyyy").alias("day2"), F.concat(F.lit("u"), "sample_id").alias("ident"),
        F.concat(F.lit("k"), F.col("k") % 6).alias("kind6"), F.lit("same").alias("fixed"),
        F.when(F.col("dom") <= 15, F.concat(F.lit("w"), F.col("k") % 3)).alias("early"))
    return e.unpivot(["sample_id", "class", "dom"], ["num", "clock", "day1", "day2", "ident", "kind6", "fixed", "early"], "variable", "level")


@query("infer_types", "P9 F5", TXT + " SELECT variable, n, kind, constant FROM kd")
def infer_types(spark, sf):
    return A.infer_types(_text_covariates(spark, sf), ["variable"])


@query("usable_covariates", "P10", TXT + """
SELECT variable, kind, n_levels FROM kd JOIN (SELECT variable, count(DISTINCT level) AS n_levels, count(level) AS r FROM lg GROUP BY variable) USING (variable)
WHERE kind <> 'empty' AND n_levels >= 2 AND NOT (kind = 'categorical' AND n_levels >= 0.9 * r)""")
def usable_covariates(spark, sf):
    t = _text_covariates(spark, sf)
    return A.usable_covariates(t, A.infer_types(t, ["variable"]), ["variable"])


SCR = TXT + """,
sx AS (SELECT class, variable, kind, level, dom > 15 AS positive, CASE kind WHEN 'numeric' THEN try_cast(level AS DOUBLE) WHEN 'time' THEN split_part(level, ':', 1)::DOUBLE + split_part(level, ':', 2)::DOUBLE / 60
   WHEN 'datetime' THEN date_diff('day', DATE '2018-01-01', coalesce(try_strptime(level, '%Y-%m-%d'), try_strptime(level, '%m/%d/%Y'))::DATE)::DOUBLE END AS x FROM lg JOIN kd USING (variable)),
bs AS (SELECT class, variable, kind, avg((level IS NULL)::INT) FILTER (WHERE positive) AS mp, avg((level IS NULL)::INT) FILTER (WHERE NOT positive) AS mn, sum(positive::INT)::BIGINT AS n_pos, count(*) AS n FROM sx GROUP BY ALL),
rk AS (SELECT class, variable, positive, rank() OVER (PARTITION BY class, variable ORDER BY x) + (count(*) OVER (PARTITION BY class, variable, x) - 1) / 2.0 AS ar FROM sx WHERE x IS NOT NULL AND kind <> 'categorical'),
au AS (SELECT class, variable, (sum(ar) FILTER (WHERE positive) - count(*) FILTER (WHERE positive) * (count(*) FILTER (WHERE positive) + 1) / 2.0) / (count(*) FILTER (WHERE positive) * count(*) FILTER (WHERE NOT positive)) AS a, count(*) FILTER (WHERE positive)::DOUBLE AS np, count(*) FILTER (WHERE NOT positive)::DOUBLE AS nn FROM rk GROUP BY ALL),
ti AS (SELECT class, variable, sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT class, variable, count(*) AS t FROM sx WHERE x IS NOT NULL AND kind <> 'categorical' GROUP BY class, variable, x) GROUP BY ALL),
zz AS (SELECT class, variable, pow(greatest(abs(a * np * nn - np * nn / 2) - 0.5, 0), 2) / nullif(np * nn / 12 * (np + nn + 1 - ties / ((np + nn) * (np + nn - 1))), 0) / 2 AS h, np * nn > 0 AS both_ FROM au JOIN ti USING (class, variable)),
pz AS (SELECT class, variable, CASE WHEN both_ THEN """ + gamma_sf_sql("0.5", "coalesce(h, 0)") + """ END AS p_num FROM zz),
ct AS (SELECT class, variable, level, positive, count(*)::DOUBLE AS n FROM sx WHERE kind = 'categorical' AND level IS NOT NULL GROUP BY ALL),
vv AS (SELECT class, variable, CASE WHEN least(count(DISTINCT level), count(DISTINCT positive)) > 1 THEN sqrt(greatest(0, sum(n * n / (ra * cb)) - 1) / (least(count(DISTINCT level), count(DISTINCT positive)) - 1)) END AS v, sum(n) * (sum(n * n / (ra * cb)) - 1) / 2 AS hx, (count(DISTINCT level) - 1) * (count(DISTINCT positive) - 1) / 2.0 AS hd FROM (
  SELECT *, sum(n) OVER (PARTITION BY class, variable, level) AS ra, sum(n) OVER (PARTITION BY class, variable, positive) AS cb FROM ct) GROUP BY ALL),
sc AS (SELECT bs.class, bs.variable, bs.kind, n, n_pos, round(mp, 6) AS missing_pos, round(mn, 6) AS missing_neg, CASE WHEN a IS NOT NULL THEN 'auroc' WHEN v IS NOT NULL THEN 'cramers_v' END AS stat,
  coalesce(greatest(a, 1 - a), v) AS sep, round(coalesce(p_num, CASE WHEN v IS NOT NULL THEN """ + gamma_sf_sql("hd", "greatest(0, hx)") + """ END), 6) AS p_value, ((mn >= 0.8 AND mp <= 0.2) OR (mp >= 0.8 AND mn <= 0.2)) AS one_sided_missing,
  ((mn >= 0.8 AND mp <= 0.2) OR (mp >= 0.8 AND mn <= 0.2)) OR coalesce(coalesce(greatest(a, 1 - a), v) >= CASE WHEN a IS NOT NULL THEN 0.95 ELSE 0.9 END, false) AS separates
  FROM bs LEFT JOIN au USING (class, variable) LEFT JOIN vv USING (class, variable) LEFT JOIN pz USING (class, variable))"""


def _screen(spark, sf):
    t = _text_covariates(spark, sf)
    kinds = settle(A.infer_types(t, ["variable"]).select("variable", "kind"))
    long = t.join(checked_broadcast(kinds), "variable").withColumn("x", A.typed_value()).withColumn("positive", F.col("dom") > 15)
    return A.two_group_screen(long, ["class", "variable"])


@query("auroc_screen", "A21 A10 F5", SCR + " SELECT * EXCLUDE (sep), round(sep, 6) AS separation FROM sc")
def auroc_screen(spark, sf):
    return _screen(spark, sf)


@query("screen_summary", "A21", SCR + """ SELECT variable, count(DISTINCT class) AS n_classes, count(*) FILTER (WHERE separates) AS n_separating, round(max(sep), 6) AS max_separation,
  max(one_sided_missing::INT) AS any_one_sided FROM sc GROUP BY variable""")
def screen_summary(spark, sf):
    return A.screen_summary(_screen(spark, sf))


@query("verdicts", "A22", SCR + """ SELECT class, round(max(sep), 6) AS max_separation, coalesce(string_agg(variable, ';' ORDER BY variable) FILTER (WHERE separates), '') AS separating,
  CASE WHEN count(*) FILTER (WHERE separates) > 0 THEN 'unresolvable: a covariate separates the groups' WHEN max(sep) >= 0.8 THEN 'doubtful: a covariate classifies the groups' ELSE 'treatment' END AS verdict FROM sc GROUP BY class""")
def verdicts(spark, sf):
    return A.verdicts(_screen(spark, sf), 0.8)


@query("covariate_categories", "P8", """WITH names(variable) AS (SELECT unnest(['key.protocol', 'training.day1', 'nmr.testing.fat_1', 'registration.sex', 'Lib_batch_ID', 'reads_raw', 'pct_' || c, 'tmt_plex', 'x.comments', c])
  FROM (SELECT DISTINCT event_type AS c FROM events))
SELECT DISTINCT variable, CASE WHEN variable LIKE '%comments' THEN NULL WHEN variable = 'key.protocol' THEN 'design' WHEN variable LIKE 'training.%' THEN 'outcome' WHEN variable LIKE 'nmr.testing.%\\_1' ESCAPE '\\' THEN 'baseline'
  WHEN variable LIKE 'registration.%' THEN 'collection' WHEN variable LIKE 'Lib%' THEN 'library' WHEN variable LIKE 'reads%' THEN 'depth' WHEN starts_with(variable, 'pct_') THEN 'qc' WHEN starts_with(variable, 'tmt') THEN 'processing' ELSE 'other' END AS category FROM names""")
def covariate_categories(spark, sf):
    names = ["key.protocol", "training.day1", "nmr.testing.fat_1", "registration.sex", "Lib_batch_ID", "reads_raw", "tmt_plex", "x.comments"]
    c = F.col("class")
    v = events_e(spark, sf).select("class").distinct().select(
        F.explode(F.array(*[F.lit(n) for n in names], F.concat(F.lit("pct_"), c), c)).alias("variable")).distinct()
    return v.withColumn("category", A.category("variable"))


# ---- bridging, ids, layers --------------------------------------------------------------------------------------
@query("bridge_variance", "A20 P6", f"""WITH {K_COUNTS},
lc AS (SELECT *, log2(1e6 * value / sum(value) OVER (PARTITION BY sample_id) + 1) AS v FROM counts),
cm AS (SELECT class, feature_id, avg(v) AS m, var_samp(v) AS w FROM lc WHERE l_suppkey % 10 <> 0 GROUP BY ALL),
vc AS (SELECT feature_id, var_samp(m) AS v_class, avg(w) AS v_within FROM cm GROUP BY ALL),
vb AS (SELECT group_id AS pool, feature_id, var_samp(v) AS v_batch, avg(v) AS pm FROM lc WHERE l_suppkey % 10 = 0 GROUP BY ALL HAVING count(DISTINCT right(sample_id, 4)) >= 2),
j AS (SELECT * FROM vb JOIN vc USING (feature_id) WHERE v_class > 0),
e AS (SELECT 'all' AS feature_set, * FROM j UNION ALL SELECT 'brand1x', * FROM j WHERE feature_id LIKE 'Brand#1%' UNION ALL SELECT 'expressed_in_pool', * FROM j WHERE pm >= 15)
SELECT pool, feature_set, count(*) AS n_features, round(quantile_cont(v_batch / v_class, 0.5), 6) AS median_ratio, round(sum(v_batch) / sum(v_class), 6) AS sum_ratio, round(quantile_cont(v_batch / v_within, 0.5), 6) AS median_ratio_within FROM e GROUP BY ALL""".replace("any_value(class) AS class", "any_value(l_suppkey) AS l_suppkey, any_value(class) AS class"))
def bridge_variance(spark, sf):
    lc = settle(log_cpm(counts_k(spark, sf)))
    ref = F.substring("group_id", 2, 20).cast("long") % 10 == 0
    pools = lc.where(ref).select(F.col("group_id").alias("pool"), "feature_id", F.substring_index("sample_id", "-", -1).alias("plate"), "value")
    names = lc.select("feature_id").distinct()
    sets = names.withColumn("feature_set", F.explode(F.array_compact(F.array(
        F.lit("all"), F.when(F.col("feature_id").startswith("Brand#1"), "brand1x")))))
    return A.bridge_variance(pools, lc.where(~ref), sets, 15.0)


@query("one_to_one_pairs", "J8", """WITH d AS (SELECT DISTINCT p_name AS a, p_brand AS b FROM part WHERE p_name IS NOT NULL)
SELECT a, b FROM d WHERE a IN (SELECT a FROM d GROUP BY a HAVING count(*) = 1) AND b IN (SELECT b FROM d GROUP BY b HAVING count(*) = 1)
UNION ALL SELECT a, b FROM (SELECT DISTINCT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier) q WHERE b IN (SELECT 'n' || s_nationkey FROM supplier GROUP BY s_nationkey HAVING count(*) = 1)""")
def one_to_one_pairs(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("a"), F.col("p_brand").alias("b"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b"))
    return A.one_to_one(p, "a", "b").unionByName(A.one_to_one(s, "a", "b"))


@query("two_stage_match", "J9", """WITH src AS (SELECT 'c' || c_custkey AS src, 's' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'sym' || (c_custkey % 140) END AS symbol FROM customer),
tgt AS (SELECT 's' || s_suppkey AS id, 'sym' || (s_suppkey + 60) AS symbol FROM supplier WHERE s_suppkey % 3 <> 0),
b1 AS (SELECT src, id, 1 AS stage FROM src WHERE id IN (SELECT id FROM tgt)),
b2 AS (SELECT src, n.id, 2 AS stage FROM src JOIN (SELECT symbol, max(id) AS id FROM tgt GROUP BY symbol) n USING (symbol) WHERE src.id NOT IN (SELECT id FROM tgt)),
f AS (SELECT src, id, stage FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY stage, id) AS r FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2)) WHERE r = 1)
SELECT src, id, stage FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stage, src) AS r FROM f) WHERE r = 1""")
def two_stage_match(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    src = c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("s"), "c_custkey").alias("id"),
                   F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("sym"), F.col("c_custkey") % 140)).alias("symbol"))
    tgt = s.where("s_suppkey % 3 <> 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"),
                                               F.concat(F.lit("sym"), F.col("s_suppkey") + 60).alias("symbol"))
    return A.two_stage_match(src, tgt)


PAIRED = f"""WITH {K_LINES}, a AS (SELECT feature_id AS gene, specimen_id, sum(quantity) AS x FROM lines WHERE status = 'O' GROUP BY ALL), b AS (SELECT feature_id AS gene, specimen_id, sum(quantity) AS y FROM lines WHERE status = 'F' GROUP BY ALL),
j AS (SELECT * FROM a JOIN b USING (gene, specimen_id))"""


def _two_layers(spark, sf):
    li = lines_k(spark, sf)
    side = lambda s: li.where(F.col("status") == s).groupBy(F.col("feature_id").alias("gene"), "specimen_id").agg(F.sum("quantity").alias("value"))
    return side("O"), side("F")


@query("paired_layers", "J14 J19", PAIRED + " SELECT gene, count(*) AS n, round(avg(x), 6) AS mean_a, round(avg(y), 6) AS mean_b FROM j GROUP BY gene")
def paired_layers(spark, sf):
    a, b = _two_layers(spark, sf)
    j = a.withColumnRenamed("value", "x").join(b.withColumnRenamed("value", "y"), ["gene", "specimen_id"])
    return j.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean_a"), F.round(F.avg("y"), 6).alias("mean_b"))


@query("layer_correlation", "A18 W5", PAIRED + """,
r AS (SELECT gene, rank() OVER (PARTITION BY gene ORDER BY x) + (count(*) OVER (PARTITION BY gene, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY gene ORDER BY y) + (count(*) OVER (PARTITION BY gene, y) - 1) / 2.0 AS ry FROM j)
SELECT gene, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY gene""")
def layer_correlation(spark, sf):
    a, b = _two_layers(spark, sf)
    return A.layer_correlation(a, b, ["gene"], "specimen_id").withColumn("rho", F.round("rho", 6))


@query("correlation_strata", "A18 W8", PAIRED + """,
g AS (SELECT gene, corr(x, y) AS r, max(y) - min(y) AS span FROM j GROUP BY gene), c AS (SELECT quantile_cont(span, 0.25) AS q1, quantile_cont(span, 0.5) AS q2, quantile_cont(span, 0.75) AS q3 FROM g)
SELECT CASE WHEN span <= q1 THEN 1 WHEN span <= q2 THEN 2 WHEN span <= q3 THEN 3 ELSE 4 END AS quartile, count(*) AS n, round(avg(r), 6) AS mean_r, round(quantile_cont(r, 0.5), 6) AS median_r FROM g, c GROUP BY 1""")
def correlation_strata(spark, sf):
    a, b = _two_layers(spark, sf)
    j = a.withColumnRenamed("value", "x").join(b.withColumnRenamed("value", "y"), ["gene", "specimen_id"])
    g = settle(j.groupBy("gene").agg(F.corr("x", "y").alias("r"), (F.max("y") - F.min("y")).alias("span")))
    cuts = exact_quantiles(g, [], "span", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    # one row per gene: bounded by the feature dimension
    return A.quartile_bins(g, cuts, "span").groupBy("quartile").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("mean_r"), F.round(F.percentile("r", F.lit(0.5)), 6).alias("median_r"))


@query("discordance_features", "A29 W6", PAIRED + """,
g AS (SELECT gene, avg(x) AS mean_a, avg(y) AS mean_b, var_samp(x) AS var_a, var_samp(y) AS var_b, stddev_samp(x) / nullif(abs(avg(x)), 0) AS cv_a, corr(x, y) AS rho FROM j GROUP BY gene),
s AS (SELECT regexp_replace(p_brand || '_' || p_type, '_[^_]*$', '') AS gene, count(DISTINCT p_type) AS n_sites FROM part GROUP BY 1)
SELECT gene, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(var_a, 6) AS var_a, round(var_b, 6) AS var_b, round(cv_a, 6) AS cv_a, round(rho, 6) AS rho,
  round((rank() OVER (ORDER BY mean_b) + (count(*) OVER (PARTITION BY mean_b) - 1) / 2.0) / count(*) OVER (), 6) AS abundance_rank, coalesce(n_sites, 0) AS n_sites FROM g LEFT JOIN s USING (gene)""")
def discordance_features(spark, sf):
    a, b = _two_layers(spark, sf)
    j = a.withColumnRenamed("value", "x").join(b.withColumnRenamed("value", "y"), ["gene", "specimen_id"])
    g = settle(j.groupBy("gene").agg(
        F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"), F.var_samp("x").alias("var_a"), F.var_samp("y").alias("var_b"),
        F.try_divide(F.stddev_samp("x"), F.abs(F.avg("x"))).alias("cv_a"), F.corr("x", "y").alias("rho")))
    sites = table(spark, sf, "part").select(F.concat_ws("_", "p_brand", "p_type").alias("site")).select(
        F.regexp_replace("site", "_[^_]*$", "").alias("gene"), "site").groupBy("gene").agg(F.count_distinct("site").alias("n_sites"))
    r = average_ranks(g, [], "mean_b").withColumn("abundance_rank", F.round(F.col("avg_rank") / F.col("n_total"), 6))
    cols = [F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "var_a", "var_b", "cv_a", "rho")]
    return r.join(sites, "gene", "left").select("gene", *cols, "abundance_rank", F.coalesce("n_sites", F.lit(0)).alias("n_sites"))


DA = f"""WITH {K_LINES}, da AS (SELECT feature_id AS gene, status AS layer, flag AS sex, yr AS contrast, avg(quantity) - 25.5 AS stat, least(1, 1 / (1 + abs(avg(quantity) - 25.5))) AS padj FROM lines GROUP BY ALL)"""


def _da(spark, sf):
    d = F.avg("quantity") - 25.5
    return lines_k(spark, sf).groupBy(F.col("feature_id").alias("gene"), F.col("status").alias("layer"), F.col("flag").alias("sex"),
                                      F.col("yr").alias("contrast")).agg(d.alias("stat"), F.least(F.lit(1.0), 1 / (1 + F.abs(d))).alias("padj"))


@query("da_discordance", "J15 S8", DA + """,
j AS (SELECT a.gene, a.sex, a.contrast, a.stat AS sa, b.stat AS sb, a.padj < 0.4 AS ga, b.padj < 0.4 AS gb FROM da a JOIN da b USING (gene, sex, contrast) WHERE a.layer = 'O' AND b.layer = 'F')
SELECT gene, sex, contrast, round(sa, 6) AS stat_a, round(sb, 6) AS stat_b, ga AND gb AND sign(sa) = sign(sb) AS concordant, ga AND gb AND sign(sa) <> sign(sb) AS discordant_sign, ga <> gb AS discordant_sig FROM j""")
def da_discordance(spark, sf):
    d = _da(spark, sf)
    r = A.discordance(d.where("layer = 'O'"), d.where("layer = 'F'"), ["gene", "sex", "contrast"], 0.4)
    return r.select("gene", "sex", "contrast", F.round("stat_a", 6).alias("stat_a"), F.round("stat_b", 6).alias("stat_b"), "concordant", "discordant_sign", "discordant_sig")


@query("training_response", "J17", DA + """,
s AS (SELECT gene, sex, round(max(abs(stat)), 9) AS top, arg_min(contrast, (round(-abs(stat), 9), contrast)) AS top_contrast, count(*) FILTER (WHERE padj < 0.4) AS n_sig FROM da WHERE layer = 'O' GROUP BY ALL)
SELECT gene, sex, round(top, 6) AS top_effect, top_contrast, n_sig, round((SELECT avg((padj < 0.4)::INT) FROM da d WHERE d.layer = 'O' AND d.sex = s.sex), 6) AS background,
  (SELECT array_to_string(list_sort(list(DISTINCT flag)), ';') FROM lines l WHERE l.feature_id = s.gene AND l.quantity >= 50) AS regulated_in FROM s""".replace("arg_min(contrast, (round(-abs(stat), 9), contrast))", "arg_min(contrast, round(-abs(stat), 9) * 100000 + contrast)"))
def training_response(spark, sf):
    d = settle(_da(spark, sf).where("layer = 'O'"))
    s = d.groupBy("gene", "sex").agg(
        F.round(F.max(F.abs("stat")), 6).alias("top_effect"),
        F.min_by("contrast", F.round(-F.abs("stat"), 9) * 100000 + F.col("contrast")).alias("top_contrast"),
        F.count_if(F.col("padj") < 0.4).alias("n_sig"))
    bg = d.groupBy("sex").agg(F.round(F.avg((F.col("padj") < 0.4).cast("int")), 6).alias("background"))
    reg = (lines_k(spark, sf).where("quantity >= 50").groupBy(F.col("feature_id").alias("gene"))
           .agg(F.concat_ws(";", F.array_sort(F.collect_set("flag"))).alias("regulated_in")))
    return s.join(bg, "sex").join(reg, "gene", "left")


@query("panel_overlap", "J18", f"""WITH {K_LINES}, a AS (SELECT feature_id AS gene, arg_max(flag, q) AS marker FROM (SELECT feature_id, flag, sum(quantity) AS q FROM lines WHERE status = 'O' GROUP BY ALL) GROUP BY 1 HAVING max(q) > (SELECT avg(q) FROM (SELECT feature_id, flag, sum(quantity) AS q FROM lines WHERE status = 'O' GROUP BY ALL))),
b AS (SELECT feature_id AS gene, arg_max(flag, q) AS marker FROM (SELECT feature_id, flag, sum(quantity) AS q FROM lines WHERE status = 'F' GROUP BY ALL) GROUP BY 1 HAVING max(q) > (SELECT avg(q) FROM (SELECT feature_id, flag, sum(quantity) AS q FROM lines WHERE status = 'F' GROUP BY ALL)))
SELECT coalesce(a.gene, b.gene) AS gene, a.gene IS NOT NULL AS in_a, b.gene IS NOT NULL AS in_b, a.marker AS marker_a, b.marker AS marker_b, coalesce(a.marker = b.marker, false) AS same_marker FROM a FULL JOIN b ON a.gene = b.gene""")
def panel_overlap(spark, sf):
    li = lines_k(spark, sf)

    def side(s):
        q = settle(li.where(F.col("status") == s).groupBy(F.col("feature_id").alias("gene"), "flag").agg(F.sum("quantity").alias("q")))
        return q.groupBy("gene").agg(F.max_by("flag", "q").alias("marker"), F.max("q").alias("m")).where(F.col("m") > q.agg(F.avg("q")).scalar()).drop("m")
    a, b = side("O").withColumnRenamed("marker", "marker_a").withColumn("ia", F.lit(True)), side("F").withColumnRenamed("marker", "marker_b").withColumn("ib", F.lit(True))
    return a.join(b, "gene", "full_outer").select("gene", F.coalesce("ia", F.lit(False)).alias("in_a"), F.coalesce("ib", F.lit(False)).alias("in_b"),
                                                  "marker_a", "marker_b", F.coalesce(F.col("marker_a") == F.col("marker_b"), F.lit(False)).alias("same_marker"))


@query("truncated_id_match", "J19", f"""WITH {K_LINES}, a AS (SELECT DISTINCT sample_id AS sa, specimen_id AS k FROM lines WHERE status = 'O'), b AS (SELECT DISTINCT specimen_id || '-x' || (yr % 2) AS sb, specimen_id AS k FROM lines WHERE status = 'F')
SELECT k AS pair_key, count(DISTINCT sa) AS n_a, count(DISTINCT sb) AS n_b FROM a JOIN b USING (k) GROUP BY k""")
def truncated_id_match(spark, sf):
    li = lines_k(spark, sf)
    key = lambda c: F.concat_ws("-", F.slice(F.split(c, "-"), 1, 2))
    a = li.where("status = 'O'").groupBy(key("sample_id").alias("pair_key")).agg(F.count_distinct("sample_id").alias("n_a"))
    b = li.where("status = 'F'").select(F.concat(F.col("specimen_id"), F.lit("-x"), F.col("yr") % 2).alias("sb")).groupBy(
        key("sb").alias("pair_key")).agg(F.count_distinct("sb").alias("n_b"))
    return a.join(b, "pair_key")


@query("same_level_pairs", "J22", """WITH w AS (SELECT user_id AS group_id, event_type AS class, min(hour(ts)) AS idx FROM events GROUP BY ALL)
SELECT a.class AS class_a, b.class AS class_b, count(*) AS n_groups, round(avg((a.idx = b.idx)::INT), 6) AS same_share FROM w a JOIN w b ON a.group_id = b.group_id AND a.class < b.class GROUP BY ALL""")
def same_level_pairs(spark, sf):
    # reduced to one row per (individual, class) first; an individual then holds at most one entry per class
    w = events_e(spark, sf).groupBy("group_id", "class").agg(F.min("hour").alias("idx"))
    s = w.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("class", "idx"))).alias("s"))
    left = s.select("s", F.posexplode("s").alias("i", "a"))
    p = left.select("a", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("b"))
    return p.groupBy(F.col("a.class").alias("class_a"), F.col("b.class").alias("class_b")).agg(
        F.count(F.lit(1)).alias("n_groups"), F.round(F.avg((F.col("a.idx") == F.col("b.idx")).cast("int")), 6).alias("same_share"))


# ---- inventories, design tables ---------------------------------------------------------------------------------
@query("inventory", "A23 J10", f"""WITH {K_COUNTS} SELECT class, count(DISTINCT sample_id) AS n_samples, count(DISTINCT group_id) AS n_groups, count(DISTINCT feature_id) AS n_features,
  round(1 - count(*) / (count(DISTINCT sample_id) * count(DISTINCT feature_id)), 6) AS absent_share FROM counts GROUP BY GROUPING SETS ((), (class))""")
def inventory(spark, sf):
    c = counts_k(spark, sf)
    n = F.count_distinct("sample_id") * F.count_distinct("feature_id")
    return c.groupingSets([[], [F.col("class")]], "class").agg(
        F.count_distinct("sample_id").alias("n_samples"), F.count_distinct("group_id").alias("n_groups"),
        F.count_distinct("feature_id").alias("n_features"), F.round(1 - F.count(F.lit(1)) / n, 6).alias("absent_share"))


@query("class_assay_presence", "A23", f"""WITH {K_LINES} SELECT class, count(DISTINCT group_id) FILTER (WHERE flag = 'A') AS "A", count(DISTINCT group_id) FILTER (WHERE flag = 'N') AS "N", count(DISTINCT group_id) FILTER (WHERE flag = 'R') AS "R"
FROM lines JOIN cls USING (group_id) WHERE yr = 1995 AND feature_id = 'Brand#1' GROUP BY class""")
def class_assay_presence(spark, sf):
    li = lines_k(spark, sf).where("yr = 1995 AND feature_id = 'Brand#1'").join(supplier_class(spark, sf), "group_id")
    p = li.select("class", "flag", "group_id").distinct().groupBy("class").pivot("flag", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    return p.na.fill(0)


@query("design_grouping_sets", "A24 F5", f"""WITH {O_ROWS} SELECT segment, class, count(*) AS n, count(DISTINCT group_id) AS n_groups, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(DISTINCT day) AS n_days,
  date_diff('day', min(day), max(day)) AS span_days FROM ord GROUP BY GROUPING SETS ((segment, class), (segment))""")
def design_grouping_sets(spark, sf):
    o = orders_o(spark, sf)
    return o.groupingSets([[F.col("segment"), F.col("class")], [F.col("segment")]], "segment", "class").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("n_groups"), F.min("day").cast("string").alias("first_day"),
        F.max("day").cast("string").alias("last_day"), F.count_distinct("day").alias("n_days"), F.datediff(F.max("day"), F.min("day")).alias("span_days"))


@query("design_contrasts", "A24", f"""WITH {O_ROWS}, p AS (SELECT status, class, day, yr FROM ord UNION ALL SELECT 'pooled', class, day, yr FROM ord),
m AS (SELECT status, class, quantile_cont(date_diff('day', DATE '1970-01-01', day), 0.5) AS med, count(*) AS n, list_sort(list(DISTINCT yr)) AS ys FROM p GROUP BY ALL)
SELECT a.status, a.class, a.n, c.n AS n_control, round(a.med - c.med, 6) AS gap_days, a.ys = c.ys AS same_cohort FROM m a JOIN m c USING (status) WHERE a.class <> '1-URGENT' AND c.class = '1-URGENT'""")
def design_contrasts(spark, sf):
    o = orders_o(spark, sf).select(F.explode(F.array("status", F.lit("pooled"))).alias("status"), "class", F.unix_date("day").alias("d"), "yr")
    med = exact_quantiles(o, ["status", "class"], "d", {"med": 0.5})
    ys = o.groupBy("status", "class").agg(F.array_sort(F.collect_set("yr")).alias("ys"))
    m = settle(med.join(ys, ["status", "class"]))
    c = m.where("class = '1-URGENT'").select("status", F.col("med").alias("cm"), F.col("n").alias("n_control"), F.col("ys").alias("cy"))
    return m.where("class <> '1-URGENT'").join(c, "status").select(
        "status", "class", "n", "n_control", F.round(F.col("med") - F.col("cm"), 6).alias("gap_days"), (F.col("ys") == F.col("cy")).alias("same_cohort"))


@query("quantile_table", "A25", f"""WITH {O_ROWS}, p AS (SELECT variable, value, class, seg FROM (SELECT class, unnest([segment, 'all']) AS seg, price, balance FROM ord) UNPIVOT (value FOR variable IN (price, balance)))
SELECT variable, class, seg AS segment, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM p GROUP BY ALL""")
def quantile_table(spark, sf):
    o = orders_o(spark, sf).select("class", F.explode(F.array("segment", F.lit("all"))).alias("segment"), "price", "balance")
    x = o.unpivot(["class", "segment"], ["price", "balance"], "variable", "value")
    q = exact_quantiles(x, ["variable", "class", "segment"], "value", {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return q.select("variable", "class", "segment", "n", *[F.round(c, 6).alias(c) for c in ("median", "q25", "q75")])


@query("variable_level", "A31", f"""WITH {O_ROWS}, c AS (SELECT group_id, count(DISTINCT status) AS status, count(DISTINCT segment) AS segment, count(DISTINCT nation) AS nation, count(DISTINCT class) AS class FROM ord GROUP BY group_id)
SELECT variable, CASE WHEN max(d) <= 1 THEN 'individual' ELSE 'sample' END AS level, max(d) AS max_levels FROM c UNPIVOT (d FOR variable IN (status, segment, nation, class)) GROUP BY variable""")
def variable_level(spark, sf):
    o = orders_o(spark, sf).unpivot(["group_id"], ["status", "segment", "nation", "class"], "variable", "level")
    d = o.groupBy("variable", "group_id").agg(F.count_distinct("level").alias("d"))
    return d.groupBy("variable").agg(F.when(F.max("d") <= 1, "individual").otherwise("sample").alias("level"), F.max("d").alias("max_levels"))


@query("sign_consistency", "A32 W5", f"""WITH {E_ROWS}, r AS (SELECT class, hour % 4 AS cell, rank() OVER w + (count(*) OVER (PARTITION BY class, hour % 4, value) - 1) / 2.0 AS rv, rank() OVER w2 + (count(*) OVER (PARTITION BY class, hour % 4, k) - 1) / 2.0 AS rk FROM ev
  WINDOW w AS (PARTITION BY class, hour % 4 ORDER BY value), w2 AS (PARTITION BY class, hour % 4 ORDER BY k)), c AS (SELECT class, cell, corr(rv, rk) AS rho, count(*) AS n FROM r GROUP BY ALL)
SELECT class, count(*) AS n_cells, round(quantile_cont(rho, 0.5), 6) AS median_rho, count(*) FILTER (WHERE rho > 0) AS n_positive, count(*) FILTER (WHERE n >= 3 AND """ + t_two_sided_sql("rho * sqrt((n - 2) / (1 - rho * rho))", "(n - 2)") + """ < 0.05) AS n_p05 FROM c GROUP BY class""")
def sign_consistency(spark, sf):
    e = events_e(spark, sf).select("class", (F.col("hour") % 4).alias("cell"), "value", "k", "sample_id")
    r = average_ranks(e, ["class", "cell"], "value", "rv").drop("n_total")
    r = average_ranks(r, ["class", "cell"], "k", "rk")
    c = r.groupBy("class", "cell").agg(F.corr("rv", "rk").alias("rho"), F.count(F.lit(1)).alias("n")).withColumn("p", correlation_p(F.col("rho"), F.col("n")))
    return c.groupBy("class").agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.percentile("rho", F.lit(0.5)), 6).alias("median_rho"),
                                  F.count_if(F.col("rho") > 0).alias("n_positive"), F.count_if(F.col("p") < 0.05).alias("n_p05"))


@query("percent_rank", "W6 W10", f"""WITH {E_ROWS} SELECT sample_id, class, round((rank() OVER (PARTITION BY class ORDER BY value) + (count(*) OVER (PARTITION BY class, value) - 1) / 2.0) / count(*) OVER (PARTITION BY class), 6) AS pct,
  hour - min(hour) OVER (PARTITION BY class) + 1 AS relative_hour FROM ev""")
def percent_rank(spark, sf):
    e = events_e(spark, sf).select("sample_id", "class", "value", "hour")
    first = e.groupBy("class").agg(F.min("hour").alias("h0"))
    r = average_ranks(e, ["class"], "value").join(checked_broadcast(settle(first)), "class")
    return r.select("sample_id", "class", F.round(F.col("avg_rank") / F.col("n_total"), 6).alias("pct"), (F.col("hour") - F.col("h0") + 1).alias("relative_hour"))


@query("profile_shapes", "W14 M21", f"""WITH {O_ROWS}, p AS (SELECT segment, class, region, yr, round(avg(price), 6) AS v FROM ord GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY segment, class, region ORDER BY yr) AS ro, rank() OVER (PARTITION BY segment, class, region ORDER BY v) + (count(*) OVER (PARTITION BY segment, class, region, v) - 1) / 2.0 AS rv FROM p),
s AS (SELECT segment, class, region, round(CASE WHEN max(v) > min(v) THEN corr(ro, rv) ELSE 0 END, 6) AS rho, arg_min(v, yr) AS f, arg_max(v, yr) AS l, min(v) AS lo, max(v) AS hi FROM r GROUP BY ALL)
SELECT segment, class, region, rho, CASE WHEN rho >= 0.8 AND l - f > 2000 THEN 'INCREASING' WHEN l = lo AND f - l > 2000 THEN 'DECREASING' WHEN hi - lo <= 2000 THEN 'FLAT' ELSE 'NON-MONOTONE' END AS shape FROM s""")
def profile_shapes(spark, sf):
    p = orders_o(spark, sf).groupBy("segment", "class", "region", "yr").agg(F.round(F.avg("price"), 6).alias("v"))
    return A.classify_profile(p, ["segment", "class", "region"], "yr", "v", 2000.0)


@query("parsed_cells", "F5 F6 F7", """WITH e AS (SELECT event_id, ts, CASE event_id % 6 WHEN 0 THEN ' NA ' WHEN 1 THEN '-' WHEN 2 THEN '' ELSE value::VARCHAR END AS cell, chr((65 + event_id % 10)::INT) || (event_id % 12 + 1) AS well FROM events)
SELECT event_id, CASE WHEN event_id % 6 <= 2 THEN NULL ELSE round(cell::DOUBLE, 6) END AS number, CASE WHEN event_id % 10 < 8 THEN (event_id % 10 + 1)::INT ELSE -1 END AS well_row, CASE WHEN event_id % 10 < 8 THEN (event_id % 12 + 1)::INT ELSE -1 END AS well_col,
  round(hour(ts) + minute(ts) / 60.0, 6) AS hours, date_diff('day', DATE '2018-01-01', ts::DATE) AS days FROM e""")
def parsed_cells(spark, sf):
    from ..functions.text import number_cell
    i = F.col("event_id")
    e = table(spark, sf, "events").select(
        i, F.when(i % 6 == 0, " NA ").when(i % 6 == 1, "-").when(i % 6 == 2, "").otherwise(F.col("value").cast("string")).alias("cell"),
        F.concat(F.char(F.lit(65) + i % 10), (i % 12 + 1).cast("string")).alias("well"), F.date_format("ts", "H:mm").alias("clock"),
        F.date_format("ts", "ddMMMyyyy").alias("day"))
    row, col = well_position("well")
    return e.select("event_id", F.round(number_cell("cell"), 6).alias("number"), F.coalesce(row, F.lit(-1)).alias("well_row"), F.coalesce(col, F.lit(-1)).alias("well_col"),
                    F.round(clock_hours("clock"), 6).alias("hours"), F.datediff(any_date("day"), F.lit("2018-01-01").cast("date")).alias("days"))
