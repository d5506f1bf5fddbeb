"""Claim checks, contributions, submissions and file sources."""

from pyspark.sql import functions as F

from ..functions.ranking import in_order
from ..models import centroid as N
from ..operators import claims as L
from ..operators import conformal as C
from ..operators import matrices as X
from ..operators.resample import random_pairs
from ..session import scratch_path, settle
from ..sources import metadata, sinks, submissions, wide
from ..sources.differential import unify_differential
from .calibrating import ALPHAS, BASE, CALLS, INF, MARG, scored, sets_sql, test_sets
from .lenses import K_LINES, V_SAMPLES, lines_k, samples_v, supplier_class, table, u_sql
from .registry import query

# names accepted for each class of lens V, and names covering several classes
NAMES = [(f"c{i}", [f"c{i}"]) for i in range(10)] + [(f"class {i}", [f"c{i}"]) for i in range(10)] + [
    ("low group", ["c0", "c1", "c2"]), ("high group", ["c8", "c9"])]

CLAIM = """,
lb AS (SELECT sample_id, batch, class, CASE WHEN v % 11 = 0 THEN ' NA ' WHEN v % 13 = 0 THEN 'Somewhere else' WHEN v % 7 = 0 THEN 'Class_' || ((l + 1) % 10) WHEN v % 5 = 0 AND l <= 2 THEN 'Low-Group tissue' WHEN v % 3 = 0 THEN 'Class ' || l || 's' ELSE upper(class) END AS label,
   CASE WHEN v % 11 = 0 THEN 'none' WHEN v % 13 = 0 THEN 'not_in_reference' WHEN v % 7 = 0 THEN 'class' WHEN v % 5 = 0 AND l <= 2 THEN 'superclass' ELSE 'class' END AS claim_kind,
   CASE WHEN v % 11 = 0 OR v % 13 = 0 THEN []::VARCHAR[] WHEN v % 7 = 0 THEN ['c' || ((l + 1) % 10)] WHEN v % 5 = 0 AND l <= 2 THEN ['c0', 'c1', 'c2'] ELSE [class] END AS claimed FROM (
   SELECT *, substr(sample_id, 2)::INT AS v, substr(class, 2)::INT AS l FROM smp))"""
CHECK = """,
ck AS (SELECT st.*, lb.batch, lb.claimed, lb.claim_kind, CASE WHEN set_size = 0 THEN 'Unknown' WHEN set_size = 1 THEN 'Confident' ELSE 'Ambiguous' END AS status,
  CASE WHEN claim_kind = 'none' THEN NULL WHEN claim_kind = 'not_in_reference' THEN 'Not in reference' WHEN set_size = 0 THEN 'Can''t confirm' WHEN list_has_any(members, claimed) THEN 'Consistent' ELSE 'Mismatch' END AS claim_status FROM st JOIN lb USING (sample_id)),
ckp AS (SELECT *, CASE coalesce(claim_status, '') WHEN 'Mismatch' THEN 0 WHEN 'Can''t confirm' THEN 1 WHEN 'Not in reference' THEN 2 ELSE CASE status WHEN 'Unknown' THEN 3 WHEN 'Ambiguous' THEN 4 ELSE 5 END END AS priority,
  coalesce(claim_status IN ('Mismatch', 'Can''t confirm', 'Not in reference'), false) OR status = 'Unknown' AS flagged FROM ck)"""


def _labels(spark, sf):
    s = samples_v(spark, sf)
    v, c = F.substring("sample_id", 2, 20).cast("int"), F.substring("class", 2, 5).cast("int")
    label = (F.when(v % 11 == 0, " NA ").when(v % 13 == 0, "Somewhere else")
             .when(v % 7 == 0, F.concat(F.lit("Class_"), (c + 1) % 10)).when((v % 5 == 0) & (c <= 2), "Low-Group tissue")
             .when(v % 3 == 0, F.concat(F.lit("Class "), c, F.lit("s"))).otherwise(F.upper("class")))
    return s.select("sample_id", "batch", label.alias("label"))


def _claims(spark, sf):
    return L.map_claims(_labels(spark, sf), spark.createDataFrame(NAMES, "name string, classes array<string>"))


def _checked(spark, sf, alphas=(0.1,)):
    probs, scores = scored(spark, sf)
    sets = test_sets(probs, C.thresholds(scores, ["fold"], list(alphas)))
    return L.check_samples(sets, _claims(spark, sf), ["sample_id"])


@query("map_claims", "C12 F3 F4 F9", f"WITH {V_SAMPLES}{CLAIM} SELECT sample_id, claim_kind, array_to_string(claimed, ';') AS claimed FROM lb")
def map_claims(spark, sf):
    return _claims(spark, sf).select("sample_id", "claim_kind", F.concat_ws(";", "claimed").alias("claimed"))


@query("claim_status", "C12 F8", BASE + MARG + sets_sql("th", "fold") + CLAIM + CHECK + " SELECT sample_id, set_size::INT AS set_size, status, coalesce(claim_status, '') AS claim_status, flagged FROM ckp WHERE alpha = 0.1")
def claim_status(spark, sf):
    return _checked(spark, sf).select("sample_id", "set_size", "status", F.coalesce("claim_status", F.lit("")).alias("claim_status"), "flagged")


@query("status_counts", "C12", BASE + MARG + sets_sql("th", "fold") + CLAIM + CHECK + """
SELECT batch, name, count(*) AS n FROM (SELECT batch, unnest([status, claim_status, CASE WHEN flagged THEN 'flagged' END, 'total', CASE WHEN claim_status IS NOT NULL THEN 'claimed' END]) AS name FROM ckp WHERE alpha = 0.1) WHERE name IS NOT NULL GROUP BY ALL""")
def status_counts(spark, sf):
    return L.status_counts(_checked(spark, sf), ["batch"])


@query("priority_order", "W12", BASE + MARG + sets_sql("th", "fold") + CLAIM + CHECK + """
SELECT sample_id, priority, row_number() OVER (ORDER BY priority, sample_id) AS position FROM ckp WHERE alpha = 0.1""")
def priority_order(spark, sf):
    ordered = in_order(_checked(spark, sf).select("sample_id", "priority"), ["priority", "sample_id"], "position")
    return ordered.withColumn("position", (F.col("position") + 1).cast("int"))


@query("flag_rates", "C15", BASE + MARG + sets_sql("th", "fold") + CLAIM + CHECK + """
SELECT alpha, count(*) AS n, round(avg((claim_status = 'Consistent')::INT), 6) AS consistent_rate, round(avg((claim_status = 'Mismatch')::INT), 6) AS mismatch_rate, round(avg((claim_status = 'Can''t confirm')::INT), 6) AS cant_confirm_rate
FROM ckp WHERE claim_status IS NOT NULL GROUP BY alpha""")
def flag_rates(spark, sf):
    return L.flag_rates(_checked(spark, sf, ALPHAS), ["alpha"])


@query("swap_detection", "J21 C15", BASE + MARG + sets_sql("th", "fold") + f""",
si AS (SELECT sample_id, row_number() OVER (ORDER BY {u_sql(81, 'sample_id')}, sample_id) - 1 AS idx, count(*) OVER () AS n FROM smp),
dr AS (SELECT d.pair, floor({u_sql('81i', 'd.pair')} * n)::BIGINT AS ia, (floor({u_sql('81i', 'd.pair')} * n) + 1 + floor({u_sql('81j', 'd.pair')} * (n - 1)))::BIGINT % n AS ib FROM range(300) d(pair), (SELECT max(n) AS n FROM si)),
j AS (SELECT a.alpha, (a.set_size > 0 AND NOT list_contains(a.members, b.class))::INT AS ma, (b.set_size > 0 AND NOT list_contains(b.members, a.class))::INT AS mb, (a.set_size = 0)::INT + (b.set_size = 0)::INT AS cc
  FROM dr JOIN si x ON x.idx = ia JOIN si y ON y.idx = ib JOIN st a ON a.sample_id = x.sample_id JOIN st b ON b.sample_id = y.sample_id AND b.alpha = a.alpha WHERE a.class <> b.class)
SELECT alpha, count(*) AS n_swaps, round(avg((ma + mb) / 2), 6) AS sample_detection_rate, round(avg(greatest(ma, mb)), 6) AS pair_detection_rate, round(avg(ma * mb), 6) AS both_flagged_rate, round(avg(cc / 2), 6) AS cant_confirm_rate FROM j GROUP BY alpha""")
def swap_detection(spark, sf):
    probs, scores = scored(spark, sf)
    sets = settle(test_sets(probs, C.thresholds(scores, ["fold"], ALPHAS)).withColumnRenamed("class", "label"))
    pairs = random_pairs(samples_v(spark, sf), "sample_id", 300, 81)
    return L.swap_detection(pairs, sets, ["alpha"])


@query("scaling_choice", "C13", BASE + CALLS + CLAIM + """,
s AS (SELECT batch, claim_kind, count(DISTINCT sample_id) AS n_samples, greatest(count(DISTINCT CASE WHEN claim_kind IN ('class', 'superclass') THEN array_to_string(claimed, '|') END), count(DISTINCT call)) AS n_classes FROM calls JOIN lb USING (sample_id) GROUP BY GROUPING SETS ((batch), (batch, claim_kind)))
SELECT batch, claim_kind, n_samples, n_classes, CASE WHEN n_samples >= 8 AND n_classes >= 3 THEN 'within' ELSE 'reference' END AS mode FROM s""")
def scaling_choice(spark, sf):
    probs, _ = scored(spark, sf)
    calls = N.top_two(probs.where("role = 'test'"), ["sample_id"])
    return L.choose_scaling(calls.join(_claims(spark, sf), "sample_id"), ["batch"], parts=["claim_kind"])


@query("claim_recalibration", "C14", BASE + CLAIM + f""",
lbd AS (SELECT p.sample_id, batch, round(1 - p, 9) AS score FROM probs p JOIN lb USING (sample_id) WHERE role = 'test' AND claim_kind = 'class' AND candidate = claimed[1] AND substr(p.sample_id, 2)::INT % 7 <> 0)
SELECT batch, n AS n_labelled, coalesce(max(CASE WHEN rn = greatest(1, ceil((n + 1) * 0.9 - 1e-9)) THEN score END), {INF}) AS q, n >= 9 AS enough FROM (
  SELECT batch, score, row_number() OVER (PARTITION BY batch ORDER BY score) AS rn, count(*) OVER (PARTITION BY batch) AS n FROM lbd) GROUP BY batch, n""")
def claim_recalibration(spark, sf):
    claims = _claims(spark, sf)
    wrong = claims.where(F.substring("sample_id", 2, 20).cast("int") % 7 == 0).select("sample_id")
    lab = L.labelled_for_recalibration(claims, wrong).join(claims.select("sample_id", "batch"), "sample_id")
    probs, _ = scored(spark, sf)
    s = C.lac_scores(probs.where("role = 'test'").drop("class").join(lab, "sample_id"))
    return C.thresholds(s, ["batch"], [0.1]).select("batch", F.col("n_cal").alias("n_labelled"), "q",
                                                    (F.col("n_cal") >= L.min_labelled(0.1)).alias("enough"))


@query("case_audit", "C17", BASE + MARG + sets_sql("th", "fold") + CALLS + """
SELECT sex = 'male' AS flagged, count(*) AS n, count(*) FILTER (WHERE call = 'c2') AS n_called_other, count(*) FILTER (WHERE set_size > 0 AND list_contains(members, 'c1')) AS n_consistent,
  count(*) FILTER (WHERE set_size > 0 AND NOT list_contains(members, 'c1')) AS n_mismatch, count(*) FILTER (WHERE set_size = 0) AS n_cant_confirm FROM st JOIN calls USING (fold, sample_id) JOIN smp USING (sample_id) WHERE alpha = 0.1 AND smp.class = 'c1' GROUP BY 1""")
def case_audit(spark, sf):
    probs, scores = scored(spark, sf)
    one = probs.where("class = 'c1'")
    sets = test_sets(one, C.thresholds(scores, ["fold"], [0.1])).join(N.top_two(one.where("role = 'test'"), ["sample_id"]), "sample_id")
    own = F.array_contains("members", "c1")
    return sets.join(samples_v(spark, sf).select("sample_id", (F.col("sex") == "male").alias("flagged")), "sample_id").groupBy("flagged").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("call") == "c2").alias("n_called_other"), F.count_if(own).alias("n_consistent"),
        F.count_if(~own & (F.col("set_size") > 0)).alias("n_mismatch"), F.count_if(F.col("set_size") == 0).alias("n_cant_confirm"))


# ---- stored coefficients: logits, contributions, drivers ----------------------------------------------------------
LIN = """,
fx AS (SELECT sample_id, class, 'f' || lpad(i::VARCHAR, 2, '0') AS feature_id, x::DOUBLE AS value FROM (SELECT *, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM smp)),
st0 AS (SELECT feature_id, avg(value) AS m, stddev_pop(value) AS sd FROM fx GROUP BY ALL), z AS (SELECT sample_id, feature_id, (value - m) / sd AS z FROM fx JOIN st0 USING (feature_id)),
co AS (SELECT class AS candidate, feature_id, avg((value - m) / sd) AS w FROM fx JOIN st0 USING (feature_id) GROUP BY ALL), b AS (SELECT candidate, -sum(w * w) / 2 AS b FROM co GROUP BY ALL),
lg AS (SELECT sample_id, candidate, sum(z * w) + any_value(b) AS logit FROM z JOIN co USING (feature_id) JOIN b USING (candidate) GROUP BY ALL),
pe AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY sample_id)) AS e FROM lg), pp AS (SELECT sample_id, candidate, round(e / sum(e) OVER (PARTITION BY sample_id), 9) AS p FROM pe),
tp AS (SELECT sample_id, max(candidate) FILTER (WHERE r = 1) AS call, max(p) FILTER (WHERE r = 1) AS call_p, max(candidate) FILTER (WHERE r = 2) AS runner_up, max(p) FILTER (WHERE r = 2) AS runner_up_p FROM (
   SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC, candidate) AS r FROM pp) GROUP BY sample_id),
df AS (SELECT sample_id, feature_id, call, runner_up, round(max(z * w) FILTER (WHERE candidate = call) - max(z * w) FILTER (WHERE candidate = runner_up), 9) AS diff FROM z JOIN co USING (feature_id) JOIN tp USING (sample_id) GROUP BY ALL)"""


def _linear(spark, sf):
    """A stored linear model of lens V (20 features): standardised values, coefficients, intercepts."""
    from .lenses import fact_v
    f = fact_v(spark, sf)
    scale = settle(X.feature_scale(f, ["feature_id"]))
    z = X.zscore(f, scale, ["feature_id"]).select("sample_id", "class", "feature_id", "value")
    coef = settle(z.groupBy(F.col("class").alias("candidate"), "feature_id").agg(F.avg("value").alias("w")))
    return z, coef, coef.groupBy("candidate").agg((-F.sum(F.col("w") ** 2) / 2).alias("b")), scale


@query("coefficient_scores", "M16", f"WITH {V_SAMPLES}{LIN} SELECT sample_id, call, call_p, runner_up, runner_up_p FROM tp")
def coefficient_scores(spark, sf):
    z, coef, b, _ = _linear(spark, sf)
    p = N.linear_logits(z, coef, b, ["sample_id"]).transform(C.softmax_over(["sample_id"], "logit"))
    return N.top_two(p, ["sample_id"])


@query("contributions", "M17", f"WITH {V_SAMPLES}{LIN} SELECT candidate, feature_id, round(avg(z * w), 6) AS mean_term, round(max(z * w), 6) AS max_term FROM z JOIN co USING (feature_id) GROUP BY ALL")
def contributions(spark, sf):
    z, coef, _, _ = _linear(spark, sf)
    return N.contributions(z, coef, ["sample_id"]).groupBy("candidate", "feature_id").agg(
        F.round(F.avg("term"), 6).alias("mean_term"), F.round(F.max("term"), 6).alias("max_term"))


def _why(spark, sf):
    z, coef, b, _ = _linear(spark, sf)
    p = N.linear_logits(z, coef, b, ["sample_id"]).transform(C.softmax_over(["sample_id"], "logit"))
    pairs = N.top_two(p, ["sample_id"]).select("sample_id", "call", "runner_up")
    return N.contrast(N.contributions(z, coef, ["sample_id"]), pairs, ["sample_id"]).withColumn("diff", F.round("diff", 9))


@query("why_x_not_y", "M17", f"WITH {V_SAMPLES}{LIN} SELECT sample_id, feature_id, call, runner_up, round(diff, 5) AS diff FROM df")
def why_x_not_y(spark, sf):
    return _why(spark, sf).withColumn("diff", F.round("diff", 5))


@query("driver_features", "W11", f"WITH {V_SAMPLES}{LIN}" + """ SELECT sample_id, feature_id, round(diff, 6) AS diff, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY diff DESC, feature_id) AS rank, max(diff) OVER (PARTITION BY sample_id) AS top FROM df WHERE diff > 0) WHERE diff >= greatest(0.1, 0.1 * top) AND rank <= 3""")
def driver_features(spark, sf):
    return L.drivers(_why(spark, sf), ["sample_id"]).select("sample_id", "feature_id", F.round("diff", 6).alias("diff"), "rank")


@query("model_export", "S21", f"WITH {V_SAMPLES}{LIN} SELECT co.candidate, feature_id, round(w, 6) AS w, round(b, 6) AS b, round(m, 6) AS mean, round(sd, 6) AS sd FROM co JOIN b USING (candidate) JOIN st0 USING (feature_id)")
def model_export(spark, sf):
    _, coef, b, scale = _linear(spark, sf)
    t = sinks.read_scores(spark, sinks.write_model(spark, coef, b, scale))
    return t["model_coef"].join(t["model_intercept"], "candidate").join(t["model_scale"], "feature_id").select(
        "candidate", "feature_id", *[F.round(c, 6).alias(c) for c in ("w", "b", "mean", "sd")])


@query("ordered_union", "W13 P2", f"""WITH {V_SAMPLES}, l AS (SELECT batch, sample_id, row_number() OVER (PARTITION BY batch ORDER BY {u_sql(91, 'sample_id')}, sample_id) AS pos FROM smp),
f AS (SELECT 'f' || (substr(sample_id, 2)::INT % 40) AS feature_id, substr(batch, 2)::INT AS list_no, pos FROM l), m AS (SELECT feature_id, min(list_no * 1000000 + pos) AS o FROM f GROUP BY ALL)
SELECT row_number() OVER (ORDER BY o, feature_id) AS position, feature_id, (o // 1000000)::INT AS list_no FROM m ORDER BY o, feature_id LIMIT 25""")
def ordered_union(spark, sf):
    from ..functions.hashing import unit_hash
    from ..functions.ranking import in_order, dense_index
    s = samples_v(spark, sf).select("batch", "sample_id", unit_hash(91, "sample_id").alias("_u"))
    lists = dense_index(s, ["batch"], "_u", "sample_id").select(
        F.substring("batch", 2, 5).cast("int").alias("list_no"), (F.col("idx") + 1).alias("pos"),
        F.concat(F.lit("f"), F.substring("sample_id", 2, 20).cast("int") % 40).alias("feature_id"))
    return L.ordered_union(lists, 25)


# ---- metadata, differential tables, sinks -------------------------------------------------------------------------
@query("standard_metadata", "S4 F3 F4", """SELECT lpad(c_custkey::VARCHAR, 11, '0') AS sample_id, substr(lpad(c_custkey::VARCHAR, 11, '0'), 1, 5) AS specimen_id, 'p' || (c_custkey % 60) AS group_id,
  CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS sex, CASE WHEN c_custkey % 5 = 0 THEN 'control' ELSE (c_custkey % 5)::VARCHAR || 'w' END AS stage, c_mktsegment AS class_name FROM customer""")
def standard_metadata(spark, sf):
    k = F.col("c_custkey")
    raw = table(spark, sf, "customer").select(
        F.concat(F.lit(" "), F.lpad(k.cast("string"), 11, "0")).alias("viallabel"), F.concat(F.lit("p"), k % 60, F.lit(" ")).alias("pid"),
        F.when(k % 4 == 0, "1").when(k % 4 == 1, "M").when(k % 4 == 2, "f ").otherwise("male").alias("registration___sex"),
        F.when(k % 5 == 0, "control - 1w").otherwise(F.concat(F.lit("Training - "), k % 5, F.lit("w"))).alias("sacrificetime"),
        F.col("c_mktsegment").alias("specimen.processing.sampletypedescription"))
    return metadata.standard_metadata(raw.union(raw))


@query("unified_differential", "S8", f"""WITH {K_LINES} SELECT feature_id, CASE flag WHEN 'A' THEN 'male' ELSE 'female' END AS sex, yr::VARCHAR || 'w' AS contrast, count(*) AS n, round(avg(quantity) - 25.5, 6) AS stat, CASE WHEN flag = 'R' THEN NULL ELSE 0.05 END::DOUBLE AS padj FROM lines GROUP BY feature_id, flag, yr""")
def unified_differential(spark, sf):
    raw = lines_k(spark, sf).groupBy("feature_id", "flag", "yr").agg(F.count(F.lit(1)).alias("n"), (F.avg("quantity") - 25.5).alias("t"))
    raw = raw.select(F.col("feature_id").alias("feature_ID"), F.when(F.col("flag") == "A", " Male").otherwise("FEMALE").alias("sex"),
                     F.concat("yr", F.lit("W ")).alias("comparison_group"), "n", F.col("t").cast("string").alias("tscore"),
                     F.lit("0").alias("logFC"), F.when(F.col("flag") == "R", "NA").otherwise("0.05").alias("adj_p_value"))
    d = unify_differential(raw)
    return d.select(F.col("feature_ID").alias("feature_id"), "sex", F.col("comparison_group").alias("contrast"), "n", F.round("stat", 6).alias("stat"), "padj")


@query("safe_exports", "S19 F10 F11", f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN '''=' ELSE '' END || c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'inf' WHEN 1 THEN '-inf' ELSE 'finite' END AS shown FROM customer""")
def safe_exports(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    df = c.select(k.alias("id"), F.concat(F.when(k % 4 == 0, "=").otherwise(""), "c_name").alias("name"),
                  F.when(k % 3 == 0, float("inf")).when(k % 3 == 1, float("-inf")).otherwise(1.5).alias("x"))
    jpath, cpath = scratch_path(spark, "json"), scratch_path(spark, "csv")
    sinks.write_json(df, jpath)
    sinks.write_csv(df.select("id", "name"), cpath, compressed=True)
    back = spark.read.schema("id bigint, x string").json(jpath)
    names = spark.read.schema("id bigint, name string").option("header", True).csv(cpath)
    return names.join(back, "id").select("id", "name", F.when(F.col("x").isin("inf", "-inf"), F.col("x")).otherwise("finite").alias("shown"))


# ---- wide files ---------------------------------------------------------------------------------------------------
WIDE = f"""WITH {K_LINES}, w AS (SELECT class, feature_id, status || flag AS sample_id, sum(quantity) AS value FROM lines JOIN cls USING (group_id) GROUP BY ALL)"""
COLS = ["FA", "FN", "FR", "OA", "ON", "OR"]


def _wide_long(spark, sf):
    li = lines_k(spark, sf).join(supplier_class(spark, sf), "group_id")
    return settle(li.groupBy("class", "feature_id", F.concat("status", "flag").alias("sample_id")).agg(F.sum("quantity").alias("value")))


def _write_tables(spark, sf):
    """The count matrix of every region as one wide CSV table each, under the shared folder."""
    folder, long = scratch_path(spark, "wide"), _wide_long(spark, sf)
    for name in sorted(r["class"] for r in long.select("class").distinct().collect()):  # a file each: one row per region
        wide.write_wide(long.where(F.col("class") == name), f"{folder}/COUNTS__{name.replace(' ', '_')}.csv", COLS, 3)
    return folder


@query("table_catalogue", "S1", f"WITH {K_LINES} SELECT DISTINCT 'COUNTS' AS assay, class FROM lines JOIN cls USING (group_id)")
def table_catalogue(spark, sf):
    return wide.list_tables(spark, _write_tables(spark, sf)).select("assay", F.regexp_replace("class", "_", " ").alias("class")).distinct()


@query("wide_tables", "S2 S5 S18", WIDE + " SELECT 'COUNTS' AS assay, class, feature_id, sample_id, value FROM w")
def wide_tables(spark, sf):
    return wide.read_sample_tables(spark, _write_tables(spark, sf)).where("value IS NOT NULL").withColumn("class", F.regexp_replace("class", "_", " "))


@query("duplicate_features", "S3", """WITH p AS (SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) - 1 AS n, p_partkey FROM part)
SELECT p_partkey, p_type, p_brand || CASE WHEN n = 0 THEN '' ELSE '__dup' || n END AS feature_id FROM p""")
def duplicate_features(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type", F.col("p_brand").alias("feature_id"))
    return X.mark_duplicates(p, "feature_id", "p_partkey", ["p_type"])


@query("gct_columns", "S9", WIDE + " SELECT class, feature_id, sample_id, value FROM w WHERE sample_id IN ('FA', 'OR')")
def gct_columns(spark, sf):
    path = scratch_path(spark, "gct")
    wide.write_gct(_wide_long(spark, sf).withColumn("table", F.regexp_replace("class", " ", "_")), path, COLS, 6)
    wanted = spark.createDataFrame([("FA",), ("OR",)], "sample_id string")
    found = wide.read_gct(spark, path, wanted).where("value IS NOT NULL")
    return found.select(F.regexp_replace(F.regexp_extract("table", "table=([A-Z_]+)$", 1), "_", " ").alias("class"), "feature_id", "sample_id", "value")


@query("per_sample_files", "S13", f"WITH {K_LINES} SELECT flag AS sample_id, class, feature_id, sum(quantity) AS value FROM lines JOIN cls USING (group_id) GROUP BY ALL")
def per_sample_files(spark, sf):
    li = lines_k(spark, sf).join(supplier_class(spark, sf), "group_id")
    c = li.groupBy(F.concat_ws("__", "flag", F.regexp_replace("class", " ", "_")).alias("name"), "feature_id").agg(F.sum("quantity").alias("value"))
    path = scratch_path(spark, "small-files")
    c.select("feature_id", "value", "name").repartition("name").write.partitionBy("name").option("sep", "\t").csv(path)
    r = wide.read_per_sample_files(spark, path, r"name=([A-Z]+)__([A-Z_]+)/", ["sample_id", "class"])
    return r.withColumn("class", F.regexp_replace("class", "_", " "))


@query("external_cohort", "S10 S11 R10 A1", f"""WITH {K_LINES}, d AS (SELECT class, group_id, row_number() OVER (PARTITION BY class ORDER BY {u_sql(92, 'class', 'group_id')}, group_id) AS r FROM (SELECT DISTINCT class, group_id FROM lines JOIN cls USING (group_id))),
c AS (SELECT class, group_id, sample_id, feature_id, sum(quantity) AS v FROM lines JOIN d USING (group_id) WHERE r <= 5 GROUP BY ALL)
SELECT class, group_id, sample_id, feature_id, round(log2(1e6 * v / sum(v) OVER (PARTITION BY sample_id) + 1), 6) AS value FROM c""")
def external_cohort(spark, sf):
    from ..sources.external import prepare_cohort
    li = lines_k(spark, sf).join(supplier_class(spark, sf), "group_id")
    counts = li.groupBy("class", "group_id", "sample_id", "feature_id").agg(F.sum("quantity").alias("value"))
    return prepare_cohort(counts, 5, 92).select("class", "group_id", "sample_id", "feature_id", F.round("value", 6).alias("value"))


@query("metabolite_source", "S17 S16 F3", f"""WITH {K_LINES}, x AS (SELECT specimen_id AS sample_id, lower(regexp_replace(feature_id, '[^A-Za-z0-9]', '', 'g')) AS key, log2(sum(quantity) + 1) AS value FROM lines GROUP BY specimen_id, feature_id, ptype),
c AS (SELECT sample_id, key, value - quantile_cont(value, 0.5) OVER (PARTITION BY sample_id) AS value FROM x) SELECT sample_id, key AS feature_id, round(avg(value), 6) AS value FROM c GROUP BY ALL""")
def metabolite_source(spark, sf):
    from ..sources.external import centred_metabolites
    x = lines_k(spark, sf).groupBy(F.col("specimen_id").alias("sample_id"), F.col("feature_id").alias("name"), "ptype").agg(F.sum("quantity").alias("area"))
    return centred_metabolites(x).withColumn("value", F.round("value", 6))


# ---- submissions --------------------------------------------------------------------------------------------------
SUB = WIDE + """,
c AS (SELECT replace(class, ' ', '_') AS sub, sample_id, feature_id, CASE WHEN value % 10 = 0 THEN NULL ELSE value END AS value FROM w),
lib AS (SELECT sub, sample_id, coalesce(sum(value), 0) AS library, count(*) AS n_features, count(*) FILTER (WHERE value IS NULL) AS n_missing FROM c GROUP BY ALL)"""


#: The given tables have 25 features, so that a table of at least 21 is a count matrix here.
SUBMITTED_COUNTS = 21


def _submitted(spark, sf):
    """Write one text table per region (orientation and delimiter alternate) and ingest the folder in bulk."""
    long = _wide_long(spark, sf).withColumn("sub", F.regexp_replace("class", " ", "_"))
    long = long.withColumn("cell", F.when(F.col("value") % 10 == 0, "NA").otherwise(F.col("value").cast("string")))
    down = F.col("sub").isin("AFRICA", "ASIA", "MIDDLE_EAST")
    g = long.where(down).groupBy("sub", "feature_id").pivot("sample_id", COLS).agg(F.first("cell"))
    brands = [f"Brand#{i}" for i in range(1, 26)]
    s = long.where(~down).groupBy("sub", "sample_id").pivot("feature_id", brands).agg(F.first("cell"))
    text = lambda cols, sep: F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in cols])
    subs = long.select("sub", down.alias("d")).distinct()
    heads = subs.select("sub", F.lit(0).alias("o"), F.when(F.col("d"), ",".join(["gene", *COLS])).otherwise("\t".join(["sample", *brands, "__no_feature", "tissue"])).alias("line"))
    extra = subs.where("d").select("sub", F.lit(2).alias("o"), F.explode(F.array(F.lit("__no_feature" + ",7" * 6), F.lit("tissue" + ",Liver" * 6))).alias("line"))
    rows = g.select("sub", F.lit(1).alias("o"), text(["feature_id", *COLS], ",").alias("line")).unionByName(
        s.select("sub", F.lit(1).alias("o"), F.concat_ws("\t", text(["sample_id", *brands], "\t"), F.lit("7"), F.lit("Liver")).alias("line")))
    path = scratch_path(spark, "submissions")
    heads.unionByName(rows).unionByName(extra).repartition("sub").sortWithinPartitions("sub", "o", "line").select(
        "line", "sub").write.partitionBy("sub").text(path)
    panel = spark.createDataFrame([(b,) for b in brands[:20]], "feature_id string")
    cells = settle(submissions.read_cells(spark, path, panel))
    return submissions.long_rows(cells).withColumn("file", F.regexp_extract("file", r"sub=([A-Z_]+)/", 1)), panel


@query("submission_ingest", "S22 F7 A1", SUB + """
SELECT c.sub AS file, CASE WHEN c.sub IN ('AFRICA', 'ASIA', 'MIDDLE_EAST') THEN 'genes_x_samples' ELSE 'samples_x_genes' END AS orientation, c.sample_id, feature_id, round(CASE WHEN library > 0 THEN log2(1e6 * value / library + 1) END, 6) AS value, 'Liver' AS label
FROM c JOIN lib USING (sub, sample_id) WHERE substr(feature_id, 7)::INT <= 20""")
def submission_ingest(spark, sf):
    rows, panel = _submitted(spark, sf)
    v = submissions.panel_values(rows, panel, submissions.sample_libraries(rows), submissions.file_formats(rows, SUBMITTED_COUNTS))
    side = rows.groupBy("file").agg(F.first("orientation").alias("orientation"))
    return v.join(submissions.claimed_labels(rows), ["file", "sample_id"]).join(side, "file").select(
        "file", "orientation", "sample_id", "feature_id", F.round("value", 6).alias("value"), "label")


@query("dq_report", "P11 S22", SUB + """
SELECT sub AS file, 'counts' AS format, count(*) AS n_samples, max(n_features) AS n_features, sum(n_missing)::BIGINT AS n_missing, 0 AS n_negative, 0 AS n_fractional, 0 AS n_short, count(*) FILTER (WHERE library <= 0) AS n_empty_libraries,
  1 AS n_summary_rows, true AS few_features, 0 AS outside_log_range, 20 - (SELECT count(DISTINCT feature_id) FROM c WHERE c.sub = lib.sub AND value IS NOT NULL AND substr(feature_id, 7)::INT <= 20) AS n_panel_missing FROM lib GROUP BY sub""")
def dq_report(spark, sf):
    rows, panel = _submitted(spark, sf)
    formats = settle(submissions.file_formats(rows, SUBMITTED_COUNTS))
    v = submissions.panel_values(rows, panel, submissions.sample_libraries(rows), formats)
    return submissions.quality_report(rows, v, 20, formats)


@query("species_guess", "P12", """WITH i AS (SELECT c_nationkey % 5 AS set_no, CASE c_nationkey % 5 WHEN 0 THEN 'ENSG' || lpad(c_custkey::VARCHAR, 9, '0') WHEN 1 THEN 'ENSRNOG' || lpad(c_custkey::VARCHAR, 9, '0') WHEN 2 THEN 'GENE' || c_custkey WHEN 3 THEN 'Gene' || c_custkey ELSE c_custkey::VARCHAR END AS id FROM customer)
SELECT set_no, CASE set_no WHEN 0 THEN 'human' WHEN 1 THEN 'rat' WHEN 2 THEN 'human' WHEN 3 THEN 'rat or mouse' ELSE 'unknown' END AS species FROM i GROUP BY set_no""")
def species_guess(spark, sf):
    k, n = F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.col("c_nationkey") % 5
    ids = table(spark, sf, "customer").select(n.alias("set_no"), F.when(n == 0, F.concat(F.lit("ENSG"), k)).when(n == 1, F.concat(F.lit("ENSRNOG"), k))
        .when(n == 2, F.concat(F.lit("GENE"), "c_custkey")).when(n == 3, F.concat(F.lit("Gene"), "c_custkey")).otherwise(F.col("c_custkey").cast("string")).alias("id"))
    return submissions.guess_species(ids, ["set_no"], "id")
