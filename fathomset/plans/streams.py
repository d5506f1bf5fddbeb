"""Streaming scores and monitors, the metric ledger and table comparison (ST1–ST3, L1–L4)."""

from pyspark.sql import functions as F

from ..operators import ledger as G
from ..session import settle
from ..streaming import scoring as T
from ..streaming import submissions as U
from .claiming import LIN, _linear
from .lenses import E_ROWS, O_ROWS, V_SAMPLES, orders_o, table
from .registry import query


@query("stream_scores", "ST1 M16 C3 C12", f"WITH {V_SAMPLES}{LIN}" + """
SELECT tp.sample_id, smp.class, tp.call, tp.call_p, array_to_string(list_sort(list(candidate) FILTER (WHERE p >= 0.12)), ';') AS set_members, count(*) FILTER (WHERE p >= 0.12) AS set_size,
  CASE count(*) FILTER (WHERE p >= 0.12) WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Confident' ELSE 'Ambiguous' END AS status FROM tp JOIN pp USING (sample_id) JOIN smp USING (sample_id) GROUP BY tp.sample_id, smp.class, tp.call, tp.call_p""".replace("array_to_string(list_sort(list(candidate) FILTER (WHERE p >= 0.12)), ';')", "coalesce(array_to_string(list_sort(list(candidate) FILTER (WHERE p >= 0.12)), ';'), '')"))
def stream_scores(spark, sf):
    _, coef, b, scale = _linear(spark, sf)
    model = settle(T.model_row("v1", coef, b, scale, 0.88))
    s = T.parquet_stream(spark, sf, "embeddings").select(
        F.concat(F.lit("v"), "vec_id").alias("sample_id"), F.concat(F.lit("c"), "label").alias("class"), F.lit("v1").alias("model_id"), "embedding")
    out = T.run_to_files(T.score_vectors(s, model, "embedding", 64).drop("embedding", "model_id"), "scores")
    return out.select("sample_id", "class", "call", "call_p", F.concat_ws(";", "set_members").alias("set_members"), "set_size", "status")


@query("stream_submissions", "ST2 A5 C13", f"WITH {V_SAMPLES}{LIN}" + """,
sz AS (SELECT sample_id, batch AS submission_id, feature_id, CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END AS z FROM fx JOIN smp USING (sample_id) WINDOW w AS (PARTITION BY batch, feature_id)),
sl AS (SELECT submission_id, sample_id, candidate, sum(sz.z * w) + any_value(b) AS logit FROM sz JOIN co USING (feature_id) JOIN b USING (candidate) GROUP BY ALL),
se AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY submission_id, sample_id)) AS e FROM sl)
SELECT submission_id, sample_id, candidate, round(e / sum(e) OVER (PARTITION BY submission_id, sample_id), 9) AS p FROM se""")
def stream_submissions(spark, sf):
    """Samples arrive in several files, each submission spread over all of them, with an end marker in the last."""
    _, coef, b, _ = _linear(spark, sf)
    arriving = table(spark, sf, "embeddings").select(
        F.concat(F.lit("b"), F.col("vec_id") % 7).alias("submission_id"), F.concat(F.lit("v"), "vec_id").alias("sample_id"),
        F.timestamp_seconds("vec_id").alias("ts"), F.lit(False).alias("is_end"), F.lit(None).cast("int").alias("declared"), F.col("embedding").cast("array<double>").alias("vector"))
    ends = arriving.groupBy("submission_id").agg(F.count_distinct("sample_id").cast("int").alias("declared"), F.max("ts").alias("ts")).select(
        "submission_id", F.lit(None).cast("string").alias("sample_id"), "ts", F.lit(True).alias("is_end"), "declared", F.lit(None).cast("array<double>").alias("vector"))
    folder = U.arrive_in_order(arriving.unionByName(ends), "ts", 3)
    stream = spark.readStream.schema(U.ARRIVING).option("maxFilesPerTrigger", 1).parquet(folder)
    name = lambda i: F.concat(F.lit("f"), F.lpad(i.cast("string"), 2, "0"))
    return U.score_submissions(stream, coef, settle(b), name, "1 hour", "submissions")[0]


@query("coverage_monitor", "ST3 C5 C15", f"""WITH {E_ROWS} SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, class, count(*) AS n, round(avg((value <= 70)::INT), 6) AS coverage, round(avg((k >= 90)::INT), 6) AS flag_rate FROM ev GROUP BY ALL""")
def coverage_monitor(spark, sf):
    e = T.parquet_stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("class"), (F.col("value") <= 70).cast("double").alias("covered"),
        (F.from_json("props", "k INT")["k"] >= 90).cast("double").alias("flagged"))
    w = T.latest_by_batch(T.coverage_windows(e, "1 day", "2 hours"), ["window_start", "class"], "monitor")
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "class", "n", F.round("coverage", 6).alias("coverage"), F.round("flag_rate", 6).alias("flag_rate"))


@query("late_labels", "ST3", """WITH p AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'view'), l AS (SELECT user_id, ts AS lts, value AS lv FROM events WHERE event_type = 'purchase')
SELECT p.user_id, count(*) AS n_pairs, round(avg((abs(value - lv) < 40)::INT), 6) AS agreement FROM p JOIN l ON p.user_id = l.user_id AND lts >= ts AND lts <= ts + INTERVAL 6 HOURS GROUP BY p.user_id""")
def late_labels(spark, sf):
    ev = lambda: T.parquet_stream(spark, sf, "events")
    p = ev().where("event_type = 'view'").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    lab = ev().where("event_type = 'purchase'").select(F.col("user_id").alias("label_user_id"), F.col("ts").cast("timestamp").alias("label_ts"), F.col("value").alias("label_value"))
    j = T.run_to_files(T.join_late_labels(p, lab, ["user_id"], "6 HOURS", "1 hour"), "labels")
    return j.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg((F.abs(F.col("value") - F.col("label_value")) < 40).cast("int")), 6).alias("agreement"))


SPECS = [("mean_price_building", "segment = 'BUILDING' AND class = '1-URGENT'", "mean_price", "value", 1e-6),
         ("top_price", "true", "mean_price", "max", 1e-6), ("orders_total", "true", "n", "sum", 0.0),
         ("ambiguous", "segment = 'BUILDING'", "mean_price", "value", 1e-6)]
LEDGER = f"""WITH {O_ROWS}, t AS (SELECT segment, class, count(*) AS n, avg(price) AS mean_price FROM ord GROUP BY ALL),
lg AS (SELECT 'mean_price_building' AS metric, 'value' AS aggregate, (SELECT round(max(mean_price), 6) FROM t WHERE segment = 'BUILDING' AND class = '1-URGENT') AS value, 1 AS n_rows
  UNION ALL SELECT 'top_price', 'max', (SELECT round(max(mean_price), 6) FROM t), (SELECT count(*) FROM t) UNION ALL SELECT 'orders_total', 'sum', (SELECT sum(n)::DOUBLE FROM t), (SELECT count(*) FROM t)
  UNION ALL SELECT 'ambiguous', 'value', NULL, (SELECT count(*) FROM t WHERE segment = 'BUILDING'))"""


def _ledger(spark, sf):
    t = orders_o(spark, sf).groupBy("segment", "class").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean_price"))
    return G.metric_ledger(t, "orders_by_segment", SPECS)


@query("metric_ledger", "L1", LEDGER + " SELECT metric, aggregate, value, n_rows FROM lg")
def metric_ledger(spark, sf):
    return _ledger(spark, sf).select("metric", "aggregate", "value", "n_rows")


@query("ledger_anchors", "L2", LEDGER + """ SELECT metric, round(expected, 6) AS expected, value, coalesce(abs(value - expected) <= 0.5, false) AS ok FROM (
  SELECT 'orders_total' AS metric, (SELECT count(*)::DOUBLE FROM orders) AS expected UNION ALL SELECT 'top_price', (SELECT avg(o_totalprice) FROM orders) UNION ALL SELECT 'absent', 1.0) LEFT JOIN lg USING (metric)""")
def ledger_anchors(spark, sf):
    o = orders_o(spark, sf)
    a = o.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("price").alias("m")).select(F.explode(F.array(
        F.struct(F.lit("orders_total").alias("metric"), F.col("n").alias("expected")), F.struct(F.lit("top_price").alias("metric"), F.col("m").alias("expected")),
        F.struct(F.lit("absent").alias("metric"), F.lit(1.0).alias("expected")))).alias("a")).select("a.*")
    led = _ledger(spark, sf).withColumn("tolerance", F.lit(0.5))
    return G.check_anchors(led, a).withColumn("expected", F.round("expected", 6))


_T2 = f"""WITH {O_ROWS}, a AS (SELECT segment, class, round(avg(price), 6) AS v FROM ord GROUP BY ALL), b AS (SELECT segment, class, round(avg(price), 6) + CASE WHEN class = '2-HIGH' THEN 1.0 ELSE 1e-9 END AS v FROM ord WHERE segment <> 'BUILDING' GROUP BY segment, class)"""


def _two_tables(spark, sf):
    o = orders_o(spark, sf)
    a = o.groupBy("segment", "class").agg(F.round(F.avg("price"), 6).alias("v"))
    b = a.where("segment <> 'BUILDING'").withColumn("v", F.col("v") + F.when(F.col("class") == "2-HIGH", 1.0).otherwise(1e-9))
    return a, b


@query("table_equality", "L3", _T2 + " SELECT segment, class, CASE WHEN b.v IS NULL THEN 'only in first' ELSE 'values differ' END AS difference, CASE WHEN b.v IS NULL THEN 'v' ELSE 'v' END AS columns FROM a LEFT JOIN b USING (segment, class) WHERE b.v IS NULL OR abs(a.v - b.v) > 1e-6")
def table_equality(spark, sf):
    return G.table_differences(*_two_tables(spark, sf), ["segment", "class"])


@query("reconciliation", "L4", _T2 + """ SELECT segment, class, a.v AS before, round(b.v, 6) AS after, round(round(b.v, 6) - a.v, 6) AS delta, CASE WHEN a.v IS NULL THEN 'new' WHEN b.v IS NULL THEN 'gone' WHEN a.v = round(b.v, 6) THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b USING (segment, class)""")
def reconciliation(spark, sf):
    a, b = _two_tables(spark, sf)
    return G.reconcile(a, b.withColumn("v", F.round("v", 6)), ["segment", "class"], "v")
