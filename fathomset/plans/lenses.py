"""The given tables seen as samples, individuals, classes and features; each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle

SEED_FOLD, SEED_CAL, N_FOLDS, CAL_FRAC = 11, 12, 5, 0.3


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def u_sql(seed, *keys: str) -> str:
    """DuckDB text of ``unit_hash``."""
    args = ", ".join([f"'{seed}'", *keys])
    return f"(('0x' || substr(md5(concat_ws(':', {args})), 1, 8))::BIGINT / 4294967296::DOUBLE)"


# ---------------------------------------------------------------- V: embeddings
def samples_v(spark, sf) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("v"), v).alias("sample_id"), F.concat(F.lit("g"), v % 50).alias("group_id"),
        F.concat(F.lit("c"), F.col("label")).alias("class"),
        F.when(v % 2 == 0, "female").otherwise("male").alias("sex"),
        F.concat(F.lit("b"), v % 7).alias("batch"), (v % 5).cast("int").alias("phase"), "embedding")


def fact_v(spark, sf) -> DataFrame:
    s = samples_v(spark, sf)
    return s.select("sample_id", "group_id", "class", "sex", "batch", "phase",
                    F.posexplode("embedding").alias("_i", "_x")).select(
        "sample_id", "group_id", "class", "sex", "batch", "phase",
        F.concat(F.lit("f"), F.lpad(F.col("_i").cast("string"), 2, "0")).alias("feature_id"),
        F.col("_x").cast("double").alias("value"))


V_SAMPLES = """smp AS (
  SELECT 'v' || vec_id AS sample_id, 'g' || (vec_id % 50) AS group_id, 'c' || label AS class,
         CASE WHEN vec_id % 2 = 0 THEN 'female' ELSE 'male' END AS sex, 'b' || (vec_id % 7) AS batch,
         (vec_id % 5)::INT AS phase, embedding FROM embeddings)"""
V_FACT = V_SAMPLES + """,
fact AS (
  SELECT sample_id, group_id, class, sex, batch, phase, 'f' || lpad(i::VARCHAR, 2, '0') AS feature_id, x::DOUBLE AS value
  FROM (SELECT *, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM smp))"""
V_FOLDS = f""",
strat AS (
  SELECT group_id, class FROM (SELECT group_id, class, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, class) AS r
    FROM (SELECT group_id, class, count(*) AS n FROM smp GROUP BY ALL)) WHERE r = 1),
folds AS (
  SELECT group_id, class, ((row_number() OVER (PARTITION BY class ORDER BY {u_sql(SEED_FOLD, 'group_id')}, group_id) - 1)
         % least({N_FOLDS}, (SELECT count(*) FROM strat)))::INT AS fold FROM strat),
roles AS (
  SELECT f.k::INT AS fold, group_id, 'test' AS role FROM folds, range({N_FOLDS}) f(k) WHERE folds.fold = f.k
  UNION ALL
  SELECT fold, group_id, CASE WHEN rn <= greatest(1, round(n * {CAL_FRAC})) THEN 'cal' ELSE 'fit' END FROM (
    SELECT f.k::INT AS fold, group_id, count(*) OVER (PARTITION BY f.k) AS n,
           row_number() OVER (PARTITION BY f.k ORDER BY {u_sql(SEED_CAL, 'f.k', 'group_id')}, group_id) AS rn
    FROM folds, range({N_FOLDS}) f(k) WHERE folds.fold <> f.k))"""
V_FIT = """,
fitrows AS (SELECT r.fold, f.class, f.feature_id, f.value FROM fact f JOIN roles r USING (group_id) WHERE r.role = 'fit'),
sds AS (SELECT fold, feature_id, stddev_pop(value) AS sd FROM fitrows GROUP BY ALL),
cen AS (SELECT fold, class AS candidate, feature_id, avg(value) AS mu, any_value(CASE WHEN sd > 0 THEN sd ELSE 1 END) AS sd
        FROM fitrows JOIN sds USING (fold, feature_id) GROUP BY ALL)"""
V_DIST = """,
dist AS (SELECT r.fold, r.role, f.sample_id, f.group_id, f.class, c.candidate,
                round(sum(((f.value - c.mu) / c.sd) * ((f.value - c.mu) / c.sd)), 9) AS d2
         FROM fact f JOIN roles r USING (group_id) JOIN cen c ON c.fold = r.fold AND c.feature_id = f.feature_id
         WHERE r.role IN ('test', 'cal') GROUP BY ALL),
ex AS (SELECT *, exp(-d2 / 2 - max(-d2 / 2) OVER (PARTITION BY fold, sample_id)) AS e FROM dist),
probs AS (SELECT fold, role, sample_id, group_id, class, candidate, d2,
                 round(e / sum(e) OVER (PARTITION BY fold, sample_id), 9) AS p FROM ex)"""
V_PROBS = V_FACT + V_FOLDS + V_FIT + V_DIST


def folds_v(spark, sf) -> DataFrame:
    from ..operators.splits import grouped_kfold
    return grouped_kfold(samples_v(spark, sf), "class", "group_id", N_FOLDS, SEED_FOLD)


def roles_v(spark, sf) -> DataFrame:
    from ..operators.splits import fold_roles
    return fold_roles(folds_v(spark, sf), N_FOLDS, CAL_FRAC, seed=SEED_CAL).transform(settle)


def probs_v(spark, sf, features: DataFrame | None = None) -> DataFrame:
    from ..models.centroid import centroid_probs, centroids, fold_moments
    fact, roles = fact_v(spark, sf), roles_v(spark, sf)
    fits = fold_moments(fact, roles)
    return centroid_probs(fact, roles, settle(centroids(fits, ["fold"], features)))


# ---------------------------------------------------------------- K: lineitem counts
def lines_k(spark, sf) -> DataFrame:
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return li.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey").select(
        F.concat(F.lit("s"), "l_suppkey").alias("group_id"),
        F.concat_ws("-", F.concat(F.lit("s"), "l_suppkey"), "l_returnflag").alias("specimen_id"),
        F.concat_ws("-", F.concat(F.lit("s"), "l_suppkey"), "l_returnflag", F.year("l_shipdate")).alias("sample_id"),
        "l_suppkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.year("l_shipdate").alias("yr"), F.col("p_brand").alias("feature_id"), F.col("p_type").alias("ptype"),
        F.col("l_quantity").alias("quantity"))


def supplier_class(spark, sf) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.concat(F.lit("s"), "s_suppkey").alias("group_id"), F.col("r_name").alias("class"),
                    F.col("n_name").alias("nation")))


def counts_k(spark, sf, with_class: bool = True) -> DataFrame:
    """Count matrix in long form: one row per (sample, brand) actually sold."""
    c = lines_k(spark, sf).groupBy("sample_id", "specimen_id", "group_id", "feature_id").agg(
        F.sum("quantity").alias("value"))
    return c.join(supplier_class(spark, sf), "group_id") if with_class else c


K_LINES = """lines AS (
  SELECT 's' || l_suppkey AS group_id, 's' || l_suppkey || '-' || l_returnflag AS specimen_id,
         's' || l_suppkey || '-' || l_returnflag || '-' || year(l_shipdate) AS sample_id, l_suppkey, l_returnflag AS flag,
         l_linestatus AS status, year(l_shipdate) AS yr, p_brand AS feature_id, p_type AS ptype, l_quantity AS quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey),
cls AS (SELECT 's' || s_suppkey AS group_id, r_name AS class, n_name AS nation
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
K_COUNTS = K_LINES + """,
counts AS (SELECT sample_id, specimen_id, group_id, feature_id, any_value(class) AS class, any_value(nation) AS nation, sum(quantity) AS value
           FROM lines JOIN cls USING (group_id) GROUP BY sample_id, specimen_id, group_id, feature_id)"""


# ---------------------------------------------------------------- O: orders with their customer
def orders_o(spark, sf) -> DataFrame:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("group_id"),
                    F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("status"),
                    F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"),
                    F.col("n_regionkey").alias("region"), F.year("o_orderdate").alias("yr"),
                    F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("price"),
                    F.col("c_acctbal").alias("balance")))


O_ROWS = """ord AS (
  SELECT o_orderkey AS sample_id, o_custkey AS group_id, o_orderpriority AS class, o_orderstatus AS status, c_mktsegment AS segment,
         n_name AS nation, n_regionkey AS region, year(o_orderdate) AS yr, o_orderdate::DATE AS day, o_totalprice AS price, c_acctbal AS balance
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


# ---------------------------------------------------------------- E: events
def events_e(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("sample_id"), F.col("user_id").alias("group_id"), F.col("event_type").alias("class"),
        "value", F.hour("ts").alias("hour"), F.dayofmonth("ts").alias("dom"), "ts",
        F.from_json("props", "k INT")["k"].alias("k"))


E_ROWS = """ev AS (
  SELECT event_id AS sample_id, user_id AS group_id, event_type AS class, value, hour(ts) AS hour, day(ts) AS dom, ts,
         json_extract(props, '$.k')::INT AS k FROM events)"""
