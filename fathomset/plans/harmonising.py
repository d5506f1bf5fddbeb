"""Normalise, filter, stack, align."""

from pyspark.sql import functions as F

from ..operators import matrices as X
from ..operators.effects import class_correlation, excluded_features, marker_check, marker_effect
from ..sources.metadata import join_with_fallback
from .lenses import (E_ROWS, K_COUNTS, K_LINES, V_FACT, V_SAMPLES, counts_k, events_e, fact_v, lines_k, samples_v,
                     supplier_class, table)
from .registry import query

K = f"WITH {K_COUNTS}"
SMP_K = """,
smp AS (SELECT DISTINCT sample_id, specimen_id, group_id, class FROM counts)"""


def _samples_k(c):
    return c.select("sample_id", "specimen_id", "group_id", "class").distinct()


@query("log_cpm", "A1 S5 S6 F1", K + """
SELECT sample_id, feature_id, class, round(CASE WHEN lib > 0 THEN log2(1e6 * value / lib + 1) END, 6) AS value
FROM (SELECT *, sum(value) OVER (PARTITION BY sample_id) AS lib FROM counts)""")
def log_cpm(spark, sf):
    return X.log_cpm(counts_k(spark, sf)).select("sample_id", "feature_id", "class", F.round("value", 6).alias("value"))


@query("one_class_counts", "S6 P4 P1", K + SMP_K + """,
a AS (SELECT * FROM counts WHERE class = 'ASIA'),
k AS (SELECT feature_id FROM a WHERE value >= 20 GROUP BY feature_id HAVING count(*) / (SELECT count(DISTINCT sample_id) FROM a) >= 0.5)
SELECT sample_id, feature_id, round(log2(1e6 * value / sum(value) OVER (PARTITION BY sample_id) + 1), 6) AS value FROM a SEMI JOIN k USING (feature_id)""")
def one_class_counts(spark, sf):
    a = counts_k(spark, sf).where("class = 'ASIA'")
    kept = X.expressed_features(X.expressed_shares(a, _samples_k(a), 20), 0.5)
    return X.log_cpm(a.join(kept, "feature_id", "left_semi")).select("sample_id", "feature_id", F.round("value", 6).alias("value"))


@query("expression_filter_any_class", "P4", K + SMP_K + """,
sh AS (SELECT class, feature_id, count(*) FILTER (WHERE value >= 40) / any_value(n) AS share FROM counts JOIN (SELECT class, count(*) AS n FROM smp GROUP BY class) USING (class) GROUP BY ALL)
SELECT feature_id, count(*) FILTER (WHERE share >= 0.31) AS n_classes FROM sh GROUP BY ALL HAVING max(share) >= 0.31""")
def expression_filter_any_class(spark, sf):
    c = counts_k(spark, sf)
    return X.expressed_features(X.expressed_shares(c, _samples_k(c), 40), 0.31)


@query("stack_counts", "J4 J3", K + SMP_K + """,
sh AS (SELECT class, feature_id, count(*) FILTER (WHERE value >= 40) / any_value(n) AS share FROM counts JOIN (SELECT class, count(*) AS n FROM smp GROUP BY class) USING (class) GROUP BY ALL),
kept AS (SELECT feature_id FROM sh GROUP BY ALL HAVING max(share) >= 0.31), lib AS (SELECT sample_id, sum(value) AS lib FROM counts GROUP BY ALL)
SELECT s.sample_id, s.class, k.feature_id, round(log2(1e6 * coalesce(c.value, 0) / lib.lib + 1), 6) AS value
FROM smp s CROSS JOIN kept k LEFT JOIN counts c ON c.sample_id = s.sample_id AND c.feature_id = k.feature_id JOIN lib ON lib.sample_id = s.sample_id""")
def stack_counts(spark, sf):
    c = counts_k(spark, sf)
    return X.stack_counts(c, _samples_k(c), 40, 0.31).withColumn("value", F.round("value", 6))


@query("stacking_report", "J4", K + SMP_K + """,
sh AS (SELECT class, feature_id, count(*) FILTER (WHERE value >= 40) / any_value(n) AS share FROM counts JOIN (SELECT class, count(*) AS n FROM smp GROUP BY class) USING (class) GROUP BY ALL),
k AS (SELECT feature_id, count(*) AS c FROM sh WHERE share >= 0.31 GROUP BY ALL)
SELECT count(*) AS n_any, coalesce(sum((c = (SELECT count(DISTINCT class) FROM smp))::INT), 0)::BIGINT AS n_all,
  (count(*) - coalesce(sum((c = (SELECT count(DISTINCT class) FROM smp))::INT), 0))::BIGINT AS n_recovered, (SELECT count(DISTINCT feature_id) FROM counts) AS n_union FROM k""")
def stacking_report(spark, sf):
    c = counts_k(spark, sf)
    return X.stacking_report(c, _samples_k(c), 40, 0.31)


_NATION = K + """,
pn AS (SELECT nation, feature_id, sum(value) AS value FROM counts GROUP BY ALL)"""


@query("stack_inner", "J2 U1 P2", K + """,
big AS (SELECT class, sample_id, feature_id, value FROM counts WHERE value >= 40),
cm AS (SELECT feature_id FROM big GROUP BY feature_id HAVING count(DISTINCT class) = (SELECT count(DISTINCT class) FROM counts))
SELECT class, feature_id, count(*) AS n, round(avg(value), 6) AS mean FROM big SEMI JOIN cm USING (feature_id) GROUP BY ALL""")
def stack_inner(spark, sf):
    big = counts_k(spark, sf).where("value >= 40")
    n = supplier_class(spark, sf).agg(F.count_distinct("class")).scalar()
    keep = X.shared_features(big, "class", n)
    return big.join(keep, "feature_id", "left_semi").groupBy("class", "feature_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("presence_filter", "P3 J3", K + SMP_K + """,
f AS (SELECT feature_id FROM counts GROUP BY feature_id HAVING count(value) / (SELECT count(*) FROM smp) >= 0.55),
ms AS (SELECT sample_id, 1 - count(*) / (SELECT count(*) FROM f) AS miss FROM counts SEMI JOIN f USING (feature_id) GROUP BY sample_id)
SELECT (SELECT count(*) FROM f) AS n_features, count(*) FILTER (WHERE miss <= 0.4) AS n_kept, (SELECT count(*) FROM smp) - count(*) FILTER (WHERE miss <= 0.4) AS n_dropped FROM ms""")
def presence_filter(spark, sf):
    c = counts_k(spark, sf)
    n = _samples_k(c).agg(F.count(F.lit(1))).scalar()
    f = X.keep_present(c, n, 0.55)
    ms = X.sample_missing_share(c, f)
    return ms.agg(F.count_if(F.col("missing_share") <= 0.4).alias("n_kept")).select(
        f.agg(F.count(F.lit(1))).scalar().alias("n_features"), "n_kept", (n - F.col("n_kept")).alias("n_dropped"))


@query("align_layers", "J5 U1 U2", f"""WITH {K_LINES},
ly AS (SELECT 'brand' AS assay, specimen_id, sample_id, feature_id, sum(quantity) AS value FROM lines WHERE flag <> 'N' GROUP BY ALL
  UNION ALL SELECT 'kind', specimen_id, sample_id, ptype, sum(quantity) FROM lines WHERE flag <> 'A' GROUP BY ALL),
sh AS (SELECT specimen_id FROM ly GROUP BY specimen_id HAVING count(DISTINCT assay) = 2)
SELECT assay, specimen_id, feature_id, round(avg(value), 6) AS value FROM ly SEMI JOIN sh USING (specimen_id) GROUP BY ALL""")
def align_layers(spark, sf):
    return X.align_layers(_layers(spark, sf), "specimen_id", 2).withColumn("value", F.round("value", 6))


def _layers(spark, sf):
    li = lines_k(spark, sf)
    one = li.where("flag <> 'N'").groupBy("specimen_id", "sample_id", "feature_id").agg(F.sum("quantity").alias("value"))
    two = li.where("flag <> 'A'").groupBy("specimen_id", "sample_id", F.col("ptype").alias("feature_id")).agg(
        F.sum("quantity").alias("value"))
    return one.withColumn("assay", F.lit("brand")).unionByName(two.withColumn("assay", F.lit("kind")))


@query("complete_blocks", "J6 P3", f"""WITH {K_LINES},
ly AS (SELECT 'brand' AS assay, specimen_id, feature_id, yr, sum(quantity) AS value FROM lines GROUP BY ALL
  UNION ALL SELECT 'kind', specimen_id, ptype, yr, sum(quantity) FROM lines GROUP BY ALL),
n AS (SELECT assay, yr, count(DISTINCT specimen_id) AS k FROM ly GROUP BY ALL)
SELECT assay, yr, feature_id FROM ly JOIN n USING (assay, yr) GROUP BY assay, yr, feature_id HAVING count(DISTINCT specimen_id) = any_value(k)""")
def complete_blocks(spark, sf):
    li = lines_k(spark, sf)
    both = li.withColumn("_f", F.explode(F.array(
        F.struct(F.lit("brand").alias("assay"), F.col("feature_id").alias("f")),
        F.struct(F.lit("kind").alias("assay"), F.col("ptype").alias("f")))))
    ly = both.groupBy(F.col("_f.assay").alias("assay"), "specimen_id", F.col("_f.f").alias("feature_id"), "yr").agg(
        F.sum("quantity").alias("value"))
    return X.complete_features(ly, ["assay", "yr"], "specimen_id")


@query("zscore_within", "A5", f"""WITH {V_FACT}
SELECT sample_id, feature_id, round(CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0 END, 6) AS z FROM (
  SELECT *, avg(value) OVER (PARTITION BY batch, feature_id) AS m, stddev_pop(value) OVER (PARTITION BY batch, feature_id) AS sd FROM fact)""")
def zscore_within(spark, sf):
    f = fact_v(spark, sf)
    z = X.zscore(f, X.feature_scale(f, ["batch", "feature_id"]), ["batch", "feature_id"])
    return z.select("sample_id", "feature_id", F.round("value", 6).alias("z"))


@query("zscore_source", "A5", f"""WITH {V_FACT}, st AS (SELECT feature_id, avg(value) AS m, stddev_pop(value) AS sd FROM fact WHERE sex = 'male' GROUP BY ALL)
SELECT feature_id, count(*) AS n, round(avg((value - m) / (CASE WHEN sd > 0 THEN sd ELSE 1 END)), 6) AS mean_z, round(stddev_pop((value - m) / (CASE WHEN sd > 0 THEN sd ELSE 1 END)), 6) AS sd_z
FROM fact JOIN st USING (feature_id) WHERE sex = 'female' GROUP BY ALL""")
def zscore_source(spark, sf):
    f = fact_v(spark, sf)
    z = X.zscore(f.where("sex = 'female'"), X.feature_scale(f.where("sex = 'male'"), ["feature_id"]), ["feature_id"], True)
    return z.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_z"),
                                       F.round(F.stddev_pop("value"), 6).alias("sd_z"))


@query("block_scaling", "A5 M9", f"""WITH {K_LINES},
ly AS (SELECT 'brand' AS assay, sample_id, feature_id, sum(quantity) AS value FROM lines GROUP BY ALL
  UNION ALL SELECT 'kind', sample_id, ptype, sum(quantity) FROM lines GROUP BY ALL),
z AS (SELECT assay, sample_id, assay || '::' || feature_id AS feature_id, (value - avg(value) OVER w) / (CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w ELSE 1 END) AS v
      FROM ly WINDOW w AS (PARTITION BY assay, feature_id))
SELECT assay, feature_id, round(sum(v * v / n), 6) AS energy, count(*) AS n FROM z JOIN (SELECT assay, count(DISTINCT feature_id) AS n FROM z GROUP BY assay) USING (assay) GROUP BY ALL""")
def block_scaling(spark, sf):
    li = lines_k(spark, sf)
    one = li.groupBy("sample_id", "feature_id").agg(F.sum("quantity").alias("value")).withColumn("assay", F.lit("brand"))
    two = li.groupBy("sample_id", F.col("ptype").alias("feature_id")).agg(F.sum("quantity").alias("value")).withColumn("assay", F.lit("kind"))
    f = one.unionByName(two).withColumn("feature_id", F.concat_ws("::", "assay", "feature_id"))
    z = X.block_weights(X.zscore(f, X.feature_scale(f, ["feature_id"]), ["feature_id"], True))
    return z.groupBy("assay", "feature_id").agg(F.round(F.sum(F.col("value") ** 2), 6).alias("energy"), F.count(F.lit(1)).alias("n"))


@query("median_impute", "A4", f"""WITH {E_ROWS}, x AS (SELECT sample_id, class AS feature_id, dom, CASE WHEN k % 4 = 0 THEN NULL ELSE value END AS value FROM ev),
md AS (SELECT feature_id, quantile_cont(value, 0.5) AS med FROM x WHERE dom <= 20 GROUP BY ALL)
SELECT sample_id, feature_id, round(coalesce(value, med), 6) AS value FROM x JOIN md USING (feature_id) WHERE dom > 20""")
def median_impute(spark, sf):
    e = events_e(spark, sf).select("sample_id", F.col("class").alias("feature_id"), "dom",
                                   F.when(F.col("k") % 4 != 0, F.col("value")).alias("value"))
    fitted = X.feature_medians(e.where("dom <= 20"))
    return X.impute_median(e.where("dom > 20"), fitted).select("sample_id", "feature_id", F.round("value", 6).alias("value"))


@query("residualize", "A13", f"""WITH {V_FACT}
SELECT sample_id, feature_id, round(value - avg(value) OVER (PARTITION BY sex, phase, feature_id), 6) AS value FROM fact""")
def residualize(spark, sf):
    return X.residualise(fact_v(spark, sf), ["sex", "phase"]).select("sample_id", "feature_id", F.round("value", 6).alias("value"))


@query("collapse_to_gene", "A14 J11", K + """,
map AS (SELECT DISTINCT p_brand AS feature_id, p_type AS gene FROM part)
SELECT sample_id, gene, round(avg(value), 6) AS value FROM counts JOIN map USING (feature_id) GROUP BY ALL""")
def collapse_to_gene(spark, sf):
    m = table(spark, sf, "part").select(F.col("p_brand").alias("feature_id"), F.col("p_type").alias("gene")).distinct()
    return X.collapse(counts_k(spark, sf, False), m, ["sample_id"]).withColumn("value", F.round("value", 6))


@query("symbol_map", "J7 S7", """WITH f AS (SELECT p_brand || CASE WHEN p_partkey % 3 = 0 THEN '__dup1' ELSE '' END AS feature_id, p_partkey FROM part),
m AS (SELECT p_brand AS id, arg_min(p_type, p_partkey) AS symbol FROM part WHERE p_brand NOT LIKE 'Brand#1%' GROUP BY ALL)
SELECT f.feature_id, symbol, count(*) AS n FROM f LEFT JOIN m ON m.id = split_part(f.feature_id, '__dup', 1) GROUP BY ALL""")
def symbol_map(spark, sf):
    p = table(spark, sf, "part")
    f = p.select(F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, "__dup1").otherwise("")).alias("feature_id"))
    m = p.where("p_brand NOT LIKE 'Brand#1%'").select(F.col("p_brand").alias("id"), F.col("p_type").alias("symbol"), "p_partkey")
    return X.map_symbols(f, m, "id", "symbol", "p_partkey").groupBy("feature_id", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query("sum_runs", "S12", f"WITH {K_LINES} SELECT specimen_id, feature_id, sum(quantity) AS value FROM lines GROUP BY ALL")
def sum_runs(spark, sf):
    return X.sum_runs(lines_k(spark, sf).withColumnRenamed("quantity", "value"), ["specimen_id", "feature_id"])


@query("collapse_specimens", "S14", f"""WITH {K_LINES}, v AS (SELECT status AS platform, specimen_id, sample_id, feature_id, sum(quantity) AS value FROM lines GROUP BY ALL)
SELECT platform, specimen_id, feature_id, round(avg(value), 6) AS value FROM v GROUP BY ALL""")
def collapse_specimens(spark, sf):
    v = lines_k(spark, sf).groupBy(F.col("status").alias("platform"), "specimen_id", "sample_id", "feature_id").agg(F.sum("quantity").alias("value"))
    return X.collapse_specimens(v).withColumn("value", F.round("value", 6))


@query("representative_vials", "S14 J10", f"""WITH {K_LINES}, v AS (SELECT DISTINCT specimen_id, sample_id, status AS platform, yr % 2 = 0 AS in_pheno FROM lines)
SELECT specimen_id, arg_min(sample_id, (CASE WHEN in_pheno THEN '0' ELSE '1' END) || sample_id) AS representative, count(DISTINCT platform) AS n_platforms,
  string_agg(DISTINCT platform, '|' ORDER BY platform) AS platforms FROM v GROUP BY specimen_id""")
def representative_vials(spark, sf):
    v = lines_k(spark, sf).select("specimen_id", "sample_id", F.col("status").alias("platform"), (F.col("yr") % 2 == 0).alias("in_pheno")).distinct()
    return X.representative_vials(v)


PEP = f"""WITH {K_LINES}, pep AS (SELECT yr AS plex, status || flag AS channel, feature_id AS protein, feature_id || '/' || ptype AS peptide, ptype = 'PROMO' AS is_contaminant,
  CASE WHEN sum(quantity) % 7 = 0 THEN NULL ELSE sum(quantity) END AS value FROM lines JOIN cls USING (group_id) GROUP BY ALL),
kept AS (SELECT plex, protein FROM pep WHERE NOT is_contaminant AND value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT peptide) >= 4),
sm AS (SELECT plex, channel, protein, sum(value) AS value FROM pep SEMI JOIN kept USING (plex, protein) WHERE NOT is_contaminant GROUP BY ALL)"""


def _peptides(spark, sf):
    li = lines_k(spark, sf).join(supplier_class(spark, sf), "group_id")
    g = li.groupBy(F.col("yr").alias("plex"), F.concat("status", "flag").alias("channel"), F.col("feature_id").alias("protein"),
                   F.concat_ws("/", "feature_id", "ptype").alias("peptide"), (F.col("ptype") == "PROMO").alias("is_contaminant")).agg(F.sum("quantity").alias("value"))
    return g.withColumn("value", F.when(F.col("value") % 7 != 0, F.col("value")))


@query("protein_ppm", "A15 P7 S15", PEP + """
SELECT plex, channel, protein, round(CASE WHEN value > 0 THEN log2(value / sum(value) OVER (PARTITION BY plex, channel) * 1e6) END, 6) AS value FROM sm""")
def protein_ppm(spark, sf):
    return X.protein_matrix(_peptides(spark, sf), 4).withColumn("value", F.round("value", 6))


@query("protein_ratio", "A15 S16", PEP + """,
full_ AS (SELECT plex, protein FROM sm JOIN (SELECT plex, count(DISTINCT channel) AS c FROM sm GROUP BY plex) USING (plex) WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) = any_value(c)),
md AS (SELECT plex, channel, quantile_cont(value, 0.5) AS med FROM sm SEMI JOIN full_ USING (plex, protein) GROUP BY ALL)
SELECT plex, channel, protein, round(CASE WHEN value > 0 THEN log2(value / med) END, 6) AS value FROM sm JOIN md USING (plex, channel)""")
def protein_ratio(spark, sf):
    return X.protein_matrix(_peptides(spark, sf), 4, "median").withColumn("value", F.round("value", 6))


@query("plex_summary", "A15 P7", PEP + """,
r AS (SELECT plex, count(DISTINCT channel) AS n_channels, count(DISTINCT peptide) AS n_peptides FROM pep WHERE NOT is_contaminant GROUP BY plex),
q AS (SELECT plex, count(*) AS n_quantified, count(*) FILTER (WHERE c >= 4) AS n_kept FROM (SELECT plex, protein, count(DISTINCT peptide) AS c FROM pep WHERE NOT is_contaminant AND value IS NOT NULL GROUP BY ALL) GROUP BY plex)
SELECT plex, n_channels, n_peptides, n_quantified, n_kept, n_quantified - n_kept AS n_dropped FROM r JOIN q USING (plex)""")
def plex_summary(spark, sf):
    return X.plex_summary(_peptides(spark, sf), 4)


@query("feature_statistics", "A30", f"""WITH {V_FACT} SELECT feature_id, count(*) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance,
  round(avg((value IS NULL)::INT), 6) AS null_share FROM (SELECT feature_id, CASE WHEN abs(value) < 0.01 THEN NULL ELSE value END AS value FROM fact) GROUP BY ALL""")
def feature_statistics(spark, sf):
    f = fact_v(spark, sf).withColumn("value", F.when(F.abs("value") >= 0.01, F.col("value")))
    return f.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_samp("value"), 6).alias("variance"),
                                       F.round(F.avg(F.col("value").isNull().cast("int")), 6).alias("null_share"))


@query("classes_expressing", "A30", K + SMP_K + """,
sh AS (SELECT class, feature_id, count(*) FILTER (WHERE value >= 40) / any_value(n) AS share FROM counts JOIN (SELECT class, count(*) AS n FROM smp GROUP BY class) USING (class) GROUP BY ALL),
k AS (SELECT feature_id, count(*) AS n_classes FROM sh WHERE share >= 0.31 GROUP BY ALL) SELECT n_classes, count(*) AS n_features FROM k GROUP BY n_classes""")
def classes_expressing(spark, sf):
    c = counts_k(spark, sf)
    return X.expressed_features(X.expressed_shares(c, _samples_k(c), 40), 0.31).groupBy("n_classes").agg(F.count(F.lit(1)).alias("n_features"))


@query("missingness_features", "A28", f"""WITH {V_FACT} SELECT class, feature_id, round(avg((abs(value) < 0.02)::INT), 6) AS null_share FROM fact GROUP BY ALL""")
def missingness_features(spark, sf):
    f = fact_v(spark, sf).withColumn("value", F.when(F.abs("value") >= 0.02, F.col("value")))
    return f.groupBy("class", "feature_id").agg(F.round(F.avg(F.col("value").isNull().cast("int")), 6).alias("null_share"))


@query("exclude_flagged", "P5", K + """,
bad AS (SELECT DISTINCT class, group_id FROM counts WHERE class = 'EUROPE' AND feature_id = 'Brand#1' AND value >= 100)
SELECT class, count(*) AS n, count(DISTINCT group_id) AS n_groups FROM counts ANTI JOIN bad USING (class, group_id) GROUP BY class""")
def exclude_flagged(spark, sf):
    c = counts_k(spark, sf)
    bad = c.where("class = 'EUROPE' AND feature_id = 'Brand#1' AND value >= 100").select("class", "group_id").distinct()
    return c.join(bad, ["class", "group_id"], "left_anti").groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("n_groups"))


@query("reference_prefix", "P6", f"""WITH {V_SAMPLES} SELECT sample_id LIKE 'v8%' AS is_reference, count(*) AS n, count(DISTINCT group_id) AS n_groups FROM smp GROUP BY ALL""")
def reference_prefix(spark, sf):
    s = samples_v(spark, sf)
    return s.groupBy(F.col("sample_id").startswith("v8").alias("is_reference")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("n_groups"))


@query("meta_fallback_join", "J1", """WITH pheno AS (SELECT doc_id::VARCHAR AS vial, substr(lpad(doc_id::VARCHAR, 6, '0'), 1, 4) AS prefix, source, quality::VARCHAR AS quality
    FROM documents JOIN labels USING (doc_id) WHERE doc_id % 5 <> 0),
byp AS (SELECT prefix, arg_min(source, vial) AS source, arg_min(quality, vial) AS quality FROM pheno GROUP BY prefix)
SELECT d.doc_id::VARCHAR AS sample_id, coalesce(p.source, b.source) AS source, coalesce(p.quality, b.quality) AS quality,
  CASE WHEN p.vial IS NOT NULL THEN 'direct' WHEN b.prefix IS NOT NULL THEN 'fallback' ELSE 'unmatched' END AS matched
FROM documents d LEFT JOIN pheno p ON p.vial = d.doc_id::VARCHAR LEFT JOIN byp b ON b.prefix = substr(lpad(d.doc_id::VARCHAR, 6, '0'), 1, 4)""")
def meta_fallback_join(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels")
    vial = F.col("doc_id").cast("string")
    prefix = F.substring(F.lpad(vial, 6, "0"), 1, 4)
    pheno = d.join(lab, "doc_id").where("doc_id % 5 <> 0").select(vial.alias("vial"), prefix.alias("prefix"), "source",
                                                                  F.col("quality").cast("string").alias("quality"))
    samples = d.select(vial.alias("sample_id"), prefix.alias("prefix"))
    return join_with_fallback(samples, pheno, ["source", "quality"]).drop("prefix")


@query("qc_correlation", "A16", f"""WITH {V_FACT}, q AS (SELECT sample_id, len(list_filter(embedding, lambda x: x > 0))::DOUBLE AS qc FROM smp)
SELECT class, feature_id, round(corr(value, qc), 6) AS r, count(*) AS n FROM fact JOIN q USING (sample_id) GROUP BY ALL HAVING count(*) >= 8""")
def qc_correlation(spark, sf):
    return class_correlation(fact_v(spark, sf), _qc(spark, sf)).withColumn("r", F.round("r", 6))


def _qc(spark, sf):
    return samples_v(spark, sf).select("sample_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("double").alias("qc"))


@query("exclusion_mask", "A17", f"""WITH {V_FACT}, q AS (SELECT sample_id, len(list_filter(embedding, lambda x: x > 0))::DOUBLE AS qc FROM smp),
c AS (SELECT class, feature_id, corr(value, qc) AS r FROM fact JOIN q USING (sample_id) GROUP BY ALL HAVING count(*) >= 8)
SELECT class, feature_id FROM c WHERE abs(r) > 0.4 UNION SELECT DISTINCT class, feature_id FROM fact WHERE phase = 1 GROUP BY class, feature_id HAVING avg(value) > 0.08""")
def exclusion_mask(spark, sf):
    f = fact_v(spark, sf)
    regulated = f.where("phase = 1").groupBy("class", "feature_id").agg(F.avg("value").alias("m")).where("m > 0.08")
    return excluded_features(f, _qc(spark, sf), regulated, 0.4)


@query("marker_effect", "A19", f"""WITH {V_FACT}, m AS (SELECT feature_id, class, avg(value) AS m, row_number() OVER (PARTITION BY feature_id ORDER BY avg(value) DESC, class) AS r FROM fact GROUP BY feature_id, class)
SELECT a.feature_id, a.class AS marker_class, round(a.m, 6) AS marker_mean, b.class AS next_class, round(b.m, 6) AS next_mean, round(a.m - b.m, 6) AS effect
FROM m a JOIN m b ON b.feature_id = a.feature_id AND b.r = 2 WHERE a.r = 1""")
def marker_effect_q(spark, sf):
    m = fact_v(spark, sf).groupBy("feature_id", "class").agg(F.avg("value").alias("mean"))
    e = marker_effect(m)
    return e.select("feature_id", "marker_class", F.round("marker_mean", 6).alias("marker_mean"), "next_class",
                    F.round("next_mean", 6).alias("next_mean"), F.round("effect", 6).alias("effect"))


@query("panel_card", "A34 A19", f"""WITH {V_FACT}, s AS (SELECT feature_id, class, avg(value) AS m FROM fact WHERE sex = 'male' GROUP BY ALL), t AS (SELECT feature_id, class, avg(value) AS m FROM fact WHERE sex = 'female' AND class <> 'c9' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY m DESC, class) AS r FROM s),
e AS (SELECT a.feature_id, a.class AS marker_class, a.m - b.m AS src FROM r a JOIN r b ON b.feature_id = a.feature_id AND b.r = 2 WHERE a.r = 1),
g AS (SELECT feature_id, max(m) FILTER (WHERE class = marker_class) - max(m) FILTER (WHERE class <> marker_class) AS tgt FROM t JOIN e USING (feature_id) GROUP BY ALL)
SELECT feature_id, marker_class, round(src, 6) AS source_effect, round(tgt, 6) AS target_effect,
  CASE WHEN tgt IS NULL THEN 'not tested' WHEN tgt <= 0 THEN 'lost' WHEN tgt < 0.5 * src THEN 'weakened' ELSE 'holds' END AS status FROM e JOIN g USING (feature_id)""")
def panel_card(spark, sf):
    f = fact_v(spark, sf)
    mean = lambda d: d.groupBy("feature_id", "class").agg(F.avg("value").alias("mean"))
    c = marker_check(mean(f.where("sex = 'male'")), mean(f.where("sex = 'female' AND class <> 'c9'")))
    return c.withColumn("source_effect", F.round("source_effect", 6)).withColumn("target_effect", F.round("target_effect", 6))
