"""Is class confounded with processing? Association, nesting, estimable pairs, variance shares, screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ranking import average_ranks, value_ranks
from ..functions.special import chi2_sf, fisher_exact, mann_whitney_p
from ..functions.text import CLOCK_PATTERN, any_date, clock_hours

# fixed values: first matching rule decides a covariate's category
CATEGORY_RULES = [
    (r"comments$|formname|versionnbr|visitcode", None),
    (r"^(key\.(anirandgroup|sacrificetime|intervention|protocol|agegroup)|study_group_timepoint|sacrificetime|intervention|biclabeldata\.protocol)$", "design"),
    (r"^training\.|^vo2\.max\.test\.|^calculated\.variables\.(vo2_max_change|pct_body_(fat|lean|fluid)_change|lactate_change_dueto_train)|^nmr\.testing\..*_2$|^terminal\.weight\.", "outcome"),
    (r"^familiarization\.|^nmr\.testing\..*_1$|^registration\.(weight|d_birth|days_birth)$", "baseline"),
    (r"^key\.(d_arrive|d_sacrifice|siteid)$|^registration\.|^specimen\.collection\.|^specimen\.processing\.|^calculated\.variables\.(coll_time_train|deathtime_after_train|frozetime_after_train)$|^time_to_freeze$|^biclabeldata\.", "collection"),
    (r"^(GET_site|RNA_extr_|RIN$|r_260_|Lib_|Seq_)", "library"),
    (r"^(reads_raw|reads|uniquely_mapped|num_.*splices)$", "depth"),
    (r"^(pct_|avg_|median_5_3_bias)", "qc"),
    (r"^tmt", "processing"),
]
# fixed values: separation limits of the two-group screen
NUMERIC_SHARE, IDENTIFIER_SHARE, MISSING_HIGH, MISSING_LOW, SEPARATES_AUROC, SEPARATES_V = 0.9, 0.9, 0.8, 0.2, 0.95, 0.9


def category(name: str) -> Column:
    out = None
    for pattern, cat in CATEGORY_RULES:
        hit, val = F.col(name).rlike(pattern), F.lit(cat).cast("string")
        out = F.when(hit, val) if out is None else out.when(hit, val)
    return out.otherwise("other")


# ---- association ------------------------------------------------------------------------------------------------
def contingency(levels: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return (levels.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(*keys, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
            .agg(F.count(F.lit(1)).alias("n")))


def cramers_v(cells: DataFrame, keys: list[str], constant: float | None = 0.0) -> DataFrame:
    """V, χ², its p-value and n per key from contingency counts.

    Only observed cells are touched: Σ(o−e)²/e over the full table equals Σo²/e − n, and cells absent
    from the data contribute nothing to Σo²/e.  ``constant`` is the value for a one-level variable.  A 2 × 2 table has
    Fisher's exact p, a larger one the χ² tail; a one-level variable has none.
    """
    rows = cells.groupBy(*keys, "a").agg(F.sum("n").alias("_ra"))
    cols = cells.groupBy(*keys, "b").agg(F.sum("n").alias("_cb"))
    ratio = F.col("n") * F.col("n") / (F.col("_ra") * F.col("_cb"))
    s = (cells.join(rows, [*keys, "a"]).join(cols, [*keys, "b"]).groupBy(*keys)
         .agg(F.sum("n").alias("n"), F.sum(ratio).alias("_r"), F.count_distinct("a").alias("n_a"), F.count_distinct("b").alias("n_b"),
              F.min(F.struct("a", "_ra")).alias("_first_a"), F.min(F.struct("b", "_cb")).alias("_first_b")))
    corner = cells.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("n").alias("_corner"))
    same = (F.col("_first_a.a") == F.col("_a")) & (F.col("_first_b.b") == F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    s = s.join(corner, same, "left").withColumn("_corner", F.coalesce("_corner", F.lit(0)))
    k = F.least("n_a", "n_b") - 1
    chi2 = F.col("n") * (F.col("_r") - 1)
    v = F.when(k >= 1, F.sqrt(F.greatest(F.lit(0.0), F.col("_r") - 1) / k)).otherwise(F.lit(constant))
    c, ra, cb = F.col("_corner"), F.col("_first_a._ra"), F.col("_first_b._cb")
    exact = fisher_exact(c, ra - c, cb - c, F.col("n") - ra - cb + c)
    p = F.when((F.col("n_a") == 2) & (F.col("n_b") == 2), exact).when(k >= 1, chi2_sf(chi2, (F.col("n_a") - 1) * (F.col("n_b") - 1)))
    return s.select(*keys, "n", "n_a", "n_b", F.when(k >= 1, chi2).alias("chi2"), v.alias("v"), p.alias("p_value"))


# ---- nesting and estimable pairs --------------------------------------------------------------------------------
def class_levels(covariates: DataFrame) -> DataFrame:
    """Distinct (variable, class, level); everything below works on this small table."""
    return covariates.where("level IS NOT NULL AND class IS NOT NULL").select("variable", "class", "level").distinct()


def sharing_pairs(levels: DataFrame) -> DataFrame:
    """Class pairs sharing a level of a variable.

    Each level is reduced to its sorted set of classes and equal sets are merged first, so the pairs
    generated are bounded by (number of classes)² per distinct set, never by the rows of a level.
    """
    sets = (levels.groupBy("variable", "level").agg(F.array_sort(F.collect_set("class")).alias("_s"))
            .select("variable", "_s").distinct())
    left = sets.select("variable", "_s", F.posexplode("_s").alias("_i", "class_a"))
    return (left.select("variable", "class_a", F.explode(F.expr("slice(_s, _i + 2, size(_s))")).alias("class_b"))
            .distinct())


def estimable_pairs(pairs: DataFrame, variables: list[str]) -> DataFrame:
    """Pairs that share a level of every variable."""
    return (pairs.where(F.col("variable").isin(variables)).groupBy("class_a", "class_b")
            .agg(F.count_distinct("variable").alias("_v")).where(F.col("_v") == len(variables))
            .select("class_a", "class_b"))


def nesting_table(covariates: DataFrame) -> DataFrame:
    """Ten statistics per processing variable, rows with a missing value dropped per variable."""
    lv = class_levels(covariates)
    per_class = lv.groupBy("variable", "class").agg(F.count(F.lit(1)).alias("_l"))
    per_level = lv.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("_c"))
    by_class = per_class.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_classes"), F.percentile("_l", F.lit(0.5)).alias("median_levels_per_class"),
        F.max("_l").alias("max_levels_per_class"), F.count_if(F.col("_l") == 1).alias("classes_in_one_level"))
    by_level = per_level.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_levels"), F.max("_c").alias("max_classes_per_level"),
        F.count_if(F.col("_c") > 1).alias("n_levels_shared"))
    n_pairs = sharing_pairs(lv).groupBy("variable").agg(F.count(F.lit(1)).alias("_p"))
    v = cramers_v(contingency(covariates, ["variable"], "class", "level"), ["variable"]).select("variable", "v")
    return (by_class.join(by_level, "variable").join(v, "variable").join(n_pairs, "variable", "left")
            .select("variable", "n_levels", "n_classes", "median_levels_per_class", "max_levels_per_class",
                    "max_classes_per_level", "n_levels_shared", "classes_in_one_level",
                    F.round("v", 6).alias("cramers_v"), F.coalesce("_p", F.lit(0)).alias("n_pairs_sharing"),
                    (F.col("n_classes") * (F.col("n_classes") - 1) / 2).cast("long").alias("n_pairs_total")))


# ---- variance explained -----------------------------------------------------------------------------------------
def r2_categorical(rows: DataFrame, keys: list[str], factor: list[str], value: str = "value") -> DataFrame:
    """Between-group share of variance: group sums first, so only (key, level) rows are combined."""
    g = rows.where(F.col(value).isNotNull()).groupBy(*keys, *factor).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(value)).alias("w"))
    over = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    g = g.withColumn("_g", F.sum(F.col("n") * F.col("m")).over(over) / F.sum("n").over(over))
    b = F.sum(F.col("n") * (F.col("m") - F.col("_g")) ** 2)
    tot = b + F.sum("w")
    return g.groupBy(*keys).agg(F.sum("n").alias("n"), F.when(tot > 0, b / tot).otherwise(0.0).alias("r2"))


def r2_numeric(rows: DataFrame, keys: list[str], covariate: str, value: str = "value") -> DataFrame:
    ok = rows.where(F.col(covariate).isNotNull() & F.col(value).isNotNull())
    c = F.corr(value, covariate)
    return ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(c * c, F.lit(0.0)).alias("r2"))


# ---- typed covariates -------------------------------------------------------------------------------------------
def infer_types(long: DataFrame, keys: list[str]) -> DataFrame:
    """Kind of every text variable: empty, numeric (≥ 90 % parse), time, datetime or categorical."""
    t = F.when(F.length(F.trim("level")) > 0, F.trim("level"))
    v = long.select(*keys, t.alias("x"))
    ok = F.count("x")
    share = lambda c: F.try_divide(F.count(c), ok)
    s = v.groupBy(*keys).agg(
        ok.alias("n"), share(F.col("x").try_cast("double")).alias("num"),
        F.coalesce(F.min(F.col("x").rlike(CLOCK_PATTERN).cast("int")), F.lit(0)).alias("clock"),
        share(any_date("x")).alias("date"), F.min("x").alias("_lo"),
        F.max("x").alias("_hi"))
    kind = (F.when(F.col("n") == 0, "empty").when(F.col("num") >= NUMERIC_SHARE, "numeric")
            .when(F.col("clock") == 1, "time").when(F.col("date") >= NUMERIC_SHARE, "datetime").otherwise("categorical"))
    return s.select(*keys, "n", kind.alias("kind"), (F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(True))).alias("constant"))


def typed_value(kind: str = "kind", text: str = "level") -> Column:
    """Number, hours, or days since 2018-01-01, by kind."""
    return (F.when(F.col(kind) == "numeric", F.trim(text).try_cast("double")).when(F.col(kind) == "time", clock_hours(text))
            .when(F.col(kind) == "datetime", F.datediff(any_date(text), F.lit("2018-01-01").cast("date")).cast("double")))


def usable_covariates(long: DataFrame, kinds: DataFrame, keys: list[str]) -> DataFrame:
    """Drop constants and identifier-like categoricals (≥ 90 % distinct)."""
    d = long.where("level IS NOT NULL").groupBy(*keys, "level").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_levels"), F.sum("_n").alias("_rows"))
    j = kinds.join(d, keys)
    ident = (F.col("kind") == "categorical") & (F.col("n_levels") >= IDENTIFIER_SHARE * F.col("_rows"))
    return j.where((F.col("kind") != "empty") & (F.col("n_levels") >= 2) & ~ident).select(*keys, "kind", "n_levels")


def two_group_screen(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per variable: AUROC (numeric) or Cramér's V (categorical) between two groups with its p-value, and one-sided missingness.

    ``long`` has ``positive`` (boolean), ``kind``, ``level`` (text) and ``x`` (typed number or NULL).
    """
    pos = F.col("positive").cast("long")
    miss = F.avg(F.when(F.col("positive"), F.col("level").isNull().cast("double"))).alias("missing_pos")
    miss0 = F.avg(F.when(~F.col("positive"), F.col("level").isNull().cast("double"))).alias("missing_neg")
    base = long.groupBy(*keys, "kind").agg(miss, miss0, F.sum(pos).alias("n_pos"), F.count(F.lit(1)).alias("n"))
    ranks = value_ranks(long.where("x IS NOT NULL AND kind <> 'categorical'"), keys, "x", extra={"p": F.sum(pos)})
    u = F.sum(F.col("p") * (F.col("n_below") + (F.col("n_eq") + 1) / 2.0)) - F.sum("p") * (F.sum("p") + 1) / 2.0
    auc = F.try_divide(u, F.sum("p") * (F.max("n_total") - F.sum("p")))
    ties = F.sum(F.pow("n_eq", 3) - F.col("n_eq"))
    num = ranks.groupBy(*keys).agg(F.greatest(auc, 1 - auc).alias("sep"), mann_whitney_p(auc, F.sum("p"), F.max("n_total") - F.sum("p"), ties).alias("p_num"))
    v = cramers_v(contingency(long.where("kind = 'categorical'"), keys, "level", "positive"), keys, None).select(*keys, F.col("v").alias("sepc"), F.col("p_value").alias("p_cat"))
    out = base.join(num, keys, "left").join(v, keys, "left")
    one = (((F.col("missing_neg") >= MISSING_HIGH) & (F.col("missing_pos") <= MISSING_LOW))
           | ((F.col("missing_pos") >= MISSING_HIGH) & (F.col("missing_neg") <= MISSING_LOW)))
    stat = F.when(F.col("sep").isNotNull(), "auroc").when(F.col("sepc").isNotNull(), "cramers_v")
    sep = F.coalesce("sep", "sepc")
    limit = F.when(F.col("sep").isNotNull(), SEPARATES_AUROC).otherwise(SEPARATES_V)
    return out.select(*keys, "kind", "n", "n_pos", F.round("missing_pos", 6).alias("missing_pos"),
                      F.round("missing_neg", 6).alias("missing_neg"), stat.alias("stat"), F.round(sep, 6).alias("separation"),
                      F.round(F.coalesce("p_num", F.when(F.col("sepc").isNotNull(), F.col("p_cat"))), 6).alias("p_value"), one.alias("one_sided_missing"), (one | F.coalesce(sep >= limit, F.lit(False))).alias("separates"))


def screen_summary(screen: DataFrame, over: str = "class") -> DataFrame:
    return screen.groupBy("variable").agg(
        F.count_distinct(over).alias("n_classes"), F.count_if(F.col("separates")).alias("n_separating"),
        F.max("separation").alias("max_separation"), F.max(F.col("one_sided_missing").cast("int")).alias("any_one_sided"))


def verdicts(screen: DataFrame, limit: float) -> DataFrame:
    """CASE ladder per class from the strongest separation and the variables that separate."""
    s = screen.groupBy("class").agg(F.max("separation").alias("top"), F.concat_ws(";", F.array_sort(
        F.collect_set(F.when(F.col("separates"), F.col("variable"))))).alias("separating"))
    verdict = (F.when(F.col("separating") != "", "unresolvable: a covariate separates the groups")
               .when(F.col("top") >= limit, "doubtful: a covariate classifies the groups").otherwise("treatment"))
    return s.select("class", F.col("top").alias("max_separation"), "separating", verdict.alias("verdict"))


# ---- bridging pools ---------------------------------------------------------------------------------------------
def bridge_variance(pool_rows: DataFrame, study: DataFrame, sets: DataFrame, min_mean: float) -> DataFrame:
    """Between-plate variance of the same material over the variance that separates the classes.

    Ratio per feature, then its median and the ratio of sums, over feature sets (``feature_set, feature_id``).
    """
    cls = study.groupBy("class", "feature_id").agg(F.avg("value").alias("m"), F.var_samp("value").alias("w"))
    v = cls.groupBy("feature_id").agg(F.var_samp("m").alias("v_class"), F.avg("w").alias("v_within"))
    b = pool_rows.groupBy("pool", "feature_id").agg(
        F.var_samp("value").alias("v_batch"), F.avg("value").alias("pool_mean"), F.count_distinct("plate").alias("plates")
    ).where("plates >= 2")
    j = b.join(v, "feature_id").where("v_class > 0")
    every = j.join(sets, "feature_id").unionByName(
        j.where(F.col("pool_mean") >= min_mean).withColumn("feature_set", F.lit("expressed_in_pool")))
    ratio = F.col("v_batch") / F.col("v_class")
    # one row per feature: bounded by the feature dimension
    return every.groupBy("pool", "feature_set").agg(
        F.count(F.lit(1)).alias("n_features"), F.round(F.percentile(ratio, F.lit(0.5)), 6).alias("median_ratio"),
        F.round(F.sum("v_batch") / F.sum("v_class"), 6).alias("sum_ratio"),
        F.round(F.percentile(F.try_divide("v_batch", "v_within"), F.lit(0.5)), 6).alias("median_ratio_within"))


# ---- id spaces --------------------------------------------------------------------------------------------------
def one_to_one(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose two sides each have exactly one partner."""
    d = pairs.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    ok_a = d.groupBy(a).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(a)
    ok_b = d.groupBy(b).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(b)
    return d.join(ok_a, a, "left_semi").join(ok_b, b, "left_semi")


def two_stage_match(source: DataFrame, target: DataFrame) -> DataFrame:
    """Match by id, then the unmatched rest by symbol; one partner per side, earlier stage first.

    ``source(src, id, symbol)``, ``target(id, symbol)`` → ``src, id, stage``.
    """
    by_id = source.join(target.select("id").distinct(), "id").select("src", "id", F.lit(1).alias("stage"))
    rest = source.join(target.select("id"), "id", "left_anti")
    names = target.where("symbol IS NOT NULL").groupBy("symbol").agg(F.max("id").alias("id"))
    by_symbol = rest.drop("id").join(names, "symbol").select("src", "id", F.lit(2).alias("stage"))
    both = by_id.unionByName(by_symbol)
    first = both.groupBy("src").agg(F.min(F.struct("stage", "id")).alias("_f")).select("src", "_f.id", "_f.stage")
    return first.groupBy("id").agg(F.min(F.struct("stage", "src")).alias("_f")).select("_f.src", "id", "_f.stage")


# ---- layers and profiles ----------------------------------------------------------------------------------------
def layer_correlation(a: DataFrame, b: DataFrame, keys: list[str], on: str, method: str = "spearman", min_n: int = 8) -> DataFrame:
    """Correlation of two layers per gene over shared specimens; ranks within the gene for Spearman."""
    j = a.select(*keys, on, F.col("value").alias("x")).join(b.select(*keys, on, F.col("value").alias("y")), [*keys, on])
    j = j.where("x IS NOT NULL AND y IS NOT NULL")
    if method == "spearman":
        j = average_ranks(j, keys, "x", "rx").drop("n_total")
        j = average_ranks(j, keys, "y", "ry").drop("n_total")
        j = j.drop("x", "y").withColumnRenamed("rx", "x").withColumnRenamed("ry", "y")
    r = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("rho"))
    return r.withColumn("rho", F.when(F.col("n") >= min_n, F.col("rho")))


def discordance(a: DataFrame, b: DataFrame, keys: list[str], fdr: float) -> DataFrame:
    """Concordant, opposite and one-layer-only effects of two differential tables (mean stat, min padj per key)."""
    side = lambda d, s: d.groupBy(*keys).agg(F.avg("stat").alias(f"stat_{s}"), F.min("padj").alias(f"padj_{s}"))
    j = side(a, "a").join(side(b, "b"), keys)
    sa, sb = F.col("padj_a") < fdr, F.col("padj_b") < fdr
    same = F.signum("stat_a") == F.signum("stat_b")
    return (j.withColumn("concordant", sa & sb & same).withColumn("discordant_sign", sa & sb & ~same)
            .withColumn("discordant_sig", sa != sb))


def classify_profile(points: DataFrame, keys: list[str], order: str, value: str, noise: float) -> DataFrame:
    """Shape of a profile over an ordinal: INCREASING, DECREASING, FLAT or NON-MONOTONE (few points per key)."""
    w = W.partitionBy(*keys)
    rank = lambda c: F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, c)) - 1) / 2.0
    s = points.withColumn("_ro", rank(order)).withColumn("_rv", rank(value)).groupBy(*keys).agg(
        F.corr("_ro", "_rv").alias("_rho"), F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"),
        F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rho = F.round(F.when(F.col("_hi") > F.col("_lo"), F.col("_rho")).otherwise(0.0), 6)
    shape = (F.when((rho >= 0.8) & (F.col("_last") - F.col("_first") > noise), "INCREASING")
             .when((F.col("_last") == F.col("_lo")) & (F.col("_first") - F.col("_last") > noise), "DECREASING")
             .when(F.col("_hi") - F.col("_lo") <= noise, "FLAT").otherwise("NON-MONOTONE"))
    return s.select(*keys, rho.alias("rho"), shape.alias("shape"))


def quartile_bins(rows: DataFrame, cuts: DataFrame, value: str, out: str = "quartile") -> DataFrame:
    """Bins 1–4 by given cut points (q1, q2, q3); right-closed as quantile cuts are."""
    b = (F.when(F.col(value) <= F.col("q1"), 1).when(F.col(value) <= F.col("q2"), 2)
         .when(F.col(value) <= F.col("q3"), 3).otherwise(4))
    return rows.withColumn("q1", cuts.select("q1").scalar()).withColumn("q2", cuts.select("q2").scalar()).withColumn(
        "q3", cuts.select("q3").scalar()).withColumn(out, b).drop("q1", "q2", "q3")
