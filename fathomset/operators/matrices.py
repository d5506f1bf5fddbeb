"""Normalise, filter, stack, align and collapse long measurement tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.hashing import unit_hash
from ..functions.ranking import dense_index, exact_quantiles, positions
from ..session import checked_broadcast, estimated_bytes, settle

FEATURE_BLOCK = 5_000  # features per block when a stacked matrix is made dense


# ---- normalisation ----------------------------------------------------------------------------------------------
def library_sizes(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sample_id").agg(F.sum("value").alias("library"))


def cpm(value: str | Column, library: str | Column, log: bool = True) -> Column:
    """Counts per million, log2(x + 1) by default; an empty library gives NULL."""
    v = F.col(value) if isinstance(value, str) else value
    lib = F.col(library) if isinstance(library, str) else library
    c = F.when(lib > 0, v / lib * 1e6)
    return F.log2(c + 1) if log else c


def log_cpm(counts: DataFrame, log: bool = True) -> DataFrame:
    """Normalise by the sample's own total; a sample's features are one bounded window partition."""
    lib = F.sum("value").over(W.partitionBy("sample_id"))
    return counts.withColumn("library", lib).withColumn("value", cpm("value", "library", log)).drop("library")


def feature_medians(fact: DataFrame, keys: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    return exact_quantiles(fact, list(keys), "value", {"median": 0.5}).drop("n")


def impute_median(fact: DataFrame, fitted: DataFrame) -> DataFrame:
    """Fill NULL values with the median learnt on the training rows."""
    return (fact.join(checked_broadcast(fitted), "feature_id", "left")
            .withColumn("value", F.coalesce("value", "median")).drop("median"))


def zscore(fact: DataFrame, scale: DataFrame, on: list[str], zero_as_one: bool = False) -> DataFrame:
    """(x − mean) / sd with given statistics; a constant feature gives 0 (or is divided by 1)."""
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    z = (F.col("value") - F.col("mean")) / sd
    if not zero_as_one:
        z = F.when(F.col("sd") > 0, z).otherwise(F.when(F.col("value").isNotNull(), F.lit(0.0)))
    return fact.join(checked_broadcast(scale), on).withColumn("value", z).drop("mean", "sd")


def feature_scale(fact: DataFrame, on: list[str]) -> DataFrame:
    return fact.groupBy(*on).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def block_weights(scaled: DataFrame, block: str = "assay") -> DataFrame:
    """Divide every value by √(block size) so that layers weigh the same in a distance."""
    sizes = scaled.groupBy(block).agg(F.count_distinct("feature_id").alias("_size"))
    return (scaled.join(checked_broadcast(sizes), block)
            .withColumn("value", F.col("value") / F.sqrt("_size")).drop("_size"))


def residualise(fact: DataFrame, cell: list[str]) -> DataFrame:
    """Subtract each feature's mean over its design cell (aggregate and join back: no whole-cell sort)."""
    means = fact.groupBy(*cell, "feature_id").agg(F.avg("value").alias("_m"))
    return (fact.join(checked_broadcast(means), [*cell, "feature_id"])
            .withColumn("value", F.col("value") - F.col("_m")).drop("_m"))


# ---- filters ----------------------------------------------------------------------------------------------------
def keep_present(fact: DataFrame, n_samples: Column, min_present: float) -> DataFrame:
    """Features measured in at least a share of all samples (an absent long row counts as missing)."""
    return (fact.groupBy("feature_id").agg(F.count("value").alias("_n"))
            .where(F.col("_n") / n_samples >= min_present).select("feature_id"))


def sample_missing_share(fact: DataFrame, features: DataFrame) -> DataFrame:
    n = features.agg(F.count(F.lit(1))).scalar()
    return (fact.join(features, "feature_id", "left_semi").groupBy("sample_id")
            .agg(F.count("value").alias("_n")).select("sample_id", (1 - F.col("_n") / n).alias("missing_share")))


def expressed_shares(counts: DataFrame, samples: DataFrame, min_count: float) -> DataFrame:
    """(class, feature) share of the class's samples with at least ``min_count``; absent rows are 0 counts."""
    n = samples.groupBy("class").agg(F.count(F.lit(1)).alias("_n"))
    hits = counts.where(F.col("value") >= min_count).groupBy("class", "feature_id").agg(F.count(F.lit(1)).alias("_h"))
    return hits.join(n, "class").select("class", "feature_id", (F.col("_h") / F.col("_n")).alias("share"))


def expressed_features(shares: DataFrame, min_frac: float) -> DataFrame:
    """Features expressed in at least one class, with the number of classes that express them."""
    return (shares.where(F.col("share") >= min_frac).groupBy("feature_id")
            .agg(F.count(F.lit(1)).alias("n_classes")))


def shared_features(fact: DataFrame, by: str, min_levels: int | Column) -> DataFrame:
    """Features present in at least ``min_levels`` levels of ``by`` (all of them = inner stacking)."""
    return (fact.where("value IS NOT NULL").groupBy("feature_id").agg(F.count_distinct(by).alias("_l"))
            .where(F.col("_l") >= min_levels).select("feature_id"))


# ---- stacking and alignment -------------------------------------------------------------------------------------
def dense_grid(samples: DataFrame, kept: DataFrame) -> DataFrame:
    """Every (sample, kept feature) pair, the size of the dense result itself.

    Features are packed into blocks of bounded length; samples meet the blocks by an equi-join on the
    block number, and each pair is unfolded next to its sample.
    """
    idx = dense_index(kept.select("feature_id").withColumn("_u", unit_hash("grid", "feature_id")), [], "_u", "feature_id")
    blocks = settle(idx.groupBy(F.floor(F.col("idx") / FEATURE_BLOCK).alias("_block")).agg(
        F.collect_list("feature_id").alias("_names")))
    last = blocks.agg(F.max("_block")).scalar()
    each = samples.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return (each.join(checked_broadcast(blocks, 2_000), "_block")
            .select(*samples.columns, F.explode("_names").alias("feature_id")))


def stack_counts(counts: DataFrame, samples: DataFrame, min_count: float, min_frac: float) -> DataFrame:
    """Stack count tables: library over all features, keep what any class expresses, absent = 0, log2 CPM."""
    kept = settle(expressed_features(expressed_shares(counts, samples, min_count), min_frac))
    lib = library_sizes(counts)
    grid = dense_grid(samples.select("sample_id", "class"), kept)
    own = counts.join(kept.select("feature_id"), "feature_id", "left_semi").select("sample_id", "feature_id", "value")
    return (grid.join(own, ["sample_id", "feature_id"], "left").join(lib, "sample_id", "left")
            .select("sample_id", "class", "feature_id",
                    cpm(F.coalesce("value", F.lit(0.0)), "library").alias("value")))


def stacking_report(counts: DataFrame, samples: DataFrame, min_count: float, min_frac: float) -> DataFrame:
    """How many features any class / every class expresses, and how many only the stacked rule keeps."""
    n_cls = samples.agg(F.count_distinct("class")).scalar()
    kept = expressed_features(expressed_shares(counts, samples, min_count), min_frac)
    total = counts.agg(F.count_distinct("feature_id")).scalar()
    return kept.agg(F.count(F.lit(1)).alias("n_any"),
                    F.count_if(F.col("n_classes") == n_cls).alias("n_all")).select(
        "n_any", "n_all", (F.col("n_any") - F.col("n_all")).alias("n_recovered"), total.alias("n_union"))


def align_layers(layers: DataFrame, key: str, n_layers: int) -> DataFrame:
    """Restrict layers to keys present in all of them; duplicate samples of a key are averaged."""
    shared = (layers.groupBy(key).agg(F.count_distinct("assay").alias("_l")).where(F.col("_l") == n_layers).select(key))
    return layers.join(shared, key, "left_semi").groupBy("assay", key, "feature_id").agg(F.avg("value").alias("value"))


def complete_features(blocks: DataFrame, within: list[str], key: str) -> DataFrame:
    """Per block: features measured in every key of the block (of the class, or after stacking)."""
    n = blocks.groupBy(*within).agg(F.count_distinct(key).alias("_k"))
    per = blocks.where("value IS NOT NULL").groupBy(*within, "feature_id").agg(F.count_distinct(key).alias("_h"))
    return per.join(n, within).where("_h = _k").select(*within, "feature_id")


def first_mapping(mapping: DataFrame, source: str, target: str, order: str) -> DataFrame:
    """One target per source id: the first mapping wins (min_by, reduced map-side)."""
    return mapping.where(F.col(source).isNotNull()).groupBy(source).agg(F.min_by(target, order).alias(target))


def map_symbols(features: DataFrame, mapping: DataFrame, source: str, target: str, order: str) -> DataFrame:
    """Left-join the first mapping on the id without its ``__dupN`` suffix; unmapped stays NULL."""
    bare = features.withColumn("_id", F.split("feature_id", "__dup").getItem(0))
    m = first_mapping(mapping, source, target, order).withColumnRenamed(source, "_id")
    return bare.join(m, "_id", "left").drop("_id")


def mark_duplicates(table: DataFrame, ident: str, ordinal: str, within: list[str]) -> DataFrame:
    """Repeated ids get ``__dupN`` in the order of a unique ``ordinal``; nothing is dropped.

    The ordinal is a number or a struct that begins with one; NULL ordinals come last.  Rows are numbered slice by
    slice, so one id may hold any share of them.
    """
    kind = table.schema[ordinal].dataType
    by = F.col(ordinal)[kind[0].name] if isinstance(kind, T.StructType) else F.col(ordinal)
    marked = positions(table, [*within, ident], by, [ordinal], "_n").drop("n_total")
    return marked.withColumn(
        ident, F.when(F.col("_n") == 0, F.col(ident)).otherwise(F.concat_ws("__dup", ident, "_n"))).drop("_n")


#: Bytes of the written table that one task combines into genes; each of its rows may become as many as its feature has genes.
COLLAPSE_BYTES = 2 << 20


def collapse(fact: DataFrame, mapping: DataFrame, keys: list[str], target: str = "gene") -> DataFrame:
    """Mean over the features of a gene; one-to-many mappings keep every pair.

    Rows are dealt by ``keys`` before they meet the mapping, so that the pairs are combined where they are made and never shuffled,
    and few features don't gather the rows of all samples in few tasks.  The number of parts grows with the written table, so a
    task's share of the pairs does not.  A mapping too large to broadcast is joined as usual.
    """
    fact = settle(fact.select(*keys, "feature_id", "value"))
    parts = max(int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-estimated_bytes(fact) // COLLAPSE_BYTES))
    return fact.repartition(parts, *keys).join(checked_broadcast(mapping), "feature_id").groupBy(*keys, target).agg(F.avg("value").alias("value"))


def sum_runs(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("value").alias("value"))


# ---- peptides ---------------------------------------------------------------------------------------------------
def quantified_proteins(peptides: DataFrame, min_peptides: int) -> DataFrame:
    """(plex, protein) with enough peptides quantified anywhere in the plex, contaminants left out."""
    return (peptides.where("NOT is_contaminant AND value IS NOT NULL").groupBy("plex", "protein")
            .agg(F.count_distinct("peptide").alias("n_peptides")).where(F.col("n_peptides") >= min_peptides))


def protein_matrix(peptides: DataFrame, min_peptides: int, norm: str = "total") -> DataFrame:
    """Null-skipping peptide sums → ppm of the channel total, or ratio to the median complete protein; log2."""
    kept = quantified_proteins(peptides, min_peptides)
    summed = (peptides.where("NOT is_contaminant").join(kept.select("plex", "protein"), ["plex", "protein"], "left_semi")
              .groupBy("plex", "channel", "protein").agg(F.sum("value").alias("value")))
    if norm == "total":
        tot = summed.groupBy("plex", "channel").agg(F.sum("value").alias("_ref"))
        scale = 1e6
    else:
        n_ch = summed.groupBy("plex").agg(F.count_distinct("channel").alias("_c"))
        full = (summed.where("value IS NOT NULL").groupBy("plex", "protein").agg(F.count(F.lit(1)).alias("_h"))
                .join(n_ch, "plex").where("_h = _c").select("plex", "protein"))
        tot = exact_quantiles(summed.join(full, ["plex", "protein"], "left_semi"), ["plex", "channel"], "value",
                              {"_ref": 0.5}).drop("n")
        scale = 1.0
    rel = F.col("value") / F.col("_ref") * scale
    return (summed.join(tot, ["plex", "channel"])
            .select("plex", "channel", "protein", F.when(rel > 0, F.log2(rel)).alias("value")))


def plex_summary(peptides: DataFrame, min_peptides: int) -> DataFrame:
    rows = peptides.where("NOT is_contaminant").groupBy("plex").agg(
        F.count_distinct("channel").alias("n_channels"), F.count_distinct("peptide").alias("n_peptides"))
    q = (peptides.where("NOT is_contaminant AND value IS NOT NULL").groupBy("plex", "protein")
         .agg(F.count_distinct("peptide").alias("_p"))
         .groupBy("plex").agg(F.count(F.lit(1)).alias("n_quantified"),
                              F.count_if(F.col("_p") >= min_peptides).alias("n_kept")))
    return rows.join(q, "plex").withColumn("n_dropped", F.col("n_quantified") - F.col("n_kept"))


# ---- nested platforms -------------------------------------------------------------------------------------------
def collapse_specimens(fact: DataFrame) -> DataFrame:
    """Average the vials of one specimen inside a platform."""
    return fact.groupBy("platform", "specimen_id", "feature_id").agg(F.avg("value").alias("value"))


def representative_vials(vials: DataFrame) -> DataFrame:
    """One vial per specimen: known to the metadata first, then the smallest label."""
    first = F.struct(F.when(F.col("in_pheno"), 0).otherwise(1), F.col("sample_id"))
    return vials.groupBy("specimen_id").agg(F.min_by("sample_id", first).alias("representative"),
                                            F.count_distinct("platform").alias("n_platforms"),
                                            F.concat_ws("|", F.array_sort(F.collect_set("platform"))).alias("platforms"))
