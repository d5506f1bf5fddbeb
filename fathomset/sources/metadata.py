"""Sample metadata: alias columns, recoding, specimen ids, and the join with a prefix fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: accepted column names (first present wins) and codes
SEX_COLUMNS = ["sex", "registration___sex", "registration.sex"]
GROUP_COLUMNS = ["group", "study_group_timepoint", "sacrificetime"]
CLASS_COLUMNS = ["specimen_processing___sampletypedescription", "specimen.processing.sampletypedescription", "tissue"]
SEX_CODES = {"1": "female", "2": "male", "f": "female", "m": "male"}
SPECIMEN_CHARS = 5


def _pick(df: DataFrame, names: list[str], required: bool = True):
    for n in names:
        if n in df.columns:
            return F.col(f"`{n}`"), n
    if required:
        raise ValueError(f"none of the columns {names} is present")
    return F.lit(None).cast("string"), None


def standard_metadata(raw: DataFrame, sample: str = "viallabel", group: str = "pid", specimen: str = "bid") -> DataFrame:
    """``sample_id, specimen_id, group_id, sex, stage, class_name``, one row per sample."""
    if sample not in raw.columns or group not in raw.columns:
        raise ValueError(f"the metadata needs the columns {sample} and {group}")
    ident = F.trim(F.col(f"`{sample}`"))
    spec = F.trim(F.col(f"`{specimen}`")) if specimen in raw.columns else F.substring(ident, 1, SPECIMEN_CHARS)
    sex = F.lower(F.trim(_pick(raw, SEX_COLUMNS)[0]))
    code = F.create_map(*[x for k, v in SEX_CODES.items() for x in (F.lit(k), F.lit(v))])
    stage_col, stage_name = _pick(raw, GROUP_COLUMNS)
    stage = F.lower(F.trim(stage_col))
    if stage_name != "group":
        week = F.regexp_extract(stage, r"(\d)w", 1)
        stage = (F.when(stage.contains("control"), "control").when(week != "", F.concat(week, F.lit("w"))).otherwise(stage))
    rows = raw.select(ident.alias("sample_id"), spec.alias("specimen_id"), F.trim(F.col(f"`{group}`")).alias("group_id"),
                      F.coalesce(F.try_element_at(code, sex), sex).alias("sex"), stage.alias("stage"),
                      _pick(raw, CLASS_COLUMNS, False)[0].alias("class_name"))
    return rows.dropDuplicates(["sample_id"])


def join_with_fallback(samples: DataFrame, pheno: DataFrame, columns: list[str], key: str = "vial",
                       prefix: str = "prefix") -> DataFrame:
    """Left join on the sample id, then on the specimen prefix; ``matched`` says which one answered.

    One metadata row per prefix is kept (smallest sample id), so the second join cannot multiply rows.
    """
    direct = pheno.select(F.col(key).alias("sample_id"), F.lit(1).alias("_hit"), *[F.col(c).alias(f"_d_{c}") for c in columns])
    by_prefix = pheno.groupBy(prefix).agg(F.lit(1).alias("_pre"), *[F.min_by(c, key).alias(f"_p_{c}") for c in columns])
    j = samples.join(direct, "sample_id", "left").join(by_prefix, prefix, "left")
    how = F.when(F.col("_hit").isNotNull(), "direct").when(F.col("_pre").isNotNull(), "fallback").otherwise("unmatched")
    return j.select(*samples.columns, *[F.coalesce(f"_d_{c}", f"_p_{c}").alias(c) for c in columns], how.alias("matched"))
