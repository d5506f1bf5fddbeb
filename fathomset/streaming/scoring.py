"""Structured Streaming: score arriving samples, watch coverage over time, join late labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conformal import DIGITS
from ..session import checked_broadcast, scratch_path


def model_row(model_id: str, coef: DataFrame, intercept: DataFrame, scale: DataFrame, q: float) -> DataFrame:
    """A stored model as one row of arrays, so that a stream row is scored without any state.

    Its size is classes × panel features, fixed when the model was fitted.
    """
    ordered = lambda v: F.array_sort(F.collect_list(F.struct("feature_id", *v)))
    per = coef.groupBy("candidate").agg(F.transform(ordered(["w"]), lambda s: s["w"]).alias("w")).join(intercept, "candidate")
    members = per.agg(F.array_sort(F.collect_list(F.struct("candidate", "b", "w"))).alias("members"))
    sc = scale.agg(F.transform(ordered(["mean", "sd"]), lambda s: s["mean"]).alias("mean"),
                   F.transform(ordered(["mean", "sd"]), lambda s: s["sd"]).alias("sd"))
    key = F.lit(model_id).alias("model_id")
    return members.select(key, "members").join(sc.select(key, "mean", "sd"), "model_id").withColumn("q", F.lit(float(q)))


def score_vectors(samples: DataFrame, models: DataFrame, vector: str, n_features: int) -> DataFrame:
    """Reference-scaled scores of each row: probabilities, call, prediction set and status (stateless)."""
    x = F.slice(F.transform(vector, lambda v: v.cast("double")), 1, n_features)
    j = samples.withColumn("_x", x).join(checked_broadcast(models), "model_id")  # one row per stored model
    centred = F.zip_with("_x", "mean", lambda a, m: a - m)
    j = j.withColumn("_z", F.zip_with(centred, "sd", lambda a, s: F.when(s > 0, a / s).otherwise(F.lit(0.0))))
    dot = lambda m: F.aggregate(F.zip_with("_z", m["w"], lambda z, w: z * w), m["b"], lambda a, t: a + t)
    j = j.withColumn("_l", F.transform("members", lambda m: F.struct(m["candidate"].alias("candidate"), dot(m).alias("l"))))
    j = j.withColumn("_top", F.array_max(F.transform("_l", lambda s: s["l"])))
    j = j.withColumn("_e", F.transform("_l", lambda s: F.struct(s["candidate"].alias("candidate"), F.exp(s["l"] - F.col("_top")).alias("e"))))
    j = j.withColumn("_sum", F.aggregate("_e", F.lit(0.0), lambda a, s: a + s["e"]))
    j = j.withColumn("_p", F.array_sort(F.transform("_e", lambda s: F.struct(
        (-F.round(s["e"] / F.col("_sum"), DIGITS)).alias("np"), s["candidate"].alias("candidate")))))
    members = F.transform(F.filter("_p", lambda s: -s["np"] >= F.round(1 - F.col("q"), DIGITS)), lambda s: s["candidate"])
    out = j.withColumn("set_members", F.array_sort(members))
    size = F.size("set_members")
    status = F.when(size == 0, "Unknown").when(size == 1, "Confident").otherwise("Ambiguous")
    return out.select(*samples.columns, F.col("_p")[0]["candidate"].alias("call"), (-F.col("_p")[0]["np"]).alias("call_p"),
                      "set_members", size.alias("set_size"), status.alias("status"))


def run_to_files(stream: DataFrame, name: str) -> DataFrame:
    """Drain what is available into an append-only file sink (exactly once by its checkpoint) and read it back."""
    spark = stream.sparkSession
    path, log = scratch_path(spark, name), scratch_path(spark, f"{name}-log")
    (stream.writeStream.format("parquet").outputMode("append").option("path", path)
     .option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(path)


def by_batch(stream: DataFrame, name: str, keep=None) -> DataFrame:
    """Append what each trigger emits to a folder of its own, named by the batch id: a replayed batch overwrites itself."""
    spark = stream.sparkSession
    path, log = scratch_path(spark, name), scratch_path(spark, f"{name}-log")
    query = (stream.writeStream.outputMode("append").option("checkpointLocation", log)
             .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")).trigger(availableNow=True).start())
    query.awaitTermination()
    if keep is not None:
        keep.extend(query.recentProgress)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)


def latest_by_batch(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The last state of every row that a stream in update mode emits, those still open too.

    Each trigger's rows go to a folder named by the batch id, as in :func:`by_batch`; of each key the row of the latest batch counts.
    """
    spark = stream.sparkSession
    path, log = scratch_path(spark, name), scratch_path(spark, f"{name}-log")
    (stream.writeStream.outputMode("update").option("checkpointLocation", log)
     .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")).trigger(availableNow=True).start().awaitTermination())
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(f"{', '.join(f'`{c}` {t}' for c, t in stream.dtypes)}, batch bigint").option("basePath", path).parquet(path)
    last = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def coverage_windows(scored: DataFrame, width: str, delay: str) -> DataFrame:
    """Coverage and flag rate per tumbling window.

    In append mode a window is emitted once, when the watermark has passed its end, and its state is dropped; rows that come later
    than ``delay`` are dropped too.  Windows that are still open are not part of what append mode emits; update mode emits
    them with what they hold so far (:func:`latest_by_batch`), and drops state and late rows in the same way.
    """
    return (scored.withWatermark("ts", delay).groupBy(F.window("ts", width), "class")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("covered").alias("coverage"), F.avg("flagged").alias("flag_rate"))
            .select(F.col("window.start").alias("window_start"), "class", "n", "coverage", "flag_rate"))


def join_late_labels(scored: DataFrame, labels: DataFrame, on: list[str], within: str, delay: str) -> DataFrame:
    """Stream–stream join of predictions with labels arriving up to ``within`` later.

    The key holds a time bucket as wide as ``within``, so that one hot user spreads over tasks by time.  A prediction has one
    bucket and a label is offered to its own and the one before it, so a pair meets exactly once.
    """
    width = F.expr(f"INTERVAL {within}")
    seconds = lambda c: F.unix_micros(F.timestamp_seconds(F.lit(0)) + width) if c is None else F.unix_micros(c)
    bucket = lambda c: F.floor(seconds(F.col(c)) / seconds(None)).cast("long")
    p = scored.withWatermark("ts", delay).withColumn("_bucket", bucket("ts"))
    lab = labels.withWatermark("label_ts", delay).withColumn("_offered", F.explode(F.array(bucket("label_ts"), bucket("label_ts") - 1)))
    cond = (p["_bucket"] == lab["_offered"]) & (F.col("label_ts") >= F.col("ts")) & (F.col("label_ts") <= F.col("ts") + width)
    for c in on:
        cond = cond & (p[c] == lab[f"label_{c}"])
    return p.join(lab, cond).drop("_bucket", "_offered")


def parquet_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A given table, one file or a folder of part files, as a file stream (schema taken from its footer).

    A stream takes a plain path for a folder; a pattern that only the table's own name fits stands for either.
    """
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]")
