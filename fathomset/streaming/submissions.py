"""Scaling within an arriving submission, however many triggers its rows are spread over.

A submission can be scaled only when all its rows are there.  It is closed

* by an end marker, a row with ``is_end``; where the marker declares a number of samples, when so many different ones have come; or
* by event time, when the watermark (the latest time seen less ``gap``) has passed its last row.

What is kept between triggers is a table per batch id: one row for each submission that is open or was closed within the gap,
and the rows that wait, a folder per batch.  So a submission of any size is grouped, scaled and scored by ordinary
distributed aggregates over its waiting rows, and no task or state entry holds it whole.  Every table is a function of the batch and of the
tables of the batch before; a replayed batch overwrites what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models.centroid import linear_logits
from ..operators.conformal import softmax_over
from ..operators.matrices import feature_scale, zscore
from ..session import checked_broadcast, scratch_path, settle

OPEN, CLOSED = "open", "closed"
#: What arrives: sample_id is null in an end marker, declared everywhere else.
ARRIVING = "submission_id string, sample_id string, ts timestamp, is_end boolean, declared int, vector array<double>"
_STATE = "submission_id string, status string, first_batch bigint, last_ts timestamp, ended boolean, declared int"


@dataclass
class Inbox:
    """The tables of a running query under one folder."""

    spark: SparkSession
    path: str
    gap: str

    def read(self, table: str, batch: int, schema: str) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}/batch={batch}")

    def write(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        path = f"{self.path}/{table}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def waiting(self, ids: DataFrame, batch: int) -> DataFrame:
        """The rows of these submissions (submission_id, first_batch), repeated samples once: the earliest row, then the smallest."""
        first = ids.agg(F.min("first_batch")).scalar()  # only folders since the oldest of them are read
        rows = (self.spark.read.schema(f"{ARRIVING}, batch bigint").option("basePath", f"{self.path}/waiting").parquet(f"{self.path}/waiting")
                .where((F.col("batch") <= batch) & (F.col("batch") >= first) & F.col("sample_id").isNotNull()))
        own = rows.join(checked_broadcast(ids.select("submission_id", "first_batch")), "submission_id").where("batch >= first_batch")
        return own.groupBy("submission_id", "sample_id").agg(F.min(F.struct("ts", "vector")).alias("r")).select("submission_id", "sample_id", "r.vector")

    def step(self, arrived: DataFrame, batch: int, score: Callable[[DataFrame], DataFrame]) -> None:
        before = self.read("state", batch - 1, _STATE)
        clock = self.read("clock", batch - 1, "ts timestamp").agg(F.max("ts")).first()[0]
        known = before.select("submission_id", F.col("status").alias("was"))
        # one row per open submission; a hot one is met by broadcast or split by the skew join, and is never grouped whole
        met = arrived.join(checked_broadcast(known), "submission_id", "left")
        late = F.coalesce(F.col("ts") < F.lit(clock).cast("timestamp"), F.lit(False)) | F.coalesce(F.col("was") == CLOSED, F.lit(False))
        self.write(met.where(late).drop("was"), "late", batch)
        kept = self.write(met.where(~late).drop("was"), "waiting", batch)
        now = self.write(arrived.agg(F.greatest(F.lit(clock).cast("timestamp"), F.max("ts") - F.expr(f"INTERVAL {self.gap}")).alias("ts")), "clock", batch).first()[0]
        news = kept.groupBy("submission_id").agg(F.max("ts").alias("n_last"), F.bool_or(F.coalesce("is_end", F.lit(False))).alias("n_ended"), F.max("declared").alias("n_declared"))
        state = before.join(news, "submission_id", "full").select(
            "submission_id", F.coalesce("status", F.lit(OPEN)).alias("status"), F.coalesce("first_batch", F.lit(batch).cast("bigint")).alias("first_batch"),
            F.greatest("last_ts", "n_last").alias("last_ts"), (F.coalesce("ended", F.lit(False)) | F.coalesce("n_ended", F.lit(False))).alias("ended"),
            F.greatest("declared", "n_declared").alias("declared"))
        state = self.write(state, "merged", batch)
        passed = F.coalesce(F.col("last_ts") < F.lit(now).cast("timestamp"), F.lit(False))
        declared = state.where((F.col("status") == OPEN) & F.col("ended") & F.col("declared").isNotNull())
        came = self.waiting(declared, batch).groupBy("submission_id").agg(F.count(F.lit(1)).alias("came"))
        state = state.join(came, "submission_id", "left")
        complete = F.col("ended") & (F.col("declared").isNull() | (F.coalesce("came", F.lit(0)) >= F.col("declared")))
        closing = state.where((F.col("status") == OPEN) & (complete | passed))
        self.write(score(self.waiting(closing, batch)), "scores", batch)
        done = F.when((F.col("status") == CLOSED) | complete | passed, CLOSED).otherwise(OPEN)
        # a submission that was closed by its marker is remembered while rows of its time would still be taken
        self.write(state.withColumn("status", done).where((F.col("status") == OPEN) | ~passed).drop("came"), "state", batch)


def scored_within(rows: DataFrame, coef: DataFrame, intercept: DataFrame, feature: Callable) -> DataFrame:
    """Probabilities of every sample, each feature scaled within its submission."""
    on = ["submission_id", "feature_id"]
    long = rows.select("submission_id", "sample_id", F.posexplode("vector").alias("i", "value")).withColumn("feature_id", feature(F.col("i"))).drop("i")
    z = zscore(long, feature_scale(long, on), on)
    p = linear_logits(z, coef, intercept, ["submission_id", "sample_id"]).transform(softmax_over(["submission_id", "sample_id"], "logit"))
    return p.drop("logit")


def arrive_in_order(rows: DataFrame, by: str, files: int) -> str:
    """Write ``rows`` as that many files, each a range of ``by``, one after the other; returns their folder.

    A file stream takes files by their age, and files of one job are finished in any order: a later range that comes
    first moves the watermark past the rows of an earlier one.
    """
    spark = rows.sparkSession
    folder = scratch_path(spark, "arriving")
    ranged = settle(rows.repartitionByRange(files, by).withColumn("_file", F.spark_partition_id()))
    for i in range(files):
        ranged.where(F.col("_file") == i).drop("_file").repartition(1).write.mode("append").parquet(folder)
    return folder


def score_submissions(stream: DataFrame, coef: DataFrame, intercept: DataFrame, feature: Callable, gap: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Drain the stream (columns as in ``ARRIVING``); returns the scores of all closed submissions and the late rows.

    Late are rows older than the watermark and rows of a submission that its marker has closed.  An empty trigger writes empty
    tables; null ids are a submission of their own.
    """
    spark = stream.sparkSession
    box = Inbox(spark, scratch_path(spark, name), gap)
    keyed = stream.withColumn("submission_id", F.coalesce("submission_id", F.lit("")))
    (keyed.writeStream.foreachBatch(lambda df, i: box.step(df, i, lambda rows: scored_within(rows, coef, intercept, feature)))
     .option("checkpointLocation", scratch_path(spark, f"{name}-log")).trigger(availableNow=True).start().awaitTermination())
    read = lambda table: spark.read.option("recursiveFileLookup", "true").parquet(f"{box.path}/{table}")
    return read("scores"), read("late")
