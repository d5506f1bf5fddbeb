"""Session settings and the few places where a job materialises something."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows above which a helper table is never broadcast explicitly.
BROADCAST_ROWS = 200_000
#: Bytes of written files above which a helper table is never broadcast explicitly.
BROADCAST_BYTES = 16 << 20
#: Estimated size below which Catalyst is left to choose the join side by itself.
SMALL_BYTES = 8 << 20


def build_session(cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library expects (UTC, adaptive execution, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fathomset")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes for scans, real sizes for materialised caches)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def settle(df: DataFrame) -> DataFrame:
    """Materialise a table that several later steps read, as a written table in the shared folder.

    Later plans start from a plain scan: their lineage is short, the true size is known to Catalyst, and
    a lost executor costs a re-read rather than a recomputation. The table goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the folder removed when the driver's JVM shuts down."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only when its size is known to be within bounds.

    A plan whose estimate is already tiny is left to Catalyst, which broadcasts it by its own rule.
    Otherwise the table is materialised (so it is computed once); beyond ``max_rows`` rows or ``BROADCAST_BYTES``
    of files it is returned without a hint and the join shuffles as usual.
    """
    if estimated_bytes(df) <= SMALL_BYTES:
        return df
    kept = settle(df)
    within = estimated_bytes(kept) <= BROADCAST_BYTES and kept.count() <= max_rows
    return F.broadcast(kept) if within else kept


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session, or its checkpoint folder.

    Only where the session names neither and runs inside one process (a test) is a temporary one made; on a
    cluster that is an error, since executors don't share a local folder. No session setting is changed.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    made = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a derived table."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")
