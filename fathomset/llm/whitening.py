"""Whitening of embeddings with MLlib block matrices.

Centred rows are indexed and dealt into the blocks of a ``BlockMatrix``.  Its transpose times itself is the scatter matrix,
whose eigenvectors are found on the driver (dimensions x dimensions, whatever the number of rows).  The block matrix times the
whitening matrix projects the rows, which are joined back to their columns by index; the projected block matrix's transpose
times itself shows how far the result is from white.

A block matrix keeps the places of its blocks on the driver, so a table is handled in slabs of at most ``SLAB_BLOCKS``
blocks; their scatter matrices add up.  Each block product is a task of its own, combined in the tasks before it is summed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Vectors, VectorUDT
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import delete_on_exit, scratch_path, settle
from .common import fresh, quoted

COMPONENTS = 32
#: Entries of a block, about (of 8 bytes each).
BLOCK_ENTRIES = 1 << 18
#: Columns of a block at most.
BLOCK_COLUMNS = 1024
#: Blocks of rows in a slab.
SLAB_BLOCKS = 1 << 16
#: Block products that a task sums.
PRODUCTS = 16
_ROW = StructType([StructField("index", LongType()), StructField("vector", VectorUDT())])


@dataclass
class Slab:
    """Consecutive write tasks of the table: first and last, the first row of each, and rows in all."""

    parts: list[tuple[int, int]]
    rows: int


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite numbers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def product(left: BlockMatrix, right: BlockMatrix) -> BlockMatrix:
    """``left @ right``, the shared dimension split so that no task holds many of its blocks."""
    shared = -(-left.numCols() // left.colsPerBlock)
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, max(1, shared // PRODUCTS))
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    return product(matrix.transpose(), matrix).toLocalMatrix().toArray()


def slabs_of(parts: list[tuple[int, int]], block_rows: int, slab_blocks: int) -> list[Slab]:
    """(write task, its rows) in slabs; a task's rows begin a block."""
    slabs: list[Slab] = []
    for part, rows in sorted(parts):
        padded = -(-rows // block_rows) * block_rows
        if not slabs or slabs[-1].rows + padded > slab_blocks * block_rows:
            slabs.append(Slab([], 0))
        slabs[-1].parts.append((part, slabs[-1].rows))
        slabs[-1].rows += padded
    return slabs


def whiten(vectors: DataFrame, vector: str = "embedding", out: str = "whitened", components: int = COMPONENTS,
           block_entries: int = BLOCK_ENTRIES, slab_blocks: int = SLAB_BLOCKS) -> DataFrame:
    """Add struct ``out`` (values, explained, n, deviation, identity_error) to the rows with a usable vector.

    ``values`` are the centred vector's projections on the unit eigenvectors of the covariance (divisor n), by falling
    eigenvalue, each over the eigenvalue's root; ``explained`` the eigenvalues over their sum; ``deviation`` the sum over the
    dimensions of ``(n x - S) ** 2``, exact for integer vectors; ``identity_error`` the largest absolute entry of the result's covariance
    minus the identity.

    Rows whose vector is null, empty or holds null or non-finite entries go.  The vectors' length is the most common one
    (of equally common ones the longest); rows of other lengths go too.  Repeated rows count each.  Directions without variance
    (an eigenvalue not above rounding) have no component: a table of equal vectors has empty ``values``.  Other
    columns pass through; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    whole = dict(vectors.dtypes)[vector] in ("array<bigint>", "array<int>")
    kind = "bigint" if whole else "double"
    out, cell, x, at, first_row, index = (fresh(vectors, c) for c in (out, "cell", "x", "part", "first", "index"))
    result = f"struct<values:array<double>,explained:array<double>,n:bigint,deviation:{'decimal(38,0)' if whole else 'double'},identity_error:double>"
    held = settle(vectors.where(usable(quoted(vector))).select("*", quoted(vector).cast(f"array<{kind}>").alias(x), F.monotonically_increasing_id().alias(cell)))
    common = held.groupBy(F.size(quoted(x)).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return vectors.limit(0).withColumn(out, F.lit(None).cast(result))
    d, n = common["d"], common["count"]
    held = held.where(F.size(quoted(x)) == d)
    part, local = F.shiftright(quoted(cell), 33), quoted(cell).bitwiseAND(F.lit((1 << 33) - 1))
    parts = [tuple(r) for r in held.groupBy(part.alias("part")).agg(F.max(local) + 1).collect()]  # a row per write task
    sums = [r["s"] for r in held.select(F.posexplode(quoted(x)).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).orderBy("i").collect()]
    away = F.zip_with(quoted(x), F.lit(sums).cast(f"array<{kind}>"), lambda v, s: v * F.lit(n) - s)
    square = (lambda acc, v: (acc + v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast("decimal(38,0)")) if whole else (lambda acc, v: acc + v * v)
    deviation = F.aggregate(away, F.lit(0).cast("decimal(38,0)" if whole else "double"), square)
    block_columns = min(d, BLOCK_COLUMNS)
    block_rows = max(1, block_entries // block_columns)
    slabs = slabs_of(parts, block_rows, slab_blocks)

    def rows_of(slab: Slab) -> DataFrame:
        first = spark.createDataFrame(slab.parts, f"`{at}` long, `{first_row}` long")  # a row per write task of the slab
        own = held.where(quoted(cell).between(slab.parts[0][0] << 33, (slab.parts[-1][0] + 1 << 33) - 1))
        return own.withColumn(at, part).join(F.broadcast(first), at).withColumn(index, quoted(first_row) + local)

    def blocks_of(slab: Slab) -> BlockMatrix:
        centred = F.transform(away, lambda v: v / F.lit(float(n)))
        rows = MLUtils.convertVectorColumnsFromML(rows_of(slab).select(quoted(index).alias("index"), array_to_vector(centred).alias("vector")), "vector")
        return IndexedRowMatrix(rows, slab.rows, d).toBlockMatrix(block_rows, block_columns)

    blocks = [blocks_of(s) for s in slabs]
    covariance = sum(scatter(b) for b in blocks) / n
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > d * np.finfo(float).eps * max(values.max(), 0)]
    if len(order):
        whitening = directions[:, order] / np.sqrt(values[order])
        rows = spark.createDataFrame([(i, Vectors.dense(w)) for i, w in enumerate(whitening)], _ROW)
        by = IndexedRowMatrix(rows, d, len(order)).toBlockMatrix(block_columns, len(order))
        path, left = scratch_path(spark, "whitened"), np.zeros((len(order), len(order)))
        for slab, matrix in zip(slabs, blocks, strict=True):
            projected = product(matrix, by)
            found = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
            found = found.toDF("index", "vector").select("index", vector_to_array("vector").alias("values"))
            rows = rows_of(slab).select(quoted(index).alias("index"), F.struct(*[quoted(c) for c in vectors.columns]).alias("row"), deviation.alias("deviation"))
            rows.join(found, "index").select("row", "values", "deviation").write.mode("append").parquet(path)
            left += scatter(projected)
        delete_on_exit(spark, path)
        done, error = spark.read.parquet(path), float(np.abs(left / n - np.eye(len(order))).max())
    else:
        done, error = held.select(F.struct(*[quoted(c) for c in vectors.columns]).alias("row"), F.array().cast("array<double>").alias("values"), deviation.alias("deviation")), 0.0
    explained = (values[order] / values.sum()).tolist() if len(order) else []
    found = F.struct(F.col("values"), F.lit(explained).cast("array<double>").alias("explained"), F.lit(n).cast("long").alias("n"), F.col("deviation"), F.lit(error).alias("identity_error"))
    return done.select(*[F.col("row").getField(c).alias(c) for c in vectors.columns], found.cast(result).alias(out))
