"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to batch code in groups of about this many characters, whatever Spark's batch size is.
GROUP_CHARS = 1 << 21


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that ``df`` does not have (case aside)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def remainder_is(doc_id: Column, mod: int, value: int) -> Column:
    """Whether crc32 of the id's text has that remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == value


def grouped(texts: Iterable[str], limit: int = GROUP_CHARS) -> Iterator[list[str]]:
    """Consecutive texts in lists of about ``limit`` characters (one longer text is a list of its own)."""
    group: list[str] = []
    size = 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def text_groups(column: pa.Array, limit: int = GROUP_CHARS) -> Iterator[list[str]]:
    """The texts of an Arrow column, null as the empty text, in lists of about ``limit`` bytes.

    No more than a list is held as Python strings at a time, however many rows Spark puts into a batch.
    """
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())).to_numpy()
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield [t or "" for t in column.slice(a, b - a).to_pylist()]
        a = b
    pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Hand freed memory back to the system: a worker that waits for its next task else keeps what its last one needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library of Linux
    if trim:
        trim(0)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over a task's batches, after which the worker gives back what it freed (its last batch too)."""
    @functools.wraps(work)
    def run(batches):
        yield from work(batches)
        give_back()

    return run
