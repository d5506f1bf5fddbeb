"""Removal of byte strings that occur more than once, with a distributed suffix array over chosen suffixes.

Sorting every suffix would ship hundreds of times the text, so suffixes are chosen by content: of each ``REACH`` consecutive
k-grams the one with the smallest hash is an *anchor* (the first of equals).  A window (``LENGTH`` bytes from some place) is
handled at the anchor of its first ``REACH`` k-grams; two equal windows have their anchors at the same distance.  An anchor's
*context* is the union of its windows.

1. Anchors are counted by the hash of the bytes that all their possible windows share (the core), and by the hashes of core
   and context.  An anchor whose core is unique has no repeated window; equal contexts repeat all their windows.  Only
   one context of each kind is compared further, and only where a core has several.
2. These suffixes (the bytes from the anchor on, ties by the bytes before it) are range-partitioned by sampled splitters over
   the whole suffix, so that no common passage is too hot for a bucket.  Each bucket is sorted by multikey quicksort, eight
   bytes being a key, and neighbours are compared, those on both sides of a boundary too: what a pair has in common behind and before the
   anchor are its repeated windows.
3. The longest common prefix with a neighbour also says which windows can be repeated at all.  What is open (a third suffix may
   share more on the left) is settled by choosing suffixes more densely: every 25th byte before the anchor, then
   every 5th, then each one, for which neighbours decide.  Only runs of suffixes with an open member go on.

No step forms pairs within a group, and no group is held by one task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import fresh, lean, quoted
from .words import BYTE, blocks, mixed

LENGTH = 400
GRAM = 16
REACH = 200
#: Distance of the chosen suffixes in each round; the last is 1.
WIDTHS = (REACH, 25, 5, 1)
#: Bytes of suffixes in a bucket, about.
BUCKET = 8 << 20
#: Bytes of text whose anchors are looked for at a time.
BLOCK = 1 << 18

_HIT, _NEXT, _EDGE = 0, 1, 2
_MARKS = "row long, core long, ctx long, hi int, lo int, positions array<int>"
_SUFFIXES = "core long, ctx long, shift int, back binary, ahead binary"
_COMPARED = f"kind int, first int, last int, bucket int, side int, {_SUFFIXES}"
_CUT = "struct<n_removed:long,spans:array<struct<start:long,until:long>>,kept:binary>"
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@functools.lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Substrings:
    """Hashes of any substrings of ``data``."""

    def __init__(self, data: np.ndarray, base: int):
        n = max(BLOCK, 1 << len(data).bit_length())
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * _powers(base, n)[:len(data)], out=self.sums[1:])
        self.back = _powers(pow(base, -1, 1 << 64), n)

    def hashes(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[begins]) * self.back[begins])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, reach: int):
    """(anchor, farthest and nearest window start before it, as distances, core hash, context hash) in the texts of ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes, size = BYTE[data], 1
    while size < gram:
        step = min(size, gram - size)
        hashes = hashes[:-step] * np.uint64(_BASES[0]) + hashes[step:]
        size += step
    low = mixed(hashes) & np.uint64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size < reach:
        step = min(size, reach - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    starts = np.flatnonzero(np.arange(len(data)) + length <= np.repeat(offsets[1:], np.diff(offsets)))
    if not len(starts):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    at = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.flatnonzero(np.diff(at)) + 1
    first, last = starts[np.append(0, change)], starts[np.append(change - 1, len(at) - 1)]
    at = at[np.append(0, change)]
    core = Substrings(data, _BASES[0]).hashes(at, at + length - reach + 1)
    ctx = Substrings(data, _BASES[1]).hashes(first, last + length)
    return at, at - first, at - last, core, mixed(ctx + (at - first).astype(np.uint64))


def _find_marks(length: int, gram: int, reach: int):
    @lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, a = batch.column(0).to_numpy(), 0
            for data, offsets in blocks(batch.column(1), BLOCK):
                at, hi, lo, core, ctx = anchors(data, offsets, length, gram, reach)
                doc = np.searchsorted(offsets, at, "right") - 1
                # equal contexts of a text are one row with all their places
                order = np.lexsort((at, ctx, core, doc))
                at, hi, lo, core, ctx, doc = (x[order] for x in (at, hi, lo, core, ctx, doc))
                new = np.append(True, (np.diff(doc) != 0) | (core[1:] != core[:-1]) | (ctx[1:] != ctx[:-1])) if len(at) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                places = pa.ListArray.from_arrays(np.append(first, len(at)).astype(np.int32), (at - offsets[doc]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(rows[a + doc[first]]), pa.array(core[first].view(np.int64)), pa.array(ctx[first].view(np.int64)),
                                                  pa.array(hi[first].astype(np.int32)), pa.array(lo[first].astype(np.int32)), places],
                                                 ["row", "core", "ctx", "hi", "lo", "positions"])
                a += len(offsets) - 1

    return find


def _cut_contexts(length: int):
    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_py().encode()
                own = wanted.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([w["core"] for w in own], pa.int64()), pa.array([w["ctx"] for w in own], pa.int64()), pa.array([0] * len(own), pa.int32()),
                                                  pa.array([data[w["pos"] - w["hi"]:w["pos"]][::-1] for w in own], pa.binary()),
                                                  pa.array([data[w["pos"]:w["pos"] - w["lo"] + length] for w in own], pa.binary())],
                                                 ["core", "ctx", "shift", "back", "ahead"])

    return cut


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows by their columns: rows that tie in one column are sorted among themselves by the next."""
    order = np.argsort(keys[:, 0], kind="stable")
    starts = np.append(True, keys[order[1:], 0] != keys[order[:-1], 0])
    for column in range(1, keys.shape[1]):
        tied = np.flatnonzero(~(starts & np.append(starts[1:], True)))
        if not len(tied):
            break
        group = np.cumsum(starts)[tied]
        values = keys[order[tied], column]
        within = np.lexsort((values, group))
        order[tied], values = order[tied][within], values[within]
        starts[tied[1:]] |= values[1:] != values[:-1]
    return order


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes, filled up with 0xFF (which no UTF-8 text has) to a multiple of eight, and their lengths."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)
    out = np.full((len(column), -(-width // 8) * 8), 0xFF, np.uint8)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = data[offsets[0]:offsets[-1]]
    return out, sizes


def _common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the next."""
    if not rows.shape[1]:
        return np.zeros(len(rows) - 1, np.int64)
    differ = rows[1:] != rows[:-1]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(n, np.minimum(sizes[1:], sizes[:-1]))


def compare_bucket(suffixes: pa.Table, length: int, width: int, finer: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """Hits between neighbours of a bucket, the suffixes of the next round, and the bucket's first and last suffix."""
    ahead, n_ahead = _padded(suffixes["ahead"].combine_chunks(), length)
    back, n_back = _padded(suffixes["back"].combine_chunks(), width - 1)
    keys = np.concatenate([ahead, back], axis=1).view(">u8").astype(np.uint64)
    order = multikey_order(keys)
    del keys
    ahead, back, n_ahead, n_back = ahead[order], back[order], n_ahead[order], n_back[order]
    right, left = _common(ahead, n_ahead), _common(back, n_back)
    n = len(order)
    core, ctx, shift = (suffixes[c].to_numpy()[order] for c in ("core", "ctx", "shift"))

    def batch(kind: int, at: np.ndarray, shifts=None, first=None, last=None, side=None, backs=None, aheads=None) -> pa.RecordBatch:
        ints = lambda x: pa.array(np.zeros(len(at), np.int32) if x is None else np.asarray(x, np.int32))
        data = lambda x: pa.nulls(len(at), pa.binary()) if x is None else pa.array(x, pa.binary())
        return pa.RecordBatch.from_arrays(
            [ints(np.full(len(at), kind)), ints(first), ints(last), ints(np.full(len(at), bucket)), ints(side), pa.array(core[at]), pa.array(ctx[at]),
             ints(shift[at] if shifts is None else shifts), data(backs), data(aheads)],
            ["kind", "first", "last", "bucket", "side", "core", "ctx", "shift", "back", "ahead"])

    # windows i bytes before the suffix: i up to what is common before it, length - i up to what is common from it on
    pairs = np.flatnonzero(length - right <= left)
    at, first, last = np.concatenate([pairs, pairs + 1]), np.tile(length - right[pairs], 2), np.tile(left[pairs], 2)
    if len(at):
        _, once = np.unique(np.stack([at, first, last]), axis=1, return_index=True)
        yield batch(_HIT, at[once], None, shift[at[once]] + first[once], shift[at[once]] + last[once])
    ends = np.array([0, n - 1])
    row_bytes = lambda rows, sizes, i: rows[i, :sizes[i]].tobytes()
    yield batch(_EDGE, ends, side=[0, 1], backs=[row_bytes(back, n_back, i) for i in ends], aheads=[row_bytes(ahead, n_ahead, i) for i in ends])
    if not finer:
        return
    most = np.maximum(np.append(0, right), np.append(right, 0))
    steps = np.arange(width)[None, :]
    open_ = (steps >= (length - most)[:, None]) & (steps <= n_back[:, None])
    sure = np.zeros((n, width + 1), np.int16)
    np.add.at(sure, (at, first), 1)
    np.add.at(sure, (at, last + 1), -1)
    open_ &= np.cumsum(sure[:, :width], axis=1) == 0
    begins = np.flatnonzero(np.append(True, right < length - width + 1))
    runs = np.logical_or.reduceat(open_, begins, axis=0)
    runs[[0, -1]] = True  # these may go on beyond the bucket
    same = np.append(False, (right == n_ahead[1:]) & (n_ahead[1:] == n_ahead[:-1]) & (left == n_back[1:]) & (n_back[1:] == n_back[:-1]))
    run_of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, n)))
    needed = runs[run_of] & (steps <= n_back[:, None]) & (steps >= (length - n_ahead)[:, None])
    needed[same] = False  # one of several equal suffixes is enough for the others to meet
    for start in range(0, width, finer):
        at = np.flatnonzero(needed[:, start:start + finer].any(axis=1))
        for a in range(0, len(at), 4096):
            own = at[a:a + 4096]
            before = [row_bytes(back, n_back, i) for i in own]
            yield batch(_NEXT, own, shift[own] + start, backs=[b[start:start + finer - 1] for b in before],
                        aheads=[(b[:start][::-1] + row_bytes(ahead, n_ahead, i))[:length] for b, i in zip(before, own, strict=True)])


def _compare(length: int, width: int, finer: int):
    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if own:
            yield from compare_bucket(pa.Table.from_batches(own), length, width, finer, TaskContext.get().partitionId())

    return compare


def _across(compared: DataFrame, length: int) -> DataFrame:
    """Hits between the last suffix of a bucket and the first of the next one that is not empty."""
    edges = compared.where(F.col("kind") == _EDGE)
    following = edges.where("side = 0").select("bucket").withColumn("next", F.lead("bucket").over(Window.orderBy("bucket")))  # one row per bucket
    sides = [edges.where(f"side = {s}").select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in ("core", "ctx", "shift", "back", "ahead")]) for s in (0, 1)]
    met = sides[1].join(following, "bucket").join(sides[0].withColumnRenamed("bucket", "next"), "next")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                right, left = (next((k for k, (x, y) in enumerate(zip(r[f"{c}_0"], r[f"{c}_1"])) if x != y), min(len(r[f"{c}_0"]), len(r[f"{c}_1"]))) for c in ("ahead", "back"))
                if length - right <= left:
                    found += [{"core": r[f"core_{s}"], "ctx": r[f"ctx_{s}"], "first": r[f"shift_{s}"] + length - right, "last": r[f"shift_{s}"] + left} for s in (0, 1)]
            yield pa.RecordBatch.from_pylist(found, pa.schema([("core", pa.int64()), ("ctx", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))

    return met.mapInArrow(find, "core long, ctx long, first int, last int")


def repeated_windows(suffixes: DataFrame, length: int = LENGTH, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Rows (core, ctx, first, last): the windows from ``first`` to ``last`` bytes before a context's anchor that others hold too."""
    spark, hits = suffixes.sparkSession, []
    for width, finer in zip(widths, (*widths[1:], 0), strict=True):
        rows = suffixes.count()
        if not rows:
            break
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows * (length + width) // BUCKET + 1)
        # the ids come last in the order, so that equal suffixes can lie in several buckets
        ranged = suffixes.repartitionByRange(parts, "ahead", "back", "core", "ctx", "shift")
        compared = settle(ranged.mapInArrow(_compare(length, width, finer), _COMPARED))
        hits += [compared.where(F.col("kind") == _HIT).select("core", "ctx", "first", "last"), _across(compared, length)]
        suffixes = compared.where(F.col("kind") == _NEXT).select("core", "ctx", "shift", "back", "ahead")
    none = spark.createDataFrame([], "core long, ctx long, first int, last int")
    return functools.reduce(DataFrame.union, hits, none)


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    return starts[first], ends[np.append(first[1:] - 1, len(ends) - 1)]


@lean
def _cut(texts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.struct([("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("until", pa.int64())]))), ("kept", pa.binary())])
    for column, starts, untils in texts:
        rows = []
        for text, s, u in zip(column, starts, untils, strict=True):
            data = (text.as_py() or "").encode()
            if s.is_valid:
                begins, ends = _merged(s.values.to_numpy().astype(np.int64), u.values.to_numpy().astype(np.int64))
                edges = [0, *np.stack([begins, ends], axis=1).ravel().tolist(), len(data)]
                rows.append({"n_removed": int((ends - begins).sum()), "spans": [{"start": a, "until": b} for a, b in zip(begins.tolist(), ends.tolist(), strict=True)],
                             "kept": b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))})
            else:
                rows.append({"n_removed": 0, "spans": [], "kept": data})
        yield pa.array(rows, kind)


def without_repeats(docs: DataFrame, text: str = "text", out: str = "repeats", length: int = LENGTH, gram: int = GRAM, reach: int = REACH,
                    widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Add struct ``out`` (n_removed, spans of removed bytes, kept bytes) for the UTF-8 bytes of each text.

    A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else, in another row or in the same
    text.  So all copies of a passage go; rows that repeat as a whole are texts of their own.  Null is the empty text; a text of
    under ``length`` bytes loses nothing.  Other columns pass through; an empty table gives an empty table.
    """
    if gram + reach - 1 > length or widths[0] != reach or widths[-1] != 1:
        raise ValueError("k-grams of an anchor's reach must lie within a window; widths go from the reach to 1")
    out, row = fresh(docs, out), fresh(docs, "row")
    held = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    texts = held.select(quoted(row).alias("row"), quoted(text).alias("text")).where(F.octet_length("text") >= length)
    marks = settle(texts.mapInArrow(_find_marks(length, gram, reach), _MARKS))
    each = marks.groupBy("core", "ctx", "hi", "lo").agg(F.sum(F.size("positions")).alias("n"), F.min(F.struct("row", F.col("positions")[0].alias("pos"))).alias("at"))
    shared = each.groupBy("core").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1").select("core", "kinds")
    contexts = settle(each.join(shared, "core"))
    wanted = contexts.where("kinds > 1").groupBy(F.col("at.row").alias("row")).agg(F.collect_list(F.struct("core", "ctx", F.col("at.pos").alias("pos"), "hi", "lo")).alias("wanted"))
    suffixes = settle(texts.join(wanted, "row").select("text", "wanted").mapInArrow(_cut_contexts(length), _SUFFIXES))
    hits = contexts.where("n > 1").select("core", "ctx", F.col("lo").alias("first"), F.col("hi").alias("last")).union(repeated_windows(suffixes, length, widths))
    hits = settle(hits.groupBy("core", "ctx").agg(F.collect_set(F.struct("first", "last")).alias("hits")))
    spread = lambda end: F.flatten(F.transform("hits", lambda h: F.transform("positions", lambda p: p - h[end])))
    spans = (marks.join(hits, ["core", "ctx"]).select("row", spread("last").alias("s"), spread("first").alias("u")).groupBy("row")
             .agg(F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.transform(F.collect_list("u"), lambda u: F.transform(u, lambda x: x + length))).alias("u")))
    s, u = fresh(held, "s"), fresh(held, "u")
    spans = spans.select(F.col("row").alias(row), F.col("s").alias(s), F.col("u").alias(u))
    return held.join(spans, row, "left").select(*[quoted(c) for c in docs.columns], F.arrow_udf(_cut, _CUT)(quoted(text), quoted(s), quoted(u)).alias(out))
