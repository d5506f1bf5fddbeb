"""Document fingerprints from content-defined chunks.

A gear hash runs over the UTF-8 bytes of a text; where its top bits are all zero a chunk may end.  Cutting is
normalised: before ``NORMAL`` bytes more zero bits are asked for than after, and no chunk is shorter than ``LEAST``
(the last one aside) or longer than ``MOST``.  Boundaries depend on the last 32 bytes only, so an edit moves the
chunks around it and no others.  The fingerprint is the set of chunk digests with their lengths; likeness is the
length of the shared chunks over that of the smaller set (containment).
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GROUP_CHARS, fresh, grouped, quoted, text_groups

LEAST, NORMAL, MOST = 32, 64, 256
STRICT_BITS, LOOSE_BITS = 7, 5
WINDOW = 32
#: Documents in a partition when neighbours are brought together, and partitions at most.
ROWS, PARTITIONS = 8192, 20_000

_GEAR = np.random.default_rng(4).integers(0, 1 << 32, 256, dtype=np.uint32)
_GAP = bytes(WINDOW)

Chunks = dict[int, int]


def _gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sum over the last 32 bytes of their gear value, doubled for each step back."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:
        shifted = h[:-step] << np.uint32(step)
        h[step:] += shifted
        step *= 2
    return h


def chunk_sets(texts: list[str]) -> list[Chunks]:
    """Digest -> length of the distinct chunks of each text."""
    raw = [t.encode() for t in texts]
    data = _GAP + _GAP.join(raw)  # the gap gives each text the same start, whatever stands before it
    h = _gear(np.frombuffer(data, np.uint8).copy())
    loose_at = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0) + 1
    loose = loose_at.tolist()
    strict = loose_at[h[loose_at - 1] >> np.uint32(32 - STRICT_BITS) == 0].tolist()
    loose.append(len(data) + MOST)
    strict.append(len(data) + MOST)
    out, at, digest = [], WINDOW, xxhash.xxh64_intdigest
    for own in raw:
        end, found = at + len(own), {}
        i, j = bisect_left(strict, at), bisect_left(loose, at)
        while at < end:
            low, mid = at + LEAST, at + NORMAL
            while strict[i] < low:
                i += 1
            if strict[i] < mid:
                cut = strict[i]
            else:
                while loose[j] < mid:
                    j += 1
                cut = loose[j] if loose[j] < at + MOST else at + MOST
            if cut > end:
                cut = end
            found[digest(data[at:cut])] = cut - at
            at = cut
        out.append(found)
        at = end + WINDOW
    return out


def to_text(chunks: Chunks) -> str:
    """Digests in order with their lengths, ten bytes each, in base 64."""
    return base64.b64encode(b"".join(d.to_bytes(8, "big") + n.to_bytes(2, "big") for d, n in sorted(chunks.items()))).decode()


def from_text(fingerprint: str) -> Chunks:
    raw = base64.b64decode(fingerprint)
    return {int.from_bytes(raw[i:i + 8], "big"): int.from_bytes(raw[i + 8:i + 10], "big") for i in range(0, len(raw), 10)}


def likeness(a: Chunks, b: Chunks) -> float:
    """Shared length over the smaller set's; 1 for two empty sets, 0 if one of them is empty."""
    if not a or not b:
        return float(not a and not b)
    return sum(a[d] for d in a.keys() & b.keys()) / min(sum(a.values()), sum(b.values()))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every text (null: that of the empty text, which is the empty string)."""

    @F.arrow_udf("string")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([to_text(c) for group in text_groups(column) for c in chunk_sets(group)], pa.string())

    return docs.withColumn(fresh(docs, out), compute(quoted(text)))


def _neighbourhoods(rows: DataFrame) -> DataFrame:
    """Deal rows (id, t) into ranges of ids, each followed by a copy of the first row of the next range.

    The ranges' first ids are ids of the table, so a row tells by its own id whether its copy is needed elsewhere.
    """
    ids = rows.select("id").where("id IS NOT NULL")
    n = ids.count()
    parts = max(1, min(-(-n // ROWS), PARTITIONS))
    first, cuts = ids.select(F.min("id"), F.percentile_approx("id", [i / parts for i in range(parts)], max(10_000, 20 * parts))).first()
    starts = np.array(sorted({c for c in cuts or [] if c > first}), np.int64)
    last = len(starts)

    @F.arrow_udf("array<struct<bucket:int,place:int>>")
    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("bucket", pa.int32()), ("place", pa.int32())]))
        for column in batches:
            own = column.to_numpy(zero_copy_only=False).astype(np.int64)
            bucket = np.searchsorted(starts, own, "right")
            heads = np.isin(own, starts)
            yield pa.array([[{"bucket": b, "place": 0}] + [{"bucket": b - 1, "place": 1}] * h + [{"bucket": last, "place": 1}] * (i == first)
                            for i, b, h in zip(own.tolist(), bucket.tolist(), heads.tolist(), strict=True)], kind)

    ordered = rows.where("id IS NOT NULL").withColumn("at", F.explode(places("id"))).select("id", "t", "at.bucket", "at.place")
    rest = rows.where("id IS NULL").select("id", "t", F.pmod(F.xxhash64("t"), F.lit(last + 1)).cast("int").alias("bucket"), F.lit(2).alias("place"))
    return ordered.unionByName(rest).repartitionById(last + 1, "bucket").sortWithinPartitions("bucket", "place", "id", "t")


def compare_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document are.

    The next document is the one that follows by ascending integer id; after the last comes the first, so a single
    document follows itself.  Of rows with one id, the next is the one next by text.  A row without an id stands
    outside the order: an empty text follows it.  Null texts are empty; other columns are not used; an empty table
    gives an empty table.  Texts are shuffled once.
    """
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(quoted(doc_id).cast("long").alias("id"), F.coalesce(quoted(text), F.lit("")).alias("t"))
    out_type = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                          ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def batch(part: list[tuple], following: list[tuple]) -> pa.RecordBatch:
        """part, following: (id, text, chunks) of documents and of those after them."""
        changed = [edited(t, f) for (_, t, _), (_, f, _) in zip(part, following, strict=True)]
        sets = chunk_sets(changed)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((
            [i for i, _, _ in part], [len(t) for _, t, _ in part], [hashlib.sha256(c.encode()).hexdigest() for c in changed],
            [to_text(c) for _, _, c in part], [to_text(s) for s in sets],
            [likeness(c, s) for (_, _, c), s in zip(part, sets, strict=True)],
            [likeness(c, f) for (_, _, c), (_, _, f) in zip(part, following, strict=True)]), out_type.types, strict=True)], schema=out_type)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # the last document, whose next one has not come yet
        where, size = -1, 0
        part: list[tuple] = []
        following: list[tuple] = []
        for b in batches:
            ids, texts, buckets, placed = (b.column(i).to_pylist() for i in range(4))
            at = 0
            for group in grouped(texts):
                for t, chunks in zip(group, chunk_sets(group), strict=True):
                    row, bucket, place = (ids[at], t, chunks), buckets[at], placed[at]
                    at += 1
                    if place == 2:
                        part.append(row)
                        following.append((None, "", {}))
                    else:
                        if waiting is not None and bucket == where:
                            part.append(waiting)
                            following.append(row)
                        waiting, where = (row if place == 0 else None), bucket
                    size += len(t)
                    if size > GROUP_CHARS:
                        yield batch(part, following)
                        part, following, size = [], [], 0
        if part:
            yield batch(part, following)

    return (_neighbourhoods(rows).select("id", "t", "bucket", "place")
            .mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
            .withColumn("doc_id", F.col("doc_id").cast(kind)))
