"""Near-duplicate documents by weighted minwise hashing of word shingles (bags, not sets).

A document is the bag of its five-word shingles.  Weights are discretised to whole counts and covered by dyadic
ranges (0, 1], (1, 2], (2, 4], (4, 8] ...  Each shingle has an independent Poisson process of points for each range, whose
rate is the range's width; a point carries a value, a register and a level within its range, and counts for all bags
whose weight reaches that level.  A register keeps its smallest value.  Two bags agree in a register with probability
equal to their weighted Jaccard similarity, and a weight ``w`` costs log(w) processes instead of ``w``.  Processes
stop as soon as their next value exceeds all of the bag's registers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checked_broadcast, settle
from .common import fresh, give_back, quoted
from .near import SIMILARITY, bands_for, classes
from .words import STEP, Words, blocks, mixed, words_of

SHINGLE = 5
BAND_ROWS = 4
#: Chance that a pair of exactly the asked similarity shares no band.
MISS = 1e-4
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _nth(n: int) -> np.uint64:
    return np.uint64(n * int(_GOLD) % (1 << 64))


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and where each text's begin (one more than texts).

    A text of fewer than ``size`` words, but not none, has one shingle of all of them.
    """
    counts = np.diff(words.first)
    grams = words.grams(size)
    start = words.first[:-1]
    stop = np.repeat(words.first[1:], counts)
    keep = np.arange(len(grams)) + size <= stop
    for i in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        a, n = int(start[i]), int(counts[i])
        acc = words.hashes[a:a + 1].copy()
        for j in range(1, n):
            acc = acc * STEP + words.hashes[a + j:a + j + 1]
        grams[a], keep[a] = (mixed(acc + np.uint64(n)) >> np.uint64(1))[0], True
    total = np.concatenate([[0], np.cumsum(keep)])
    return grams[keep], total[words.first]


def content_keys(words: Words) -> np.ndarray:
    """A 64-bit hash of each text's sequence of words."""
    counts = np.diff(words.first)
    place = (np.arange(len(words.hashes)) - np.repeat(words.first[:-1], counts)).astype(np.uint64)
    each = mixed((words.hashes ^ (place + np.uint64(1)) * _GOLD) * STEP)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
    return mixed(sums[words.first[1:]] - sums[words.first[:-1]] + counts.astype(np.uint64)).view(np.int64)


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """Register values (docs x registers, infinite for a document without elements) of bags given as triples."""
    table = np.full(docs * registers, np.inf)
    top = int(weight.max(initial=0)).bit_length() + 1
    owner, seed, rate, low, most = [], [], [], [], []
    for level in range(top):
        floor = 0 if level == 0 else 1 << (level - 1)
        reach = np.flatnonzero(weight > floor)
        if len(reach):
            owner.append(doc[reach])
            seed.append(mixed(element[reach] * STEP + np.uint64(level + 1)))
            width = max(floor, 1)
            rate.append(np.full(len(reach), float(width)))
            low.append(np.full(len(reach), floor))
            most.append(weight[reach])
    if not owner:
        return table.reshape(docs, registers)
    owner, seed, rate, low, most = (np.concatenate(x) for x in (owner, seed, rate, low, most))
    value, step = np.zeros(len(owner)), 0
    limit = np.full(docs, np.inf)
    while len(owner):
        draw = mixed(seed + _nth(2 * step + 1))
        value = value - np.log(_unit(draw)) / rate
        alive = value < limit[owner]
        owner, seed, rate, low, most, value = (x[alive] for x in (owner, seed, rate, low, most, value))
        draw = mixed(seed + _nth(2 * step + 2))
        register = ((draw >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
        place = low + np.floor((draw & np.uint64(0xFFFFFFFF)).astype(np.float64) / float(1 << 32) * rate).astype(np.int64)
        reached = place < most
        np.minimum.at(table, owner[reached] * registers + register[reached].astype(np.int64), value[reached])
        touched = np.unique(owner)
        limit[touched] = table.reshape(docs, registers)[touched].max(axis=1)
        step += 1
    return table.reshape(docs, registers)


def bags(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of each distinct shingle of each document."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[starts], grams[starts], np.diff(np.append(starts, len(doc)))


def band_values(table: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each ``rows`` registers."""
    parts = table.view(np.uint64).reshape(len(table), -1, rows)
    out = np.zeros(parts.shape[:2], np.uint64)
    for r in range(rows):
        out = mixed(out * STEP + parts[:, :, r])
    return out.view(np.int64)


_SKETCH = pa.struct([("key", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sketcher(bands: int, rows: int, shingle: int):
    @F.arrow_udf("struct<key:long,size:long,bands:array<long>>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out: list[dict] = []
            for data, offsets in blocks(column):
                words = words_of(data, offsets)
                grams, first = shingles(words, shingle)
                sizes, keys = np.diff(first), content_keys(words)
                values = band_values(signatures(*bags(grams, first), len(sizes), bands * rows), rows)
                out += [{"key": k, "size": n, "bands": v if n else None}
                        for k, n, v in zip(keys.tolist(), sizes.tolist(), values.tolist(), strict=True)]
            yield pa.array(out, _SKETCH)
        give_back()

    return sketch


def _contents(texts: DataFrame, shingle: int) -> DataFrame:
    """Rows (own, hashes) of a table (t): content keys and bags, the repeats of a shingle under hashes of their own.

    Bags leave a block of texts at a time, so that a batch of long documents is never held as a whole.
    """
    names = ["own", "hashes"]

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, at in blocks(batch.column(0)):
                words = words_of(data, at)
                doc, gram, count = bags(*(found := shingles(words, shingle)))
                turn = np.arange(len(found[0])) - np.repeat(np.cumsum(count) - count, count)
                every = np.repeat(gram, count) ^ mixed(turn.astype(np.uint64) * _GOLD)  # the first keeps its hash
                lists = pa.ListArray.from_arrays(pa.array(found[1].astype(np.int32)), pa.array(every.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(content_keys(words)), lists], names=names)
        give_back()

    return texts.select("t").mapInArrow(contents, "own long, hashes array<long>")


def _content_key(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The content key of a text; null where it has no word."""
    for column in batches:
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for data, offsets in blocks(column):
            words = words_of(data, offsets)
            keys.append(content_keys(words))
            counts.append(np.diff(words.first))
        yield pa.array(np.concatenate(keys), mask=np.concatenate(counts) == 0)
    give_back()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, rows: int = BAND_ROWS,
                    miss: float = MISS, shingle: int = SHINGLE) -> DataFrame:
    """One row (doc_id, key, root) per row of ``docs``: ``key`` tells equal word sequences, ``root`` the class.

    Classes are the components of all verified links of at least that similarity.  A null, empty or wordless text has
    null key and root: it is near to nothing, not even to its like.  Repeated rows and null ids are classed by their
    text; other columns are not used; an empty table gives an empty table.
    """
    bands = bands_for(similarity, rows, miss)
    sketched = settle(docs.select(quoted(doc_id).alias("doc_id"), _sketcher(bands, rows, shingle)(quoted(text)).alias("s"))
                      .select("doc_id", F.when(F.col("s.size") > 0, F.col("s.key")).alias("key"), "s.size", "s.bands"))
    units = (sketched.where("key IS NOT NULL").groupBy("key")
             .agg(F.first("size").alias("size"), F.first("bands").alias("bands"), F.min("doc_id").alias("doc_id")))

    def contents(keys: DataFrame) -> DataFrame:
        """The bags of these keys, from one document of each."""
        wanted = units.join(keys, "key", "left_semi").where("doc_id IS NOT NULL").select("doc_id", "key")
        texts = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("t"))
        named = texts.join(checked_broadcast(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
        nameless = texts.where("doc_id IS NULL")  # all of them: their keys tell which are asked for
        whole = (_contents(named.union(nameless), shingle).withColumnRenamed("own", "key")
                 .join(checked_broadcast(keys), "key", "left_semi"))
        return whole.groupBy("key").agg(F.first("hashes").alias("hashes"))

    roots = classes(units, contents, similarity)
    return sketched.select("doc_id", "key").join(roots, "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))


def with_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row (doc_id, class_id, class_size) per row: the smallest id of the class and its number of rows.

    A text without words is a class of its own, as is a row without id whose class holds no other id (class_id null).
    """
    found = settle(near_duplicates(docs, doc_id, text, **options))
    sizes = found.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    named = found.where("root IS NOT NULL").join(sizes, "root").select("doc_id", "class_id", "class_size")
    return named.union(found.where("root IS NULL").select("doc_id", F.col("doc_id"), F.lit(1).cast("long")))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` less near duplicates: of each class the row with the smallest id stays (then by all columns).

    Rows without words all stay.  Columns stay as they are.
    """
    found = near_duplicates(docs, doc_id, text, **options).where("root IS NOT NULL")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("b")).select("b.doc_id", "b.key")
    key, mark = fresh(docs, "content_key"), fresh(docs, "kept_key")
    keyed = docs.withColumn(key, F.arrow_udf(_content_key, "long")(quoted(text)))
    first = keyed.join(best.withColumnRenamed("key", mark).withColumnRenamed("doc_id", mark + "id"),
                       (quoted(key) == quoted(mark)) & quoted(doc_id).eqNullSafe(quoted(mark + "id")), "left_semi")
    # repeated rows of the chosen document: one of them
    once = first.groupBy(quoted(key)).agg(F.min(F.struct(*[quoted(c) for c in docs.columns])).alias("row"))
    return once.select(*[F.col("row")[c].alias(c) for c in docs.columns]).unionByName(keyed.where(quoted(key).isNull()).drop(key))
