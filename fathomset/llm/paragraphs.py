"""Repeated passages across documents: MinHash banding of paragraphs, exact Jaccard, components, removal.

A paragraph is a line of at least ``least_words`` words.  Its set of five-word shingles is signed with minwise hashes
whose bands are tuned to miss a pair of the asked similarity with a small chance; colliding paragraphs are verified by
exact Jaccard and clustered.  In each cluster that reaches over several documents the first paragraph stays and the
others are removed.

Passages that repeat inside longer lines, or across line breaks, are found by exact windows of words (``repeated_passages``):
of every ``reach`` consecutive windows the one with the smallest hash is kept, so that two texts that share
``window + reach - 1`` words in a row share a kept window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checked_broadcast, settle
from .bagminhash import SHINGLE, band_values, content_keys, shingles
from .common import fresh, lean, quoted, text_groups
from .near import SIMILARITY, bands_for, classes
from .winnowing import winnow
from .words import MIX, NEVER, Words, blocks, words_of

LEAST_WORDS = 20
BAND_ROWS = 4
#: Chance that a pair of exactly the asked similarity shares no band.
MISS = 1e-3
#: Words of a window, and of how many windows in a row one is kept; no more than a window's words, so that kept ones leave no gap.
WINDOW, REACH = 20, 20

_LINE = pa.struct([("paragraph", pa.int32()), ("first", pa.int64()), ("until", pa.int64()), ("words", pa.int64()), ("key", pa.int64()),
                   ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])
_LINE_SQL = "array<struct<paragraph:int,first:long,until:long,words:long,key:long,size:long,bands:array<long>>>"


def _lines(texts: list[str]) -> tuple[list[tuple[int, int, int]], Words]:
    """(text, line number, first character) of all lines, and the lines' words."""
    found, raw = [], []
    for i, text in enumerate(texts):
        at = 0
        for n, line in enumerate(text.split("\n")):
            found.append((i, n, at))
            raw.append(line.encode())
            at += len(line) + 1
    return found, words_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def minhashes(grams: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """The smallest value of each of ``count`` hash functions over each set (largest value for an empty one)."""
    random = np.random.default_rng(2).integers(0, 1 << 63, (count, 2), dtype=np.uint64)
    table = np.full((len(first) - 1, count), np.uint64(0xFFFFFFFFFFFFFFFF))
    held = np.flatnonzero(np.diff(first))
    if len(held):
        for k, (a, b) in enumerate(random):
            h = (grams ^ a) * (b | np.uint64(1))
            h ^= h >> np.uint64(31)
            h *= MIX
            table[held, k] = np.minimum.reduceat(h, first[held])
    return table


def _sketcher(least_words: int, bands: int, rows: int, shingle: int):
    @F.arrow_udf(_LINE_SQL)
    @lean
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            # columns, not rows of Python objects, are held until the batch is complete
            out = [pa.array([], pa.list_(_LINE))]
            for group in text_groups(column, 1 << 19):
                lines, words = _lines(group)
                counts = np.diff(words.first)
                long_enough = np.flatnonzero(counts >= least_words)
                if not len(long_enough):
                    out.append(pa.array([[]] * len(group), pa.list_(_LINE)))
                    continue
                keep = np.repeat(counts >= least_words, counts)
                some = Words(words.data, words.hashes[keep], words.begins[keep], words.ends[keep], np.concatenate([[0], np.cumsum(counts[long_enough])]))
                grams, first = shingles(some, shingle)
                text, number, begin = (np.array(x)[long_enough] for x in zip(*lines, strict=True))
                # a line ends before the next line's break, the last of a text with the text
                ends = np.array([lines[n + 1][2] - 1 if n + 1 < len(lines) and lines[n + 1][0] == lines[n][0] else len(group[lines[n][0]]) for n in long_enough.tolist()], np.int64)
                sizes = np.array([len(np.unique(grams[a:b])) for a, b in zip(first, first[1:], strict=False)], np.int64)
                values = band_values(minhashes(grams, first, bands * rows), rows)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, bands), pa.int32()), pa.array(values.ravel()))
                found = pa.StructArray.from_arrays([pa.array(number, pa.int32()), pa.array(begin, pa.int64()), pa.array(ends), pa.array(counts[long_enough], pa.int64()),
                                                    pa.array(content_keys(some)), pa.array(sizes), listed], fields=list(_LINE))
                out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(group) + 1)), pa.int32()), found))
            yield pa.concat_arrays(out)

    return sketch


def _contents(texts: DataFrame, least_words: int, shingle: int) -> DataFrame:
    """Rows (key, hashes) of the paragraphs of a table (t), a group of texts at a time."""
    @lean
    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in text_groups(batch.column(0), 1 << 19):
                _, words = _lines(group)
                keys = content_keys(words)
                grams, first = shingles(words, shingle)
                held = np.flatnonzero(np.diff(words.first) >= least_words).tolist()
                sets = [np.unique(grams[first[n]:first[n + 1]].view(np.int64)) for n in held]
                yield pa.RecordBatch.from_arrays([pa.array(keys[held], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "hashes"])

    return texts.select("t").mapInArrow(contents, "key long, hashes array<long>")


def repeated_paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, similarity: float = SIMILARITY,
                        rows: int = BAND_ROWS, miss: float = MISS, shingle: int = SHINGLE) -> DataFrame:
    """One row per paragraph whose cluster reaches over several documents.

    Columns: doc_id, paragraph (line number), first and until (its characters), words, cluster_doc and
    cluster_paragraph (the first paragraph of its cluster), cluster_size, removed (all but the first).  Null and empty
    texts have no paragraphs; a passage repeated within one document alone is not reported; rows with the same id
    and text are one document; a row without id takes part with a null doc_id, which comes last in its cluster.
    """
    bands = bands_for(similarity, rows, miss)
    found = docs.select(quoted(doc_id).alias("doc_id"), F.explode(_sketcher(least_words, bands, rows, shingle)(quoted(text))).alias("p")).select("doc_id", "p.*")
    found = settle(found)
    units = found.groupBy("key").agg(F.first("size").alias("size"), F.first("bands").alias("bands"), F.min("doc_id").alias("doc_id"))

    def contents(keys: DataFrame) -> DataFrame:
        """The shingle sets of these keys, from one document of each."""
        holders = units.join(keys, "key", "left_semi").select("doc_id").distinct()
        texts = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("t"))
        named = texts.join(checked_broadcast(holders), "doc_id", "left_semi").union(texts.where("doc_id IS NULL"))
        return _contents(named, least_words, shingle).join(checked_broadcast(keys), "key", "left_semi").groupBy("key").agg(F.first("hashes").alias("hashes"))

    roots = classes(units.select("key", "size", "bands"), contents, similarity)
    placed = found.select("doc_id", "paragraph", "first", "until", "words", "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "paragraph")
    clusters = (placed.groupBy("root").agg(F.min(order).alias("c"), F.count("*").alias("cluster_size"),
                                           F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max(F.col("doc_id").isNull()).alias("n"))
                .where("a <> b OR (n AND a IS NOT NULL)").select("root", F.col("c.doc_id").alias("cluster_doc"), F.col("c.paragraph").alias("cluster_paragraph"), "cluster_size"))
    first = F.col("doc_id").eqNullSafe(F.col("cluster_doc")) & (F.col("paragraph") == F.col("cluster_paragraph"))
    return (placed.join(clusters, "root").select("doc_id", "paragraph", "first", "until", "words", "cluster_doc", "cluster_paragraph", "cluster_size",
                                                 (~first).alias("removed")))


_PRINT = pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("until", pa.int32()), ("line", pa.int32())])


def _windows(window: int, reach: int):
    @F.arrow_udf("array<struct<hash:long,at:int,first:int,until:int,line:int>>")
    @lean
    def windows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = [pa.array([], pa.list_(_PRINT))]
            for data, offsets in blocks(column):
                words = words_of(data, offsets)
                grams = words.grams(window)
                # no window begins in the last words of a text, nor before the first text: the windows at either end of a text are kept
                kept = np.flatnonzero(winnow(np.append(np.full(reach - 1, NEVER), grams), reach)[reach - 1:])
                bounds = np.searchsorted(kept, words.first)
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
                # characters and line breaks before each byte
                chars, lines = (np.append(0, np.cumsum(x, dtype=np.int32)) for x in ((data & 0xC0) != 0x80, data == 10))
                begins, ends = words.begins[kept], words.ends[kept + window - 1]
                found = [grams[kept].astype(np.int64), kept - words.first[text], chars[begins] - chars[offsets[text]], chars[ends] - chars[offsets[text]], lines[begins] - lines[offsets[text]]]
                listed = pa.StructArray.from_arrays([pa.array(x.astype(f.type.to_pandas_dtype()), f.type) for x, f in zip(found, _PRINT, strict=True)], fields=list(_PRINT))
                out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), listed))
            yield pa.concat_arrays(out)

    return windows


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, reach: int = REACH) -> DataFrame:
    """One row per passage of a document whose words stand in another document too, wherever lines begin or end.

    Columns as of ``repeated_paragraphs``: paragraph is the line in which the passage begins, the cluster's document the first one that
    holds its windows, cluster_size the most places that hold one of them; removed is false where the passage stands there for
    the first time.  A passage is a run of kept windows without a gap that repeat the same document.  Every run of ``window + reach - 1``
    words that two documents share is found; its ends are found to within ``reach - 1`` words, those at the ends of a text exactly.
    Copies are known by a 63-bit hash of each window's words.  Null texts and ids as there.
    """
    if reach > window:
        raise ValueError("kept windows would leave gaps")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), quoted(doc_id).alias("doc_id"), quoted(text).alias("t"))
    found = settle(texts.select("row", "doc_id", F.explode(_windows(window, reach)("t")).alias("p")).select("row", "doc_id", "p.*"))
    shared = (found.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max(F.col("doc_id").isNull()).alias("n"))
              .where("a <> b OR (n AND a IS NOT NULL)").select("hash"))
    hits = settle(found.join(checked_broadcast(shared), "hash", "left_semi"))
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "at", "line")
    owners = hits.groupBy("hash").agg(F.min(order).alias("c"), F.count("*").alias("places"))
    again = ~(F.col("doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("at") == F.col("c.at")))
    placed = hits.join(owners, "hash").select("row", "doc_id", "at", "first", "until", "line", "places", F.col("c.doc_id").alias("cluster_doc"), F.col("c.line").alias("cluster_line"), again.alias("removed"))
    own = Window.partitionBy("row").orderBy("at")
    last = lambda c: F.lag(c).over(own)
    opens = last("at").isNull() | (F.col("at") - last("at") > window) | ~last("cluster_doc").eqNullSafe(F.col("cluster_doc")) | (last("removed") != F.col("removed"))
    runs = placed.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(own))
    return (runs.groupBy("row", "run").agg(F.first("doc_id").alias("doc_id"), F.min("line").alias("paragraph"), F.min("first").cast("long").alias("first"), F.max("until").cast("long").alias("until"),
                                           (F.max("at") + window - F.min("at")).cast("long").alias("words"), F.first("cluster_doc").alias("cluster_doc"),
                                           F.min_by("cluster_line", "at").alias("cluster_paragraph"), F.max("places").alias("cluster_size"), F.first("removed").alias("removed"))
            .drop("row", "run"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with removed paragraphs cut out of the text (their line breaks too); rows and other columns stay."""
    cuts = (repeated_paragraphs(docs, doc_id, text, **options).where("removed AND doc_id IS NOT NULL").groupBy("doc_id")
            .agg(F.collect_set("paragraph").alias("gone")).withColumnRenamed("doc_id", fresh(docs, "cut_id")))
    gone, cut = fresh(docs, "gone"), fresh(docs, "cut_id")
    joined = docs.join(cuts.withColumnRenamed("gone", gone), quoted(doc_id) == quoted(cut), "left")
    kept = F.array_join(F.filter(F.split(quoted(text), "\n", -1), lambda _, i: ~F.array_contains(quoted(gone), i)), "\n")
    return joined.select(*[(F.when(quoted(gone).isNull(), quoted(c)).otherwise(kept) if c == text else quoted(c)).alias(c) for c in docs.columns])
