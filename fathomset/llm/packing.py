"""Best-fit-decreasing packing of tokenised documents with certified bin counts and repacking of the gaps.

1. Each document becomes pieces of at most ``capacity`` tokens (only longer documents are cut).
2. Pieces are spread by hash over partitions of about ``per_partition`` pieces; each is packed best fit decreasing.
3. Each partition's number of bins is held against a lower bound from dual feasible functions.  A bound that equals
   the number proves the partition optimal.  A partition with a gap gives back the documents of its emptiest bins.
4. What was given back by all partitions is exchanged into fewer partitions and packed again, until nothing is left
   or one partition has packed it all.

Pieces, never texts, move; a partition is as large as ``per_partition`` says, whatever the input's size.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import settle
from .common import grouped, quoted
from .token_counts import load_tokenizer

CAPACITY = 2048
PER_PARTITION = 100_000
#: Partitions of one round that share a partition of the next.
FAN_IN = 16
#: Words whose ids a worker remembers at most.
MEMO_WORDS = 400_000

#: Texts of these characters alone have no composing marks and lower-case letter by letter, so that words can be
#: encoded one by one; others, and those that may hold a special string, are encoded whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ž]*")
#: The word pattern that the vocabulary file states.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordEncoder:
    """Ids of texts as bytes (little-endian, four a token), remembering the words it has seen."""

    def __init__(self, path: str, end_of_word: str = "</w>"):
        self.tokenizer: Tokenizer = load_tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(end_of_word)]] = True
        self.memo: dict[str, bytes] = {}

    def _learned(self, words: list[str]) -> dict[str, bytes]:
        found = {}
        for at in range(0, len(words), 1000):
            part = words[at:at + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("the vocabulary does not end each word with one marked token")
            raw, begin = ids.tobytes(), 0
            for word, stop in zip(part, stops.tolist(), strict=True):
                found[word] = raw[4 * begin:4 * stop]
                begin = stop
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [_PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        words = [_WORD.findall(t.lower()) if p else [] for t, p in zip(texts, plain, strict=True)]
        new = self._learned(list(set().union(*words).difference(self.memo)))
        full = len(self.memo) + len(new) > MEMO_WORDS
        self.memo.update(new)
        rest = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        look = self.memo.__getitem__
        out = [b"".join(map(look, w)) if p else np.array(next(rest).ids, "<u4").tobytes() for w, p in zip(words, plain, strict=True)]
        if full:  # the earliest words, which are mostly the commonest, stay
            for word in new:
                del self.memo[word]
        return out


@functools.cache
def encoder_of(path: str) -> WordEncoder:
    """One for all tasks of a worker."""
    return WordEncoder(path)


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY,
           end_id: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) of every document's ids, each document closed by ``end_id``."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    kind = dict(docs.dtypes)[doc_id]
    end = np.array([end_id], "<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(path)
        for frame in frames:
            at, rows = 0, []
            for group in grouped(["" if t is None else t for t in frame["t"]]):
                for i, raw in enumerate(encoder.encode(group), at):
                    raw += end
                    for p, b in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[b:b + 4 * capacity]
                        rows.append((i, p, b // 4, len(own) // 4, zlib.crc32(own)))
                at += len(group)
            out = pd.DataFrame(rows, columns=["i", "piece", "start", "length", "ids_crc32"])
            out.insert(0, "doc_id", frame["i"].array.take(out.pop("i").to_numpy(int)) if len(out) else frame["i"].array)
            yield out

    return docs.select(quoted(doc_id).alias("i"), quoted(text).alias("t")).mapInPandas(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bin count that the dual feasible functions below prove necessary.

    * rounding: sizes above ``capacity - e`` count as a whole bin, those below ``e`` as nothing (every e);
    * stepping: ``floor((k+1)x)/k`` where ``(k+1)x`` is not whole, else x (k up to 20).
    """
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    many, mass = np.cumsum(n), np.cumsum(n * size)
    best = int(-(-mass[-1] // capacity))
    e = np.arange(1, capacity // 2 + 1)
    rounded = capacity * (many[-1] - many[capacity - e]) + mass[capacity - e] - mass[e - 1]
    best = max(best, int(-(-rounded.max() // capacity)))
    for k in range(1, 21):
        whole = (k + 1) * size % capacity == 0
        value = np.where(whole, size * k, (k + 1) * size // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, int(-(-(n * value).sum() // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece; of the bins that fit, the fullest takes it."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, used = 0, 0  # spaces: bit s is set if a bin with s tokens of space is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = spaces >> need
        if fitting:
            space = need + (fitting & -fitting).bit_length() - 1
            chosen = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
        else:
            space, chosen = capacity, used
            used += 1
        bins[i], offsets[i] = chosen, capacity - space
        left = space - need
        if left:
            by_space[left].append(chosen)
            spaces |= 1 << left
    return bins, offsets


def _given_back(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Which pieces a partition offers for exchange.

    Bins are given back from the emptiest on until their free space would fill as many bins as the gap, and one more:
    a partition at its proven optimum still offers its emptiest bin, since two partitions' may fit into one.
    """
    count = int(bins.max()) + 1 if len(bins) else 0
    gap = count - lower_bound(lengths, capacity)
    spare = count * capacity - int(lengths.sum())
    if gap <= 0 and spare == 0:
        return np.zeros(len(lengths), bool)
    fill = np.bincount(bins, weights=lengths, minlength=count)
    order = np.argsort(fill, kind="stable")
    taken = 1 + int(np.searchsorted(np.cumsum(capacity - fill[order]), min(spare, max(gap, 0) * capacity)))
    return np.isin(bins, order[:taken])


def _round(items: DataFrame, parts: int, number: int, last: bool, capacity: int, schema: str) -> DataFrame:
    names = items.columns

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [f for f in frames if len(f)]
        if not own:
            return
        frame = pd.concat(own, ignore_index=True)
        frame = frame.sort_values(["spread", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        lengths = frame["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        back = np.zeros(len(frame), bool) if last else _given_back(lengths, bins, capacity)
        yield frame[names].assign(bin=bins, offset=offsets, back=back)

    dealt = items.withColumn("spread", F.xxhash64("doc_id", "piece", "start", "ids_crc32"))
    packed = dealt.repartition(parts, "spread").mapInPandas(pack, f"{schema}, bin long, offset long, back boolean")
    # a task's number and the round make bins distinct across the whole result; up to 2^27 partitions of 2^32 bins
    return packed.withColumn("sequence_id", F.shiftleft(F.lit(number).cast("long"), 59) + F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("bin"))


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """Place every piece: adds sequence_id and offset to rows with doc_id, piece, start, length and ids_crc32."""
    schema = ", ".join(f"{n} {t}" for n, t in items.dtypes)
    placed = None
    left, number = items.count(), 0
    while left or placed is None:
        parts = max(1, -(-left // per_partition))
        if number:
            parts = max(1, min(parts, before // FAN_IN))
        last = number == 7 or (number > 0 and parts == 1)
        done = settle(_round(items, parts, number, last, capacity, schema))
        before = done.select(F.max(F.shiftright(F.col("sequence_id"), 32).bitwiseAND((1 << 27) - 1))).first()[0]
        before = 1 if before is None else before + 1
        kept = done.where(~F.col("back")).drop("back", "bin")
        placed = kept if placed is None else placed.unionByName(kept)
        items = done.where(F.col("back")).select(*items.columns)
        left = items.count()
        number += 1
    return placed


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
                   capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row per piece.

    A null or empty text is one closing token.  Repeated rows and null ids are packed like any other; other columns
    of ``docs`` are not used; an empty table gives no rows.
    """
    return (pack(settle(pieces(docs, doc_id, text, path, capacity)), capacity, per_partition)
            .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
