"""A Katz backoff bigram model counted over the whole corpus, and the log-probability of every text under it.

p(w | h) is the discounted relative frequency where the pair was seen in training, else the backoff weight of h times
p(w); p(w) is discounted likewise and gives the rest to one unknown token.  Discounts are Good-Turing up to ``CUT`` and
a hundredth of a count above, so that each history keeps some mass.  A backoff weight divides the mass its seen
followers leave by the mass of all other tokens, which makes each distribution sum to one.

The corpus is counted in blocks of whole documents, so that a token moves as a few bytes:

1. a block's texts become arrays of local token numbers (a table bucketed by block);
2. each block asks, by hash range, for the counts of its distinct tokens and pairs, once each however frequent;
3. a range adds up the counts of all blocks and answers each block, naming one block the owner of each pair;
4. a block scores its seen pairs, and sums its own pairs' mass by history; histories are added up over blocks;
5. what is left, the unseen pairs of each document, is joined with the backoff weights.

Tokens and pairs are known by hashes of 56 bits.  Hot tokens and pairs weigh as one entry in each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .common import quoted
from .words import MIX, STEP, blocks, mixed, words_of

#: Counts up to this are discounted by Good-Turing.
CUT = 5
SLIGHT = 0.01
#: Text bytes of a block, about, and hash ranges at most.
BLOCK_BYTES = 10 << 20
RANGES = 4096

_SPACE = np.ones(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False
_START, _END = np.uint64(0x51ED270B7F4A7C15), np.uint64(0x2545F4914F6CDD1D)


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte: all lowest bytes, then all next ones ... as many as the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    width = raw[0]
    parts = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((parts.shape[1], 8), np.uint8)
    out[:, :width] = parts.T
    return out.view("<u8").ravel()


def _sorted_planes(values: np.ndarray) -> bytes:
    return _planes(np.diff(values, prepend=np.uint64(0)))


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """The factor for each count 0 to CUT; a count without a sound Good-Turing estimate gives up half of one."""
    n = [float(counts_of_counts.get(r, 0)) for r in range(CUT + 2)]
    out = np.ones(CUT + 1)
    spare = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - spare) / (1 - spare) if n[r] and spare != 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    counts = counts.astype(float)
    small = counts <= CUT
    return np.where(small, counts * factors[np.minimum(counts, CUT).astype(int)], counts - SLIGHT)


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows (id, t, learn) as blocks: (block, ids, learn, sizes, tokens, words)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, learn, sizes, hashes, size = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            every = np.concatenate(hashes)
            known, local, n = np.unique(every, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # frequent tokens get small numbers
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            return pa.RecordBatch.from_arrays([
                pa.array([uuid.uuid4().int >> 65]), pa.array([ids], pa.list_(pa.string())), pa.array([learn], pa.list_(pa.bool_())),
                pa.array([np.concatenate(sizes)], pa.list_(pa.int32())), pa.array([_planes(rank[local].astype(np.uint64))], pa.binary()),
                pa.array([known[order].tobytes()], pa.binary())], names=["block", "ids", "learn", "sizes", "tokens", "words"])

        for b in batches:
            ids_of, learn_of, at = b.column(0).to_pylist(), b.column(2).to_pylist(), 0
            for data, offsets in blocks(b.column(1)):
                words = words_of(data, offsets, _SPACE)
                n = len(offsets) - 1
                ids += ids_of[at:at + n]
                learn += learn_of[at:at + n]
                sizes.append(np.diff(words.first).astype(np.int32))
                hashes.append(words.hashes >> np.uint64(8))
                size, at = size + len(data), at + n
                if size > BLOCK_BYTES:
                    yield block()
                    ids, learn, sizes, hashes, size = [], [], [], [], 0
        if ids:
            yield block()

    return rows.mapInArrow(pack, "block long, ids array<string>, learn array<boolean>, sizes array<int>, tokens binary, words binary")


class _Block:
    """A block's tokens with starts and ends, and its distinct tokens and pairs in order of hash."""

    def __init__(self, row):
        sizes = np.asarray(row.sizes, np.int64)
        words = np.frombuffer(row.words, np.uint64)
        self.learn = np.asarray(row.learn, bool)
        self.words = np.concatenate([words, [_START >> np.uint64(8), _END >> np.uint64(8)]]).astype(np.uint64)
        start, end = len(words), len(words) + 1
        local = _from_planes(row.tokens).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)])  # each document's tokens and its end
        self.token = np.full(int(self.first[-1]), end)
        self.token[np.delete(np.arange(len(self.token)), self.first[1:] - 1)] = local
        self.history = np.concatenate([[start], self.token[:-1]])
        self.history[self.first[:-1]] = start
        self.doc = np.repeat(np.arange(len(sizes)), sizes + 1)
        taught = self.learn[self.doc]
        # distinct pairs, by hash
        packed = self.history * np.int64(len(self.words)) + self.token
        order = np.argsort(packed, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], packed[order][1:] != packed[order][:-1]]))
        pairs = packed[order][heads]
        n = np.add.reduceat(taught[order].astype(np.int64), heads)
        of_pair = np.empty(len(packed), np.int64)
        of_pair[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
        self.pair_history, self.pair_token = pairs // len(self.words), pairs % len(self.words)
        hashes = mixed((self.words[self.pair_history] * MIX + self.words[self.pair_token]) * STEP) >> np.uint64(8)
        self.by_hash = np.argsort(hashes, kind="stable")
        self.pair_hashes, self.pair_counts, self.of_pair = hashes[self.by_hash], n[self.by_hash], of_pair
        # distinct tokens, by hash; a start is no token
        n = np.bincount(self.token, weights=taught, minlength=len(self.words)).astype(np.int64)
        self.word_order = np.argsort(self.words, kind="stable")
        self.word_order = self.word_order[self.word_order != start]
        self.word_hashes, self.word_counts = self.words[self.word_order], n[self.word_order]
        self.start = start


def _cuts(hashes: np.ndarray, ranges: int) -> np.ndarray:
    edges = (np.arange(1, ranges, dtype=np.uint64) << np.uint64(56 - (ranges - 1).bit_length()))
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _requests(ranges: int):
    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                b = _Block(row)
                p, w = _cuts(b.pair_hashes, ranges), _cuts(b.word_hashes, ranges)
                yield pd.DataFrame({
                    "block": row.block, "part": np.arange(ranges),
                    "pairs": [_sorted_planes(b.pair_hashes[i:j]) for i, j in zip(p[:-1], p[1:], strict=True)],
                    "pair_n": [_planes(b.pair_counts[i:j]) for i, j in zip(p[:-1], p[1:], strict=True)],
                    "words": [_sorted_planes(b.word_hashes[i:j]) for i, j in zip(w[:-1], w[1:], strict=True)],
                    "word_n": [_planes(b.word_counts[i:j]) for i, j in zip(w[:-1], w[1:], strict=True)]})

    return ask


def _totals(asked: list[bytes], counted: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per block the totals of what it asked for and whether it owns it; and the totals of all distinct ones."""
    hashes = [np.cumsum(_from_planes(a), dtype=np.uint64) for a in asked]
    counts = [_from_planes(n).astype(np.int64) for n in counted]
    every, own = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    sums = np.add.reduceat(own[order], heads) if len(heads) else np.zeros(0, np.int64)
    total = np.empty(len(every), np.int64)
    total[order] = np.repeat(sums, np.diff(np.append(heads, len(order))))
    owner = np.zeros(len(every), bool)
    owner[order[heads]] = True  # the first block that asked
    bounds = np.cumsum([0, *map(len, hashes)])
    cut = lambda x: [x[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return cut(total), cut(owner), sums


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """One hash range: totals for each block, and on its first row how many tokens and pairs have each count."""
    frame = frame.sort_values("block", ignore_index=True)
    pairs, owned, pair_totals = _totals(list(frame["pairs"]), list(frame["pair_n"]))
    words, _, word_totals = _totals(list(frame["words"]), list(frame["word_n"]))
    stats = lambda t: [np.bincount(np.minimum(t, CUT + 2), minlength=CUT + 3)] + [None] * (len(frame) - 1)
    return pd.DataFrame({"block": frame["block"], "part": frame["part"], "pair_c": [_planes(c * 2 + o) for c, o in zip(pairs, owned, strict=True)],
                         "word_c": [_planes(c) for c in words], "pair_stats": stats(pair_totals), "word_stats": stats(word_totals),
                         "mass": [int(word_totals.sum())] + [0] * (len(frame) - 1)})


class _Unigrams:
    """Discounted probability of a token by its count; what is left is the unknown token's."""

    def __init__(self, counts_of_counts: dict[int, int], total: int, distinct: int):
        self.factors, self.total = discounts(counts_of_counts), total
        kept = sum(float(discounted(np.array([r]), self.factors)[0]) * counts_of_counts.get(r, 0) for r in range(1, CUT + 1))
        large = total - sum(r * counts_of_counts.get(r, 0) for r in range(1, CUT + 1))
        kept += large - SLIGHT * (distinct - sum(counts_of_counts.get(r, 0) for r in range(1, CUT + 1)))
        self.unknown = 1 - kept / total if total else 1.0

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.factors) / max(self.total, 1), self.unknown)


def _score(unigrams: _Unigrams, factors: np.ndarray, distinct: int):
    def score(_: tuple, state: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(state):
            return pd.DataFrame(columns=_SCORED)
        row = next(state.itertuples(index=False))
        b, answers = _Block(row), answers.sort_values("part")
        docs = len(b.learn)
        raw = np.concatenate([_from_planes(x) for x in answers["pair_c"]]).astype(np.int64)
        pair_c, owned = np.empty(len(raw), np.int64), np.empty(len(raw), bool)
        pair_c[b.by_hash], owned[b.by_hash] = raw >> 1, (raw & 1).astype(bool)
        word_c = np.zeros(len(b.words), np.int64)
        word_c[b.word_order] = np.concatenate([_from_planes(x) for x in answers["word_c"]]).astype(np.int64)
        lower = unigrams(word_c)
        history_c = word_c.copy()
        end = b.start + 1
        history_c[b.start] = word_c[end]  # as many starts as ends
        per_token = lambda x: np.bincount(b.doc, weights=x, minlength=docs)
        count = word_c[b.token]
        base = per_token(np.log10((count + 1) / (unigrams.total + distinct + 1)))
        seen = pair_c > 0
        kept = discounted(pair_c, factors)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(seen, np.log10(kept / history_c[b.pair_history]), np.log10(lower[b.pair_token]))
        score = per_token(value[b.of_pair])
        # unseen pairs whose history was seen wait for its backoff weight
        waits = ~seen[b.of_pair] & (history_c[b.history] > 0)
        key, n = np.unique(b.doc[waits] * np.int64(len(b.words)) + b.history[waits], return_counts=True)
        at = np.searchsorted(key // len(b.words), np.arange(docs + 1))
        hashes = b.words.view(np.int64)[key % len(b.words)]
        mine = seen & owned
        h = b.pair_history[mine]
        sums = [np.bincount(h, weights=x, minlength=len(b.words)) for x in (pair_c[mine], kept[mine], lower[b.pair_token[mine]])]
        held = np.flatnonzero(sums[0])
        first = pd.DataFrame({"block": [row.block], "doc": [-1], "doc_id": [None], "n_tokens": 0, "n_known": 0, "base_score": 0.0, "part_score": 0.0, "h": [b.words.view(np.int64)[held]], "c": [sums[0][held].astype(np.int64)],
                              "s": [sums[1][held]], "u": [sums[2][held]]})
        out = pd.DataFrame({"block": row.block, "doc": np.arange(docs), "doc_id": list(row.ids), "n_tokens": np.diff(b.first),
                            "n_known": per_token(count > 0).astype(np.int64), "base_score": base, "part_score": score,
                            "h": [hashes[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], "c": [n[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], "s": None, "u": None})
        return pd.concat([first, out], ignore_index=True)[_SCORED]

    return score


_SCORED = ["block", "doc", "doc_id", "n_tokens", "n_known", "base_score", "part_score", "h", "c", "s", "u"]
_SCORED_SQL = ("block long, doc int, doc_id string, n_tokens long, n_known long, base_score double, part_score double, h array<long>, c array<long>, "
               "s array<double>, u array<double>")


def _bucketed(df: DataFrame, key: str, buckets: int) -> str:
    name = f"katz_{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").saveAsTable(name)
    return name


def score_texts(docs: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score all texts under a model of those for which ``learn`` holds (default: all).

    Tokens are runs of characters other than ASCII white space, A-Z lower-cased, and one end for each document; a null
    text is empty and has its end alone.  Columns: doc_id, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams) and score, both log10.  Repeated rows count and are scored each; other columns are not used; an empty
    table gives an empty table; with no document to learn from, every token is the unknown one, of probability one.
    """
    spark: SparkSession = docs.sparkSession
    kind = dict(docs.dtypes)[doc_id]
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    rows = docs.select(quoted(doc_id).cast("string").alias("id"), F.coalesce(quoted(text), F.lit("")).alias("t"), learn.alias("learn"))
    buckets = max(1, rows.rdd.getNumPartitions())
    name = _bucketed(_blocked(rows), "block", buckets)
    try:
        state = spark.table(name)
        ranges = min(RANGES, 1 << max(3, (state.count() - 1).bit_length()))
        asked = state.mapInPandas(_requests(ranges), "block long, part long, pairs binary, pair_n binary, words binary, word_n binary")
        answers = settle(asked.groupBy("part").applyInPandas(_answer, "block long, part long, pair_c binary, word_c binary, pair_stats array<long>, word_stats array<long>, mass long"))
        sums = answers.select(*[F.sum(F.col(k)[i]).alias(f"{k}{i}") for k in ("pair_stats", "word_stats") for i in range(CUT + 3)], F.sum("mass").alias("mass")).first()
        of = lambda k: {i: sums[f"{k}{i}"] or 0 for i in range(1, CUT + 3)}
        total, distinct = sums["mass"] or 0, sum(of("word_stats").values())
        unigrams = _Unigrams(of("word_stats"), total, distinct)
        scored = settle(state.groupBy("block").cogroup(answers.select("block", "part", "pair_c", "word_c").groupBy("block"))
                        .applyInPandas(_score(unigrams, discounts(of("pair_stats")), distinct), _SCORED_SQL))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    sums = scored.where("doc < 0").select(F.explode(F.arrays_zip("h", "c", "s", "u")).alias("x")).select("x.*")
    weights = (sums.groupBy("h").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("u").alias("u"))
               .select("h", F.log10((1 - F.col("s") / F.col("c")) / (1 - F.col("u"))).alias("weight")))
    each = scored.where("doc >= 0")
    rest = (each.select("block", "doc", F.explode(F.arrays_zip("h", "c")).alias("x")).select("block", "doc", "x.h", "x.c")
            .join(weights, "h").groupBy("block", "doc").agg(F.sum(F.col("c") * F.col("weight")).alias("more")))
    return (each.drop("h", "c", "s", "u").join(rest, ["block", "doc"], "left")
            .select(F.col("doc_id").cast(kind).alias("doc_id"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score",
                    (F.col("part_score") + F.coalesce("more", F.lit(0.0))).alias("score")))
