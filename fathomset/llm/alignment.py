"""Two tokenizers' tokens of the same text, aligned by bytes.

Tokenizer A is a byte-level BPE of the ``tokenizers`` library, tokenizer B a ``sentencepiece`` model that puts a space
before the text.  Both encode ``space + text``.  The spans that the libraries give (character offsets of A, byte spans of
B's proto) are the coarse cuts: where a span is as long in bytes as its token's decoded bytes, the cut is taken.  Tokens
that share a character (pieces of a multibyte character, byte-fallback pieces) have spans of other lengths; they are
refined by the lengths of their decoded bytes.  The decoded bytes joined must be the text, or it has no tokens at all.

Texts are encoded in units.  A unit ends before a single space or line break between two solid characters, and between a Latin letter
and ASCII punctuation: A's pre-tokeniser starts a pre-token there, and no piece of B holds the space mark behind another character,
a line break beside one, or such punctuation behind a letter, so no merge crosses it.  What a worker finds in a unit it remembers
while there is room; units it does not know are encoded together, as one text of units in a row.  Vocabularies without these
properties get whole texts as units.

Corpus counts are sums over (text, distinct pair) rows; they are joined as a broadcast while their table is small and by
a shuffle beyond that.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from ..session import checked_broadcast, settle
from .common import fresh, quoted, text_groups
from .token_counts import load_tokenizer

#: A pair of ids is the number ``a * WIDTH + b``.
WIDTH = 1 << 24
#: Bytes of texts that are handled at a time, and characters of units that are encoded as one text.
GROUP, ROW = 1 << 20, 1 << 16
#: Units that a worker remembers, over all the tasks that it runs.
MEMO = 400_000
_ODD = frozenset(map(chr, [*range(0x21), *range(0x7F, 0xA1), 0xAD, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2070), 0x3000, 0xFEFF]))
#: A character that is a space or format character in no version of Unicode.
_SOLID = f"[^{re.escape(''.join(sorted(_ODD)))}]"
#: Punctuation that begins no contraction, and its place behind a Latin letter.
_POINT = "!-&(-/:-@\\[-`{-~"
_STOP = f"(?=[{_POINT}])(?<=[A-Za-zÀ-ÖØ-öø-ÿ])"
_UNIT_END = re.compile(f"(?=[ \n{_POINT}])(?:(?=[ \n]{_SOLID})(?<={_SOLID})|{_STOP})")
#: Before a unit that does not begin with a space, where units are encoded in a row.
BEFORE = " a"
SPACE_MARK = chr(0x2581)

_DIGEST = "struct<n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string,pairs:array<long>,times:array<int>>"
_GROUPS = "array<struct<a:array<int>,b:array<int>,end:long>>"


def _byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if it is visible, else one from 256 on."""
    visible = [b for b in range(256) if 32 < b < 127 or b > 160 and b != 173]
    hidden = sorted(set(range(256)) - set(visible))
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _piece_bytes(model: sentencepiece.SentencePieceProcessor, i: int) -> bytes:
    if model.is_byte(i):
        return bytes([int(model.id_to_piece(i)[3:5], 16)])
    return b"" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).replace(SPACE_MARK, " ").encode()


def _sizes(parts: list[bytes]) -> np.ndarray:
    return np.array([len(p) for p in parts], np.int64)


def _written(n: int, ends: str) -> np.ndarray:
    """The numbers below n as text, each with either of two characters behind it: entry ``2 * id + which``."""
    return np.array([f"{i}{e}" for i in range(n) for e in ends], object)


@dataclass
class Encoders:
    """The two libraries' encoders with the bytes, byte lengths and texts of every id."""

    a: Tokenizer
    b: sentencepiece.SentencePieceProcessor
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    in_units: bool

    def __post_init__(self):
        self.a_sizes, self.b_sizes = _sizes(self.a_bytes), _sizes(self.b_bytes)
        self.a_written, self.b_written = _written(len(self.a_bytes), ",|"), _written(len(self.b_bytes), ",;")

    @classmethod
    def load(cls, a_path: str, b_path: str) -> Encoders:
        a = Tokenizer.from_str(load_tokenizer(a_path).to_str())
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet, added = _byte_alphabet(), a.get_added_tokens_decoder()
        a_bytes = [b""] * a.get_vocab_size(with_added_tokens=True)
        for piece, i in a.get_vocab(with_added_tokens=True).items():
            a_bytes[i] = piece.encode() if i in added else bytes(alphabet[c] for c in piece)
        spec, model = json.loads(a.to_str()), sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(b.serialized_model_proto())
        pre, normal = spec["pre_tokenizer"] or {}, model.normalizer_spec
        crossing = re.compile(f"[^{SPACE_MARK}]{SPACE_MARK}|(?s:.\n|\n.)|{_STOP}")
        apart = not any(crossing.search(p.piece) for p in model.pieces if p.type in (p.NORMAL, p.USER_DEFINED))
        plain = normal.name == "identity" and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces
        level = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        return cls(a, b, a_bytes, [_piece_bytes(b, i) for i in range(b.get_piece_size())], bool(apart and plain and level))

    def units(self, text: str) -> list[str]:
        """The units of the text; joined they are ``space + text``."""
        return _UNIT_END.split(" " + text) if self.in_units else [" " + text]

    def aligned(self, texts: list[str]) -> Iterator[Aligned | None]:
        """For each text its tokens and their cuts; None for an empty one and where the bytes are not the text's."""
        whole = [t for t in texts if t]
        found = zip(whole, self.a.encode_batch([" " + t for t in whole], add_special_tokens=False), self.b.encode(whole, return_type="proto"), strict=True)
        for text in texts:
            yield self._aligned(*next(found)) if text else None

    def _aligned(self, text: str, x, y) -> Aligned | None:
        data, pieces = (" " + text).encode(), y.pieces
        a, b = x.ids, [p.id for p in pieces]
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        spans = np.fromiter(itertools.chain.from_iterable(x.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        if len(data) > len(text) + 1:
            # from characters to bytes: a character begins at every byte that continues none
            begins = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            spans = np.append(begins, len(data))[spans]
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a = byte_ends(spans[:, 0], spans[:, 1], self.a_sizes[a])
        # B's spans are bytes of the text behind the space, which its first piece takes in; each begins where the last ends
        until = np.array([p.end for p in pieces], np.int64) + 1
        return Aligned(a, ends_a, b, byte_ends(np.append(0, until[:-1]), until, self.b_sizes[b]))


@functools.cache
def encoders(a_path: str, b_path: str) -> Encoders:
    return Encoders.load(a_path, b_path)


def byte_ends(begins: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where each token ends: at its span's end if the span has the token's length, else as many bytes on as its decoded bytes are."""
    behind = np.cumsum(sizes)
    coarse = np.where(ends - begins == sizes, np.arange(len(sizes)), -1)
    last = np.maximum.accumulate(coarse)  # the last cut taken from a span
    known = last >= 0
    return np.where(known, ends[last] - behind[last], 0) + behind


@dataclass
class Aligned:
    """Ids of both tokenizers over one text and the byte at which each token ends."""

    a: np.ndarray
    ends_a: np.ndarray
    b: np.ndarray
    ends_b: np.ndarray

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each group the number of tokens up to its end, in A and in B."""
        a, b = self._marks()
        return np.flatnonzero(b[self.ends_a]) + 1, np.flatnonzero(a[self.ends_b]) + 1

    def _marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each byte whether a token of A ends there, and one of B."""
        a, b = np.zeros((2, int(self.ends_a[-1]) + 1), bool)
        a[self.ends_a], b[self.ends_b] = True, True
        return a, b

    def cuts(self) -> np.ndarray:
        a, b = self._marks()
        return np.flatnonzero(a | b)

    def pairs(self) -> np.ndarray:
        """The pairs that overlap: between two neighbouring cuts of either lies one token of each."""
        cuts = self.cuts()
        return self.a[np.searchsorted(self.ends_a, cuts)] * WIDTH + self.b[np.searchsorted(self.ends_b, cuts)]

    def written(self, tools: Encoders) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        upto_a, upto_b = self.common()
        ends = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        ends[0][upto_a - 1], ends[1][upto_b - 1] = 1, 1
        out = np.empty(len(self.a) + len(self.b), object)
        # a token of A stands behind the B tokens of earlier groups, one of B behind the A tokens of its own group too
        group_a, group_b = np.cumsum(ends[0]) - ends[0], np.cumsum(ends[1]) - ends[1]
        out[np.arange(len(self.a)) + np.append(0, upto_b)[group_a]] = tools.a_written[2 * self.a + ends[0]]
        out[np.arange(len(self.b)) + upto_a[group_b]] = tools.b_written[2 * self.b + ends[1]]
        return "".join(out.tolist())[:-1]


def _steps(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of one run after another, each from its begin on."""
    return np.arange(sizes.sum()) + np.repeat(begins - np.cumsum(sizes) + sizes, sizes)


@dataclass
class Found:
    """What units hold, in rows: whether they have tokens, numbers of A tokens, B tokens, groups and links, the groups as text, and the links."""

    good: np.ndarray
    counts: np.ndarray
    written: list[str]
    pairs: np.ndarray

    @classmethod
    def none(cls) -> Found:
        return cls(np.zeros(0, bool), np.zeros((0, 4), np.int64), [], np.zeros(0, np.int64))

    @classmethod
    def of(cls, tools: Encoders, found: Aligned | None, sizes: np.ndarray) -> Found:
        """The parts of an aligned text that end after so many bytes each, where both tokenizers cut."""
        if found is None:
            return cls(np.zeros(len(sizes), bool), np.zeros((len(sizes), 4), np.int64), [""] * len(sizes), np.zeros(0, np.int64))
        ends, pairs = np.cumsum(sizes), found.pairs()
        upto_a, _ = found.common()
        until = np.stack([np.searchsorted(cuts, ends) + 1 for cuts in (found.ends_a, found.ends_b, found.ends_a[upto_a - 1], found.cuts())], axis=1)
        groups, stops = found.written(tools).split(";"), [0, *until[:, 2].tolist()]
        return cls(np.ones(len(sizes), bool), np.diff(until, axis=0, prepend=0), [";".join(groups[i:j]) for i, j in itertools.pairwise(stops)], pairs)

    @staticmethod
    def joined(parts: list[Found]) -> Found:
        return Found(np.concatenate([p.good for p in parts]), np.concatenate([p.counts for p in parts]), list(itertools.chain.from_iterable(p.written for p in parts)), np.concatenate([p.pairs for p in parts]))

    def taken(self, at: list[int]) -> Found:
        """These rows, in this order."""
        links = self.counts[:, 3]
        begins = np.cumsum(links) - links
        return Found(self.good[at], self.counts[at], [self.written[i] for i in at], self.pairs[_steps(begins[at], links[at])])


def _put(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` from its place n on; it grows by its own size."""
    if n + len(more) > len(held):
        held = np.concatenate([held[:n], np.zeros((len(held) + len(more), *held.shape[1:]), held.dtype)])
    held[n:n + len(more)] = more
    return held


class Memory:
    """Units that were met, the earliest ones for good and others for one group of texts."""

    def __init__(self, tools: Encoders):
        self.tools, self.at, self.held, self.links = tools, defaultdict(int), Found.none(), 0

    def encoded(self, units: list[str]) -> Found:
        """What the units hold."""
        # a row of units needs solid ends, and the bytes of a unit with the space mark are never its text's
        own = [not self.tools.in_units or u[0] == " " and u[1:2] in _ODD or u[-1] in _ODD or SPACE_MARK in u for u in units]
        rows: list[list[int]] = [[k] for k in np.flatnonzero(own).tolist()]
        row, size = [], 0
        for k, u in enumerate(units):
            if not own[k]:
                row.append(k)
                size += len(u)
                if size > ROW:
                    rows.append(row)
                    row, size = [], 0
        rows += [row] if row else []
        parts, where, count = [Found.none()], [0] * len(units), 0
        while rows:
            row, text, places = rows.pop(), [], []
            for k in row:
                text += [units[k]] if units[k][0] == " " else [BEFORE, units[k]]
                places.append(count + len(text) - 1)
            found = next(self.tools.aligned(["".join(text)[1:]]))
            if found is None and len(row) > 1:  # some unit of the row is not given back
                rows += [[k] for k in row]
                continue
            parts.append(Found.of(self.tools, found, np.array([len(u.encode()) for u in text])))
            for k, place in zip(row, places, strict=True):
                where[k] = place
            count += len(text)
        return Found.joined(parts).taken(where)

    def find(self, texts: list[str]) -> tuple[list[list[int]], Found]:
        """For each text where its units stand in the rows that are returned too; none where a unit has no tokens.

        The rows hold until the next call.
        """
        at, held, n = self.at, self.held, len(self.at)
        at.default_factory = itertools.count(n).__next__
        places = [list(map(at.__getitem__, self.tools.units(t))) if t else [] for t in texts]
        total = len(at)
        more = self.encoded(list(itertools.islice(reversed(at), total - n))[::-1])
        del held.written[n:]
        held.written += more.written
        held.good, held.counts, held.pairs = _put(held.good, n, more.good), _put(held.counts, n, more.counts), _put(held.pairs, self.links, more.pairs)
        rows = Found(held.good[:total], held.counts[:total], held.written, held.pairs[:self.links + len(more.pairs)])
        keep = max(n, min(total, MEMO if self.tools.in_units else 0))
        self.links += int(more.counts[:keep - n, 3].sum())
        for _ in range(total - keep):
            at.popitem()
        lost = set(np.flatnonzero(~rows.good).tolist())
        return [[] if lost and not lost.isdisjoint(p) else p for p in places], rows


@functools.cache
def memory_of(a_path: str, b_path: str) -> Memory:
    return Memory(encoders(a_path, b_path))


def _digest(a_path: str, b_path: str):
    @F.arrow_udf(_DIGEST)
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = memory_of(a_path, b_path)
        for column in batches:
            counts, hashes, pairs, times = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for group in text_groups(column, GROUP):
                places, rows = memory.find(group)
                begins = np.cumsum(rows.counts[:, 3]) - rows.counts[:, 3]
                for p in places:
                    if not p:
                        counts.append((0, 0, 0, 0, 0))
                        hashes.append("")
                        continue
                    at = np.array(p)
                    own = rows.counts[at]
                    # the links of one unit after another
                    values, n = np.unique(rows.pairs[_steps(begins[at], own[:, 3])], return_counts=True)
                    counts.append((*own.sum(axis=0).tolist(), len(values)))
                    hashes.append(sha256(";".join(map(rows.written.__getitem__, p)).encode()).hexdigest())
                    pairs.append(values)
                    times.append(n)
            table = np.array(counts, np.int64).reshape(-1, 5)
            ends = np.append(0, np.cumsum(table[:, 4])).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), t)) for x, t in ((pairs, pa.int64()), (times, pa.int64()))]
            lists[1] = lists[1].cast(pa.list_(pa.int32()))
            yield pa.StructArray.from_arrays([*(pa.array(table[:, i]) for i in range(4)), pa.array(hashes, pa.string()), *lists],
                                             ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return digest


def with_groups(docs: DataFrame, text: str = "text", out: str = "groups", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Add the groups of each text: ids of A, ids of B, and the byte of ``space + text`` where both end.

    Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no groups.  Other columns
    pass through; if ``out`` is taken, the column gets a free name.
    """
    a_path, b_path = _paths(a_path, b_path)

    @F.arrow_udf(_GROUPS)
    def groups(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tools = encoders(a_path, b_path)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("end", pa.int64())]))
        for column in batches:
            rows = []
            for group in text_groups(column, GROUP):
                for found in tools.aligned(group):
                    upto_a, upto_b = found.common() if found else ((), ())
                    rows.append([{"a": found.a[i:k].tolist(), "b": found.b[j:m].tolist(), "end": int(found.ends_a[k - 1])}
                                 for i, k, j, m in zip([0, *upto_a], upto_a, [0, *upto_b], upto_b)])
            yield pa.array(rows, kind)

    return docs.withColumn(fresh(docs, out), groups(quoted(text)))


def pair_counts(aligned: DataFrame, pairs: str = "pairs") -> DataFrame:
    """Rows (pair, n, best): in how many rows of ``aligned`` each pair stands, and whether no pair of its A id has more."""
    counted = aligned.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    own = Window.partitionBy(F.expr(f"pair div {WIDTH}"))  # at most as many rows as B has ids
    return counted.withColumn("best", F.col("n") == F.max("n").over(own))


def with_agreement(docs: DataFrame, text: str = "text", out: str = "agreement", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Add struct ``out`` (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text.

    ``n_best`` are the links whose pair is found in as many texts as any pair of its A id (ties included), ``count_sum`` the sum
    over the links of the number of texts that hold their pair.  Texts without tokens (null, empty, or not given back byte for
    byte) have zeros and the empty hash.  Repeated rows are texts of their own, rows with null or equal ids too; other columns
    pass through; an empty table gives an empty table.
    """
    a_path, b_path = _paths(a_path, b_path)
    out, row, found = fresh(docs, out), fresh(docs, "row"), fresh(docs, "found")
    aligned = settle(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(found, _digest(a_path, b_path)(quoted(text))))
    f = quoted(found)
    counts = checked_broadcast(pair_counts(aligned.select(f.pairs.alias("pairs"))))
    links = aligned.select(quoted(row).alias("row"), F.inline(F.arrays_zip(f.pairs.alias("pair"), f.times.alias("times"))))
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    sums = sums.select(F.col("row").alias(row), F.struct("count_sum", "n_best").alias(fresh(aligned, "sums")))
    total = quoted(sums.columns[1])
    result = F.struct(f.n_a.alias("n_a"), f.n_b.alias("n_b"), f.n_groups.alias("n_groups"), f.n_links.alias("n_links"),
                      F.coalesce(total.n_best, F.lit(0)).cast("long").alias("n_best"), F.coalesce(total.count_sum, F.lit(0)).cast("long").alias("count_sum"), f.groups_sha256.alias("groups_sha256"))
    slim = aligned.withColumn(found, F.struct(*[f[c].alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")]))
    return slim.join(sums, row, "left").select(*[quoted(c) for c in docs.columns], result.alias(out))


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
