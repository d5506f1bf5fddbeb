"""Benchmark decontamination by winnowed k-gram fingerprints.

Words are runs of digits, lower-cased letters and characters beyond ASCII.  Of every ``SPAN - GRAM + 1`` consecutive
k-grams the one with the smallest hash is kept, in documents and items alike, so that two texts that share ``SPAN``
words share a kept k-gram.  Kept k-grams that meet are extended: each window of ``SPAN`` words around the meeting
place is looked up among the items' windows and compared word by word.  Items shorter than a window are windows of
their own length (of one k-gram, always kept).

The items' windows go to every task if their text is within ``max_bytes``; beyond that they stay a table and the
fingerprints are joined.  The result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import fresh, quoted
from .words import NEVER, Words, blocks, words_of

SPAN = 10
GRAM = 5
#: Text bytes of items up to which their windows are sent to every task.
MAX_BYTES = 16 << 20

_RESULT = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<first:int,until:int>>>"
RESULT_TYPE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                         ("spans", pa.list_(pa.struct([("first", pa.int32()), ("until", pa.int32())])))])
def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Which k-grams are a smallest of some ``window`` consecutive ones (ties all kept)."""
    n = len(grams)
    if n <= window:
        return (grams == grams.min(initial=NEVER)) & (grams != NEVER)
    low = _sliding(np.minimum, grams, window)
    padded = np.concatenate([np.repeat(low[:1], window - 1), low, np.repeat(low[-1:], window - 1)])
    return (grams == _sliding(np.maximum, padded, window)) & (grams != NEVER)


def _sliding(pick, values: np.ndarray, window: int) -> np.ndarray:
    """Smallest or largest of each ``window`` consecutive values, by doubling."""
    size, out = 1, values
    while size < window:
        step = min(size, window - size)
        out = pick(out[:-step], out[step:])
        size += step
    return out


@dataclass
class Lookup:
    """Membership of many hashes in a fixed set: a bit table first, a binary search for what passes it."""

    values: np.ndarray
    bits: np.ndarray = field(init=False)
    mask: np.uint64 = field(init=False)

    def __post_init__(self):
        size = 1 << max(16, int(len(self.values) * 16).bit_length())
        self.mask = np.uint64(size - 1)
        self.bits = np.zeros(size, bool)
        self.bits[self.values & self.mask] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that are in the set, and where in ``values`` they stand."""
        at = np.flatnonzero(self.bits[hashes & self.mask])
        place = np.searchsorted(self.values, hashes[at])
        place[place == len(self.values)] = 0
        same = self.values[place] == hashes[at] if len(self.values) else np.zeros(0, bool)
        return at[same], place[same]


@dataclass
class Index:
    """Fingerprints of the items, and by window size the windows with their words and the items that hold them."""

    prints: Lookup
    windows: dict[int, tuple[Lookup, list[bytes], list[list[int]]]]
    names: list[str]

    @classmethod
    def build(cls, items: list[tuple[str, str]], span: int, gram: int) -> Index:
        names = sorted({n for n, _ in items})
        number = {n: i for i, n in enumerate(names)}
        raw = [t.encode() for _, t in items]
        words = words_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        kept = words.grams(gram)
        prints = kept[winnow(kept, span - gram + 1)]
        held: dict[int, dict[int, tuple[bytes, set[int]]]] = {}
        for size in range(1, span + 1):
            hashes = words.grams(size)
            for i, (name, _) in enumerate(items):
                a, b = int(words.first[i]), int(words.first[i + 1])
                if b - a == size or b - a > size == span:
                    for at in range(a, b - size + 1):
                        own = held.setdefault(size, {}).setdefault(int(hashes[at]), (words.text(at, size), set()))
                        own[1].add(number[name])
        windows = {}
        for size, found in held.items():
            order = sorted(found)
            windows[size] = (Lookup(np.array(order, np.uint64)), [found[h][0] for h in order], [sorted(found[h][1]) for h in order])
        return cls(Lookup(np.unique(prints)), windows, names)

    def hits(self, words: Words, span: int, gram: int) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, words, items) of each window of the texts that some item holds."""
        if span in self.windows and len(self.prints.values):
            grams = words.grams(gram)
            kept = np.flatnonzero(winnow(grams, span - gram + 1))
            met = kept[self.prints.find(grams[kept])[0]]
            around = np.unique(met[:, None] - np.arange(span - gram + 1)[None, :])
            around = around[around >= 0]
            yield from self._windows(words, span, around)
        for size in self.windows:
            if size < span:
                yield from self._windows(words, size, None)

    def _windows(self, words: Words, size: int, at: np.ndarray | None) -> Iterator[tuple[int, int, list[int]]]:
        lookup, texts, holders = self.windows[size]
        hashes = words.grams(size)
        places, which = lookup.find(hashes if at is None else hashes[at])
        for i, w in zip((places if at is None else at[places]).tolist(), which.tolist(), strict=True):
            if words.text(i, size) == texts[w]:
                yield i, size, holders[w]


def _report(words: Words, hits, names: list[str]) -> list[dict]:
    """One result per text: words, hit words, items, and the hit runs."""
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    items: dict[int, set[int]] = {}
    for at, size, own in hits:
        cover[at] += 1
        cover[at + size] -= 1
        items.setdefault(int(np.searchsorted(words.first, at, "right")) - 1, set()).update(own)
    hit = np.cumsum(cover[:-1]) > 0
    out = []
    for i in range(len(words.first) - 1):
        a, b = int(words.first[i]), int(words.first[i + 1])
        row = {"n_words": b - a, "n_hit": 0, "items": [], "spans": []}
        if i in items:
            steps = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
            row["n_hit"] = int(hit[a:b].sum())
            row["items"] = sorted(names[k] for k in items[i])
            row["spans"] = [{"first": f, "until": u} for f, u in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True)]
        out.append(row)
    return out


def _total_bytes(items: DataFrame, text: str) -> int:
    return items.select(F.sum(F.octet_length(quoted(text)))).first()[0] or 0


def with_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                       out: str = "contamination", span: int = SPAN, gram: int = GRAM, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add a struct (n_words, n_hit, items, spans) to each document; spans are runs of hit words, [first, until).

    Null and empty texts have no words and no hits; a null item id counts as the empty string; rows with one item id
    are one item; repeated document rows each get their result; other columns pass through, and ``out`` gets a free
    name if it is taken; either table may be empty.
    """
    name = fresh(docs, out)
    own = items.select(F.coalesce(quoted(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(quoted(item_text), F.lit("")).alias("words"))
    if _total_bytes(own, "words") > max_bytes:
        return _joined(docs, own, text, name, span, gram)
    index = docs.sparkSession.sparkContext.broadcast(Index.build([tuple(r) for r in own.collect()], span, gram))

    @F.arrow_udf(_RESULT)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = index.value
        for column in batches:
            rows: list[dict] = []
            for data, offsets in blocks(column):
                words = words_of(data, offsets)
                rows += _report(words, found.hits(words, span, gram), found.names)
            yield pa.array(rows, RESULT_TYPE)

    return docs.withColumn(name, scan(quoted(text)))


def _fingerprints(span: int, gram: int, sizes: tuple[int, ...]):
    """An Arrow UDF for the joined form: (n_words, kept k-grams with the windows around them, short windows)."""
    kind = pa.struct([("n_words", pa.int64()), ("prints", pa.list_(pa.struct([("print", pa.int64()), ("at", pa.int32()), ("words", pa.string())]))),
                      ("short", pa.list_(pa.struct([("at", pa.int32()), ("words", pa.string())])))])

    @F.arrow_udf("struct<n_words:long,prints:array<struct<print:long,at:int,words:string>>,short:array<struct<at:int,words:string>>>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            rows = []
            for data, offsets in blocks(column):
                words = words_of(data, offsets)
                grams = words.grams(gram)
                kept = winnow(grams, span - gram + 1)
                for i in range(len(offsets) - 1):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    prints = [{"print": int(grams[p]), "at": w - a, "words": words.text(w, span).decode()}
                              for p in (np.flatnonzero(kept[a:b]) + a).tolist() for w in range(max(a, p - span + gram), p + 1) if w + span <= b]
                    short = [{"at": w - a, "words": words.text(w, s).decode()} for s in sizes for w in range(a, b - s + 1)]
                    rows.append({"n_words": b - a, "prints": prints, "short": short})
            yield pa.array(rows, kind)

    return scan


def _joined(docs: DataFrame, items: DataFrame, text: str, name: str, span: int, gram: int) -> DataFrame:
    """The same result with the items' fingerprints and windows as tables, for item sets of any size."""
    scan = _fingerprints(span, gram, ())
    whole = items.withColumn("s", scan("words"))
    short = whole.where((F.col("s.n_words") > 0) & (F.col("s.n_words") < span))
    sizes = tuple(sorted(r[0] for r in short.select("s.n_words").distinct().collect()))  # fewer than a window's words
    own_text = F.array_join(F.regexp_extract_all(F.translate("words", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                                                 F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)), " ")
    item_prints = settle(whole.select("item", F.explode("s.prints").alias("p")).select("item", "p.print", "p.words"))
    item_windows = item_prints.select("words", "item").union(short.select(own_text, "item")).distinct()
    marked = settle(docs.withColumn(name, _fingerprints(span, gram, sizes)(quoted(text))).withColumn(name + "key", F.monotonically_increasing_id()))
    found = F.col(f"`{name}`")
    grams = marked.select(F.col(name + "key").alias("k"), F.explode(found["prints"]).alias("p")).select("k", "p.print", "p.at", "p.words")
    near = grams.join(item_prints.select("print").distinct(), "print", "left_semi").select("k", "at", "words")
    each = near.union(marked.select(F.col(name + "key"), F.explode(found["short"]).alias("p")).select(name + "key", "p.at", "p.words")).distinct()
    hits = each.join(item_windows, "words").withColumn("size", F.size(F.split("words", " ")))
    spots = (hits.select("k", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("w")).distinct()
             .groupBy("k").agg(F.sort_array(F.collect_list("w")).alias("ws"), F.count("*").alias("n_hit")))
    runs = F.expr("""transform(filter(sequence(0, size(ws) - 1), i -> i = 0 OR ws[i] <> ws[greatest(i - 1, 0)] + 1), i ->
        named_struct('first', ws[i], 'until', 1 + ws[i] + size(filter(sequence(i, size(ws) - 1), j -> ws[j] - ws[i] = j - i)) - 1))""")
    names = hits.groupBy("k").agg(F.sort_array(F.collect_set("item")).alias("items"))
    per_doc = spots.join(names, "k").select("k", F.col("n_hit").cast("long"), "items", runs.alias("spans"))
    joined = marked.join(per_doc, marked[name + "key"] == per_doc["k"], "left")
    result = F.struct(found["n_words"].alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      F.coalesce("spans", F.array().cast("array<struct<first:int,until:int>>")).alias("spans"))
    return joined.select(*[marked[f"`{c}`"] for c in docs.columns], result.alias(name))
