"""Token counts of whole texts, however long, by overlap resynchronisation.

A text of at most ``chunk`` characters is one chunk.  A longer one is encoded as chunks that overlap, with character
offsets.  Neighbouring chunks are spliced at a boundary that is proven to be one of the whole text:

* Merges never cross a pre-token, and the pre-tokeniser reads from left to right without looking back, so what
  follows a pre-token boundary does not depend on what lies before it.
* The first chunk starts at a true boundary (the text's start).  Its boundaries up to ``margin`` characters before
  its end are true as well, since no pre-token's end depends on more than the next character and no special string
  is longer than the margin.
* A boundary of the next chunk that is also a true one makes all that follows it true.

A text of one chunk is the sum of its pre-tokens' counts, for the same reason: each is encoded once by the library and
remembered.  That needs the pre-tokeniser's pattern, so it is done for texts of letters on whose classes all Unicode
versions agree and without special strings; any other text is encoded whole.

When an overlap holds no common boundary it is doubled; when it has reached the start of the left chunk, the left
chunk is doubled.  The worst case (one pre-token that never ends) is thus the encoding of the whole text.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import fresh, quoted, text_groups

CHUNK = 1 << 15
OVERLAP = 512
#: Pre-tokens that a worker remembers at most.
MEMO = 400_000

#: Characters whose class is the same in all versions of Unicode, less odd controls.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ž]*")
#: The pre-token pattern of the byte-level vocabulary.
_PIECE = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@functools.cache
def load_tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _margin(tokenizer: Tokenizer) -> int:
    return 2 + max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)


def _edges(tokenizer: Tokenizer, text: str, start: int, end: int) -> dict[int, int]:
    """Pre-token boundaries of ``text[start:end]``: position in the text -> tokens of this chunk before it."""
    enc = tokenizer.encode(text[start:end], add_special_tokens=False)
    at, last = {start: 0}, None
    for i, (word, (begin, _)) in enumerate(zip(enc.word_ids, enc.offsets, strict=True)):
        if word != last:
            at[start + begin] = i
            last = word
    at[end] = len(enc.ids)
    return at


def count_tokens(tokenizer: Tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text, encoding no more than a chunk at a time unless a pre-token is longer than that."""
    margin, size = _margin(tokenizer), len(text)
    begin, end = 0, min(chunk, size)
    left, base, total = _edges(tokenizer, text, begin, end), 0, 0  # base: tokens of the left chunk before its true start
    true_from = begin
    while end < size:
        width, spliced = overlap, False
        while not spliced and width < end - true_from:
            start = end - width
            after = min(start + chunk, size)
            if after <= end:
                after = min(end + chunk, size)
            right = _edges(tokenizer, text, start, after)
            common = [b for b in left if start < b <= end - margin and b > true_from and b in right]
            if common:
                b = max(common)
                total += left[b] - base
                left, base, true_from, begin, end, spliced = right, right[b], b, start, after, True
            width *= 2
        if not spliced:
            end = min(true_from + 2 * (end - true_from), size)
            begin, base, left = true_from, 0, _edges(tokenizer, text, true_from, end)
    return total + left[end] - base


class ChunkCounter:
    """Tokens of texts of one chunk each, remembering the pre-tokens it has seen."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, int] = {}

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        plain = [PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        pieces = [_PIECE.findall(t) if p else [] for t, p in zip(texts, plain, strict=True)]
        seen = set().union(*pieces)
        unseen = [x for x in seen if x not in self.memo]
        if len(self.memo) + len(unseen) > MEMO:
            self.memo, unseen = {}, list(seen)
        self.memo.update(zip(unseen, self._encoded(unseen), strict=True))
        rest = iter(self._encoded([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [sum(map(self.memo.__getitem__, own)) if p else next(rest) for own, p in zip(pieces, plain, strict=True)]


def token_counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """An Arrow UDF: text -> number of tokens."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = load_tokenizer(path)
        counter = ChunkCounter(tokenizer)
        for column in batches:
            out: list[int] = []
            for group in text_groups(column):
                short = iter(counter.count([t for t in group if len(t) <= chunk]))
                out += [next(short) if len(t) <= chunk else count_tokens(tokenizer, t, chunk, overlap) for t in group]
            yield pa.array(out, pa.int64())

    return count


def with_token_counts(docs: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None,
                      chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Add the number of tokens of ``text`` as column ``out`` (under a free name if ``out`` is taken).

    Null and empty texts have 0 tokens; repeated rows are counted each; other columns pass through; an empty table
    gives an empty table.  Special strings inside a text are handled as the library does by default.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    return docs.withColumn(fresh(docs, out), token_counter(path, chunk, overlap)(quoted(text)))


def n_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")
