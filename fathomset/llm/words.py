"""Words of many texts at once, as hashes in arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time (one longer text is hashed alone).
BLOCK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTERS_AND_DIGITS = np.zeros(256, bool)
LETTERS_AND_DIGITS[48:58] = LETTERS_AND_DIGITS[97:123] = LETTERS_AND_DIGITS[128:] = True
LETTERS_AND_DIGITS[65:91] = True
BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE, STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """The words of consecutive texts: hashes, byte ranges in ``data``, and the first word of each text."""

    data: np.ndarray
    hashes: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one more than texts

    def grams(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on; ``NEVER`` where the text has fewer left."""
        n = len(self.hashes)
        out = np.full(n, NEVER)
        if n >= size:
            acc = self.hashes[:n - size + 1].copy()
            for j in range(1, size):
                acc = acc * STEP + self.hashes[j:n - size + 1 + j]
            out[:n - size + 1] = mixed(acc) >> np.uint64(1)
            stop = np.repeat(self.first[1:], np.diff(self.first))
            out[np.arange(n) + size > stop] = NEVER
        return out

    def text(self, at: int, size: int) -> bytes:
        return b" ".join(bytes(self.data[self.begins[i]:self.ends[i]]) for i in range(at, at + size))


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = LETTERS_AND_DIGITS) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]`` (UTF-8): runs of the bytes that ``is_word`` names, A-Z lower-cased."""
    data = LOWER[data]
    inside = is_word[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[edges] = inside[edges]
    begins = np.flatnonzero(starts)
    first = np.searchsorted(begins, offsets)
    if not len(begins):
        return Words(data, np.zeros(0, np.uint64), begins, begins, first)
    own = data[inside]
    heads = np.flatnonzero(starts[inside])
    sizes = np.diff(np.append(heads, len(own)))
    place = np.arange(len(own)) - np.repeat(heads, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), BASE))
    hashes = mixed(np.add.reduceat(BYTE[own] * powers[place], heads))
    return Words(data, hashes, begins, begins + sizes, first)


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of the texts of an Arrow column (null: empty), about ``limit`` bytes at a time."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b
