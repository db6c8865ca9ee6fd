"""Words of many texts at once, as numpy arrays over one Arrow string buffer.

Texts stay UTF-8 bytes. A word is a run of bytes of a class; every word gets a
64-bit hash, so that counting and comparing words needs no Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are tokenized at once; a longer single text is taken whole.
CHUNK_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: digits, a-z, all beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (two multiply-and-shift steps)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """Words of consecutive texts; text i has the words first[i]:first[i + 1]."""

    data: np.ndarray  # lower-cased bytes of all texts
    bounds: np.ndarray  # text i is data[bounds[i]:bounds[i + 1]]
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers_of(_BASE, n)[:n], out=sums[1:])
        value = (sums[self.end] - sums[self.start]) * _powers_of(_INVERSE, n)[self.start]
        return mix(value + (self.end - self.start).astype(np.uint64))

    def text_of(self) -> np.ndarray:
        """The index of the text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def string(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def split_words(texts: pa.Array, letters: np.ndarray) -> Words:
    """The words of a (non-chunked) string array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) else np.int64)
    bounds = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2]
    raw = np.frombuffer(body, dtype=np.uint8)[bounds[0] : bounds[-1]] if body is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    data = _LOWER[raw]
    inside = letters[data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = bounds[(bounds > 0) & (bounds < len(data))]
        begins[edges] |= inside[edges]
        ends[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, bounds, start, end, np.searchsorted(start, bounds))


def chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices with at most max_bytes of text each (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
            texts = texts.cast(pa.string())
        width = np.int32 if pa.types.is_string(texts.type) else np.int64
        ends = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + max_bytes, side="right")) - 1)
            yield batch.slice(row, stop - row)
            row = stop


def pieces(batches: Iterator[pa.RecordBatch], struct: str, field: str, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """As chunks(), for texts that are a field of a struct column: the slices, each with its texts."""
    for batch in batches:
        texts = batch.column(struct).field(field)
        if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
            texts = texts.cast(pa.string())
        at = 0
        for part in chunks(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", max_bytes):
            yield batch.slice(at, part.num_rows), part.column("text")
            at += part.num_rows
