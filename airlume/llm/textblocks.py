"""Words of many texts at once, as numpy arrays.

A block is a bounded run of texts laid one after another. Words are found on the
bytes of the block, so no Python object is made per word, and hashes of words and
of runs of words are array operations.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Bytes of text worked on together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
# Bytes hashed by one cumulative sum.
SEGMENT_BYTES = 1 << 17
# Rows of a batch turned into Python objects at a time.
ROWS = 256
# A row without an id stands behind all others.
NO_ID = np.iinfo(np.int64).max

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def blocks(
    batches: Iterable[pa.RecordBatch], block_bytes: int = BLOCK_BYTES
) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, texts) of at most about ``block_bytes`` from batches of (id, text); nulls are empty."""
    ids: list[int] = []
    texts: list[bytes] = []
    held = 0
    for batch in slices(batches):
        for key, text in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
            if held and held + len(text) > block_bytes:
                yield np.array(ids, np.int64), texts
                ids, texts, held = [], [], 0
            ids.append(NO_ID if key is None else key)
            texts.append(text)
            held += len(text) + 16
    if ids:
        yield np.array(ids, np.int64), texts


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows; texts are long, so Spark's own are large."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def encoded(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a text column, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


@dataclass
class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of the texts of a block, in order."""

    data: np.ndarray  # bytes of the block
    start: np.ndarray  # of each word in data
    end: np.ndarray
    doc: np.ndarray  # index of each word's text
    place: np.ndarray  # of each word in its text
    count: np.ndarray  # words of each text

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        inside = ~_SPACE[data]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        start, end = edges[::2], edges[1::2]
        first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
        doc = np.searchsorted(first, start, "right") - 1
        count = np.bincount(doc, minlength=len(texts))[: len(texts)]
        before = np.cumsum(count) - count
        return cls(data, start, end, doc, np.arange(len(start)) - before[doc], count)

    def hashes(self, seed: int) -> np.ndarray:
        """One 64-bit hash per word, the same wherever the word stands."""
        table, base, inverse = _base(seed)
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):
            low = self.start[at]
            to = max(at + 1, np.searchsorted(self.end, low + SEGMENT_BYTES, "right"))
            high = self.end[to - 1]
            size = _ceil_power(int(high - low) + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(table[self.data[low:high]] * _powers(base, size)[: high - low], out=sums[1:])
            s, e = self.start[at:to] - low, self.end[at:to] - low
            out[at:to] = (sums[e] - sums[s]) * _powers(inverse, size)[s]
            at = to
        return mixed(out)

    def grams(self, hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on; meaningless where ``fits`` is false."""
        n = max(0, len(hashes) - size + 1)
        out = np.zeros(len(hashes), np.uint64)
        factor = np.uint64(_base(seed)[1])
        for k in range(size):
            out[:n] *= factor
            out[:n] += hashes[k : k + n]
        return mixed(out)

    def fits(self, size: int) -> np.ndarray:
        """Whether ``size`` words from each word on lie in its text."""
        return self.place + size <= self.count[self.doc]


def word_codes(words: Words) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal for equal words only, and the words by their numbers."""
    size = words.end - words.start
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.start] = 1
    inside[words.end] -= 1
    letters = words.data[np.cumsum(inside[:-1]) > 0]
    column = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(letters))
    coded = column.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


# Primes of XXH64: fixed values.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def xxhash64(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each 64-bit integer, equal to Spark's function of that name."""
    turn = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
    x = turn(values.view(np.uint64) * _P2, 31) * _P1
    x = turn(np.uint64(seed + 8 + int(_P5)) ^ x, 27) * _P1 + _P4
    x = (x ^ x >> np.uint64(33)) * _P2
    x = (x ^ x >> np.uint64(29)) * _P3
    return x ^ x >> np.uint64(32)


@lru_cache(maxsize=8)
def _base(seed: int) -> tuple[np.ndarray, int, int]:
    """Random values for the 256 bytes, an odd factor and its inverse modulo 2^64."""
    draw = np.random.default_rng(seed)
    table = draw.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
    base = int(draw.integers(1 << 40, 1 << 63)) * 8 + 5 & (1 << 64) - 1
    return table, base, pow(base, -1, 1 << 64)


def _ceil_power(n: int) -> int:
    return max(SEGMENT_BYTES * 2, 1 << (n - 1).bit_length())


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)
