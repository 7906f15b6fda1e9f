"""Words of texts inside tasks: white space is space and the control characters 9 to 13, as ``bytes.split`` has it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words a worker remembers before it starts anew.
REMEMBERED = 500_000
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Base of the rolling sums and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


class WordHash(dict):
    """64-bit hash of a word given in UTF-8."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


HASH = WordHash()


def words_of(texts: pa.Array, i: int) -> list[bytes]:
    text = texts[i]
    return text.as_buffer().to_pybytes().split() if text.is_valid else []


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASH.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that leaves no order of the input."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """Hash of any range of a sequence of word hashes; equal ranges have equal hashes wherever they stand."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        powers = np.full(n + 1, BASE, np.uint64)
        inverse = np.full(n + 1, BASE_INVERSE, np.uint64)
        powers[0] = inverse[0] = 1
        self.inverse = np.cumprod(inverse, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * np.cumprod(powers, dtype=np.uint64)[:n], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each start the place of the smallest of ``width`` values, the leftmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, place, reach = values, np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        right, left = low[step:], low[:len(low) - step]
        take = right < left
        place = np.where(take, place[step:], place[:len(place) - step])
        low = np.where(take, right, left)
        reach += step
    return place[:n]


def word_chunks(batches: Iterator[pa.RecordBatch], text_at: int,
                most: int = 400_000) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Rows (the other columns as lists) with their word hashes, joined to chunks of about ``most`` words.

    Yields (rows, flat hashes, bounds): row i has the hashes bounds[i] to bounds[i + 1].
    """
    rows, parts, total = [], [], 0
    for batch in batches:
        others = [batch.column(c).to_pylist() for c in range(batch.num_columns) if c != text_at]
        for i in range(batch.num_rows):
            part = hashes_of(words_of(batch.column(text_at), i))
            rows.append(tuple(o[i] for o in others))
            parts.append(part)
            total += len(part)
            if total >= most or len(rows) >= 20_000:
                yield rows, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
                rows, parts, total = [], [], 0
    if rows:
        yield rows, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
