"""Word hashes and rolling hashes of many texts at once, as NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: Distinct words whose hashes a worker remembers, each of so many bytes at most.
CACHE, CACHED_WORD = 100_000, 64
#: Texts are worked on in slices of at most so many bytes, one text at least.
SLICE_BYTES = 1_000_000


def slices(sizes, most: int = SLICE_BYTES, rows: int = 2000) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbouring rows that hold ``most`` bytes and ``rows`` rows at most, one row at least."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > most or i - start >= rows):
            yield start, i
            start, held = i, 0
        held += n
    if len(sizes):
        yield start, len(sizes)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_WORD and len(self) < CACHE:
            self[word] = found
        return found


_cache = _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if len(_cache) >= CACHE:
        _cache.clear()
    return np.fromiter(map(_cache.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that their order says nothing about the input."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(1, n), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values, by prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray):
        self.back = powers(INVERSE, len(values) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(values * powers(BASE, len(values))[: len(values)])])

    def span(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of each stretch; stretches of different length differ even if all values are 0."""
        raw = (self.sums[start + length] - self.sums[start]) * self.back[start]
        return mixed(raw + np.asarray(length).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        return self.span(np.arange(max(0, len(self.sums) - width)), width)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each ``width`` neighbours, in log2(width) passes."""
    if len(x) < width:
        return x[:0]
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x
