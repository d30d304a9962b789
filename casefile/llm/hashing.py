"""Vectorised hashing of words, word shingles and sets of them; 64 bits, the same in every process."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed together; a longer text is cut at word ends.
WINDOW = 1 << 18

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (shift-multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(20240501)
#: A random value per byte, and the odd base whose powers weigh places in a word.
BYTE_VALUE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Random odd weights of the places in a shingle; their number is the longest shingle.
PLACE = _rng.integers(1, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers[0] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, BASE, np.uint64))])
    return _powers[0]


def batches_of(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about ``size`` bytes each."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(lengths):
        held += int(n)
        if held >= size:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(lengths):
        yield at, len(lengths)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's rows one after the other, and where each row starts; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = AS_IS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all rows, and where each row's words start."""
    starts_all, hashes = [], []
    at, size = 0, len(data)
    row_starts = offsets[:-1][np.diff(offsets) > 0]
    while at < size:
        end = min(size, at + WINDOW)
        while end < size:  # go on to a separator or the start of a row
            ahead = np.flatnonzero(SEPARATOR[data[end : end + 65536]])
            cut = end + int(ahead[0]) if len(ahead) else min(size, end + 65536)
            row = np.searchsorted(row_starts, end)
            if row < len(row_starts) and row_starts[row] <= cut:
                end = int(row_starts[row])
                break
            end = cut
            if len(ahead):
                break
        part = data[at:end]
        word = ~SEPARATOR[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = row_starts[(row_starts >= at) & (row_starts < end)] - at
        first[inner] = word[inner]
        starts = np.flatnonzero(first)
        if len(starts):
            place = np.arange(starts[0], len(part)) - np.repeat(starts, np.diff(np.append(starts, len(part))))
            value = BYTE_VALUE[fold[part[starts[0] :]]]
            value[~word[starts[0] :]] = 0
            value *= powers(int(place.max()) + 1)[place]
            hashes.append(mix(np.add.reduceat(value, starts - starts[0])))
            starts_all.append(starts + at)
        at = end
    starts = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.searchsorted(starts, offsets)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(k))
    for i in range(k):
        total += words[i : i + n] * PLACE[i]
    return mix(total)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words are one shingle, none is the empty set."""
    if not len(words):
        return words
    return np.unique(windows(words, min(k, len(words))))


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, as two signed numbers."""
    a = np.add.reduce(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))) if len(hashes) else np.uint64(0)
    b = np.add.reduce(mix(hashes + np.uint64(0x632BE59BD9B4E019))) if len(hashes) else np.uint64(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
