"""Words, shingles and hashes of many texts at once, from the bytes of an Arrow column.

A word is a maximal run of bytes other than space and the controls 9 to 13, so the words of a
text are those of ``[^\x20\x09-\x0D]+``.  Arrays cover a whole slice of a batch; slices hold about
``SLICE_BYTES`` of text (one text more, if it is longer), which bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1342543DE82EF95)


def inverse(odd: np.uint64) -> np.uint64:
    """The factor that undoes a multiplication by ``odd`` modulo 2**64."""
    return np.uint64(pow(int(odd), -1, 1 << 64))


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


_POWERS: dict[int, np.ndarray] = {}


def powers(factor: np.uint64, n: int) -> np.ndarray:
    """Powers from 0 on, modulo 2**64; those that an ordinary slice needs are kept."""
    kept = _POWERS.get(int(factor))
    if kept is None or len(kept) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        kept = np.full(size, factor, np.uint64)
        kept[0] = 1
        kept = np.multiply.accumulate(kept)
        if size <= 2 * SLICE_BYTES:
            _POWERS[int(factor)] = kept
    return kept[:n]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n + 1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``SLICE_BYTES`` of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        pieces = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
        cuts = np.flatnonzero(np.diff(pieces)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the n + 1 word offsets of the texts."""
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from one running sum over the bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=sums[1:])
    back = powers(inverse(BASE), len(data) + 1)
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` consecutive words; callers drop grams that cross texts."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(n):
            factor = np.uint64((int(factor) * int(STEP)) & 0xFFFFFFFFFFFFFFFF)
            out += words[i:i + len(out)] * factor
    return mix(out)


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a column and the texts' n + 1 word offsets."""
    data, offsets = raw(column)
    start, end, at = word_spans(data, offsets)
    return word_hashes(data, start, end), at


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of ``n`` consecutive words.

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    words, at = hashed_words(column)
    grams = gram_hashes(words, n)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= n:
            yield np.unique(grams[a:b - n + 1])
        elif b > a:
            yield gram_hashes(words[a:b], int(b - a)) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)
