"""Words of a whole Arrow batch at once: numpy over the batch's UTF-8 bytes, no loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
#: A random number for each byte at each of the first places of a word; hashes of words are sums of these.
PLACES = 64
TABLE = np.random.default_rng(29).integers(0, 1 << 64, (PLACES, 256), dtype=np.uint64).ravel()
#: Bytes that are worked on together; one longer text is worked on alone.
CHUNK_BYTES = 4 << 20

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about size bytes; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin-1 letters in UTF-8."""
    out = LOWER[data]
    if len(out) > 1:
        high = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][high] += 0x20
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the bytes, and the number of words before each row (len rows + 1)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans must not be empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = stops - starts
    before = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    at = data[within + np.repeat(starts, lengths)].astype(np.int64)
    value = TABLE[((within & (PLACES - 1)) << 8) + at]
    far = np.flatnonzero(within >= PLACES)
    if len(far):  # the table again, mixed with the number of the run of places, so that runs that trade places change the sum
        value[far] = mix(value[far] + (within[far] >> 6).astype(np.uint64) * BASE)
    return mix(np.add.reduceat(value, before) + lengths.astype(np.uint64) * BASE)


def same_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether each span has the bytes of span number to[i]; spans must not be empty."""
    if not len(starts):
        return np.zeros(0, bool)
    lengths = stops - starts
    before = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    theirs = np.minimum(within + np.repeat(starts[to], lengths), len(data) - 1)
    return (lengths == lengths[to]) & np.logical_and.reduceat(data[within + np.repeat(starts, lengths)] == data[theirs], before)
