"""Vectorised text primitives over Arrow string arrays: words, lines, rolling hashes, packed records.

Everything works on the UTF-8 buffer of a batch with numpy; there is no Python loop over characters or words.
Null texts count as empty. Hashes are 64-bit: polynomial over random byte values modulo 2**64, then mixed twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _byte_values(seed: int, fold_case: bool) -> np.ndarray:
    values = np.random.default_rng(seed).integers(1, 2**64, 256, dtype=U)
    if fold_case:
        values[65:91] = values[97:123]
    return values


BYTES = _byte_values(11, False)
FOLDED = _byte_values(11, True)
_powers = np.ones(1, U)
_inverse_powers = np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n, kept between calls."""
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, _BASE, U)]), dtype=U)
            _inverse_powers = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, _INVERSE, U)]), dtype=U)
    return _powers[:n], _inverse_powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def utf8(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one uint8 array and the n + 1 offsets; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 19, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batches again, cut to about `most` bytes of text and `rows` rows at the most; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows, start + rows)
            yield batch.slice(start, end - start)
            start = end


class Rolling:
    """Hashes of any byte ranges of a buffer in constant time each."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTES):
        self.powers, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(values[data] * self.powers[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed with the length, so that it need not be kept beside the hash."""
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(raw + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and n + 1 offsets of each text's words among them."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACES[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    edge[1:] = ~inside[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & edge)
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, doc_offsets: np.ndarray, width: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which `width` consecutive units of one text start, and the windows' hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U)
    coefficients = np.random.default_rng(seed).integers(1, 2**63, width, dtype=U) * U(2) + U(1)
    total = hashes[:n] * coefficients[0]
    for i in range(1, width):
        total += hashes[i : i + n] * coefficients[i]
    sizes = np.diff(doc_offsets)
    good = np.repeat(np.arange(len(sizes)), sizes)
    keep = np.flatnonzero(good[:n] == good[width - 1 :])
    return keep, mix(total[keep])


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines between newlines, and n + 1 offsets of each text's lines; an empty text has one line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    return starts, ends, np.searchsorted(breaks, offsets) + np.arange(len(offsets))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a plain sort is many times faster here than numpy's hash-based unique."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    x = np.sort(x)
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))
    return x[starts], np.diff(np.append(starts, len(x)))


def run_ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows sorted by the keys (the last first), stable, and which of them start a run of equal keys."""
    order = np.lexsort(keys)
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = False
        for k in keys:
            first[1:] |= k[order][1:] != k[order][:-1]
    return order, first


def doc_of(doc_offsets: np.ndarray) -> np.ndarray:
    """For each unit the number of its text within the batch."""
    sizes = np.diff(doc_offsets)
    return np.repeat(np.arange(len(sizes)), sizes)


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n units some window [start, start + width) covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:n]) > 0


def digits(array: np.ndarray) -> pa.Array:
    """Rows of a fixed-width numpy record array as one Arrow binary value."""
    return pa.array([array.tobytes()], pa.binary())
