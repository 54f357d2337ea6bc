"""Vectorised scanning of Arrow string columns: words, rolling hashes and minimisers, in NumPy over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BYTE = None
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def byte_codes() -> np.ndarray:
    """A pseudo-random 64-bit code for each byte."""
    global _BYTE
    if _BYTE is None:
        with np.errstate(over="ignore"):
            _BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
    return _BYTE


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers and their inverses modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 1 << 16)
        back = _U(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers, _inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, back))
    return _powers, _inverse


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end]: equal spans have equal hashes wherever they stand."""
    up, down = powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BASE)


def gram_sums(codes: np.ndarray, size: int) -> np.ndarray:
    """An unmixed 64-bit hash of the gram of `size` items from each position on; the largest value where there is none."""
    out = np.full(len(codes), np.iinfo(np.uint64).max, np.uint64)
    if len(codes) >= size:
        up, down = powers(len(codes) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(codes * up[: len(codes)], out=sums[1:])
            out[: len(codes) - size + 1] = (sums[size:] - sums[:-size]) * down[: len(codes) - size + 1]
    return out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, one text after another, and its n + 1 offsets. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, most: int = 1 << 19) -> Iterator[tuple]:
    """Cuts a batch into runs of rows with about `most` bytes of text; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    step = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-gap bytes in each text, and n + 1 bounds: text i has words bounds[i]:bounds[i+1]."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~gap[data]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty(len(data), bool)
    before[1:] = inside[:-1]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[:-1] = inside[1:]
    after[-1] = False
    after[first[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each item, the index of the text that holds it."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def room(bounds: np.ndarray, size: int) -> np.ndarray:
    """Positions at which a window of `size` items fits into its text."""
    fits = np.ones(bounds[-1], bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        fits[max(a, b - size + 1) : b] = False
    return np.flatnonzero(fits)


def window_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of values[i : i + size] for each i that has so many."""
    out, width = values, 1
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def minimisers(grams: np.ndarray, bounds: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts, and for each the position of its leftmost smallest gram.

    grams: a hash for each item; the one at i stands for the gram of `gram` items from i on. A window is `window` items of
    one text. The same window picks the same gram in it wherever it stands.
    """
    fits = room(bounds, window)
    if not len(fits):
        return fits, fits
    bits = _U(max(24, int(len(grams)).bit_length()))
    keys = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    per = window - gram + 1
    least = window_min(keys[: fits[-1] + per], per)[fits]
    return fits, (least & ((_U(1) << bits) - _U(1))).astype(np.int64)
