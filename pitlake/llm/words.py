"""Words of whole texts, found and hashed in numpy over the bytes of an Arrow batch.

Texts are UTF-8 bytes end to end, so one pass of array operations handles thousands of documents.
A word's 64-bit hash is a polynomial over random byte values, mixed at the end; equal words always
get equal hashes, and two given different words collide with a chance near 2^-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_POW = {"up": np.ones(1, U64), "down": np.ones(1, U64)}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SPACE = np.ones(256, bool)
_SPACE[[32, *range(9, 14)]] = False
_ALNUM = np.ones(256, bool)
_ALNUM[:48] = _ALNUM[58:97] = _ALNUM[123:128] = False
#: Bytes of words, after A-Z are lowered: runs without white space, or of letters, digits and non-ASCII.
CLASSES = {"space": _SPACE, "alnum": _ALNUM}


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["up"]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INV)):
                step = np.full(size, U64(base))
                step[0] = 1
                _POW[name] = np.multiply.accumulate(step)
    return _POW["up"], _POW["down"]


def texts(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) for runs of rows of about limit bytes; null is empty.

    A longer text comes alone and whole.
    """
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    if column.null_count:
        size = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        data = data[np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        offsets = np.concatenate([[0], np.cumsum(size)])
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    pa.default_memory_pool().release_unused()


@dataclass
class Words:
    """Words of a run of rows, in order: hash, row (from 0), byte range; first[r]:first[r+1] are row r's."""

    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray


def bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set bytes; a run ends with its row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range."""
    up, down = _powers(len(low) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(low) + 1, U64)
        np.take(_BYTE, low, out=sums[1:])
        sums[1:] *= up[: len(low)]
        np.cumsum(sums[1:], out=sums[1:])
        value = (sums[end] - sums[start]) * down[start]
        value += (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(value)


def words(data: np.ndarray, offsets: np.ndarray, kind: str) -> Words:
    """Lower-cased words of a run of rows."""
    low = LOWER[data]
    start, end = bounds(CLASSES[kind][low], offsets)
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(hashes(low, start, end), row, first, start, end)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of width consecutive words."""
    out = np.zeros(max(0, len(hashes) - width + 1), U64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out * U64(0xC2B2AE3D27D4EB4F)) ^ mix(hashes[k : k + len(out)] + U64(k + 1))
    return mix(out)
