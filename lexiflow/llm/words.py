"""Words and shingles of many texts at once, as numpy arrays.

Spark deals out the rows; these helpers work on the texts of one Arrow batch, in
pieces of about a megabyte, so memory is bounded by a piece or by the longest text.
A word is a run of bytes outside ASCII white space; its 64-bit hash is a polynomial
over its bytes, mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
LENGTH = np.array([0xD6E8FEB86659FD93], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(salt)) | np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, PIECE_BYTES * 5 // 4)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if n <= 4 * PIECE_BYTES:
            _powers[base] = known
    return known[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(values)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(INVERSE, len(values) + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * LENGTH)


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """The same hash of each row of a matrix of values."""
    raw = ((rows.astype(np.uint64) + np.uint64(1)) * powers(BASE, rows.shape[1])).sum(axis=1, dtype=np.uint64)
    return mix(raw + LENGTH * np.uint64(rows.shape[1]))


def pieces(texts: list[bytes | None], most: int = PIECE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about `most` bytes together, with the index of the first."""
    first, size, held = 0, 0, []
    for i, text in enumerate(texts):
        text = text or b""
        if held and size + len(text) > most:
            yield first, held
            first, size, held = i, 0, []
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each word of the texts, in order. Lower-case A-Z before."""
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    space = SPACE[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(space & ~before)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    return owner, span_hashes(data, starts, ends)


def shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words make one shingle."""
    owner, hashes = words([t.lower() for t in texts])
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    factors = seeds(width, 17)
    total = max(0, len(hashes) - width + 1)
    combined = np.zeros(total, np.uint64)
    for k in range(width):
        combined += hashes[k : k + total] * factors[k]
    combined = mix(combined)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            out.append(np.unique(combined[a : b - width + 1]))
        elif b > a:
            short = (hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
