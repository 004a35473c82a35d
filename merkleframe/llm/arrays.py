"""Words, lines and shingles of a batch of texts, as numpy arrays over its bytes.

Memory is bounded by the batch: batches are cut to BATCH_BYTES, and hashes are made in pieces of PIECE_BYTES. A text
longer than that is a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BATCH_BYTES = 2 << 20
PIECE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.random.default_rng(7).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z lower-cased, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of about ``limit`` bytes each, of a row at least."""
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32 if column.type in (pa.string(), pa.binary()) else np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + limit, side="right")) - 1)
        yield at, min(end, len(column))
        at = min(end, len(column))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offset of each row and of the end, from 0."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    first, last = int(offsets[0]), int(offsets[-1])
    buf = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return buf, offsets - first


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(max(n, PIECE_BYTES), base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def segment_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each buf[start:end]; starts ascend, segments don't overlap."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        lo = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, lo + PIECE_BYTES, side="right")))
        hi = int(ends[b - 1])
        up, down = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[buf[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each run without ASCII white space, and its row."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~BLANK[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def per_row(rows: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each row's items, given the ascending row of each."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingles(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of a row, and the index of their first word. A row of fewer words, but not none, has its whole sequence as one."""
    n = max(0, len(h) - size + 1)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += h[j : j + n] * _STEP[j]
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    ok = np.arange(n) + size <= row_end[:n]
    at = np.flatnonzero(ok)
    out = mix(total[ok] + np.uint64(size))
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < size))
    if len(short):
        more = np.array([(h[bounds[r] : bounds[r + 1]] * _STEP[: bounds[r + 1] - bounds[r]]).sum(dtype=np.uint64) + np.uint64(bounds[r + 1] - bounds[r]) for r in short], np.uint64)
        at = np.concatenate([at, bounds[short]])
        out = np.concatenate([out, mix(more)])
        order = np.argsort(at, kind="stable")
        at, out = at[order], out[order]
    return out, at
