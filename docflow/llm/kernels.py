"""numpy kernels over whole Arrow batches of UTF-8 text: words, lines and their 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel works on at once.
CHUNK = 1 << 20
#: Spans of so many bytes are hashed one by one: modulo 2^64, long runs of two letters exist whose sums of powers agree.
LONG = 512
_rng = np.random.default_rng(20240607)
_TABLES = _rng.integers(0, 2**64, size=(2, 256), dtype=np.uint64)
_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
_INVERSES = np.array([pow(int(b), -1, 2**64) for b in _BASES], dtype=np.uint64)
_powers: dict[tuple[int, bool], np.ndarray] = {}

#: ASCII white space of the contracts: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(which: int, n: int, inverse: bool) -> np.ndarray:
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        p = np.full(size, (_INVERSES if inverse else _BASES)[which], dtype=np.uint64)
        p[0] = 1
        have = np.cumprod(p, dtype=np.uint64)
        if size <= 2 * CHUNK:
            _powers[which, inverse] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes give equal hashes wherever they lie."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[which][data] * _power(which, len(data), False), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(which, len(data) + 1, True)[starts]
    out = mix(h + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts >= LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([which])).digest(), "little")
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets into them; nulls count as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Row ranges (first, last) of about ``size`` bytes each, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``mask`` that no row boundary in ``offsets`` cuts."""
    if len(mask) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | edge[1:-1]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1
