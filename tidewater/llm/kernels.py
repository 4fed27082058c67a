"""Vectorised text kernels: words, lines and their 64-bit hashes straight from Arrow buffers."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_STEP_INV = pow(_STEP, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random 64-bit value for each byte, and for each byte with A-Z as a-z.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_LOWER = BYTE[LOWER]

#: Bytes of words: not \x20 and \x09-\x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words: digits, letters and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_powers = [np.ones(1, U), np.ones(1, U)]
#: Bytes that one call of a kernel takes, unless one text is longer.
CHUNK = 1 << 19


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        for k, step in enumerate((_STEP, _STEP_INV)):
            x = np.full(size, U(step))
            x[0] = U(1)
            _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Row ranges of at most `limit` bytes, of one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def pieces(column: pa.Array):
    """(first row, last row, bytes, offsets) chunk by chunk."""
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
    """(row, start, end, hash) of each word, hashed with A-Z as a-z."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U)
    inside = word_bytes[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before[edge] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start, end, span_hash(prefix_hash(BYTE_LOWER[data]), start, end)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def shingles(row: np.ndarray, h: np.ndarray, rows: int, k: int):
    """Distinct hashes of k-word shingles of each row, fewer words counting as one: (row, hash) in order of row, hash."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, U)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    acc = np.zeros(len(h), U)
    for i in range(k):
        acc[: len(h) - i] = mix(acc[: len(h) - i] * U(_STEP) + h[i:] + U(i + 1))
    place = np.arange(len(h)) - first[row]
    full = place + k <= count[row]
    out_row, out = row[full], acc[full]
    for n in range(1, k):
        at = first[count == n]
        if len(at):
            short = np.zeros(len(at), U)
            for i in range(n):
                short = mix(short * U(_STEP) + h[at + i] + U(i + 1))
            out_row, out = np.concatenate([out_row, row[at]]), np.concatenate([out, mix(short + U(n << 32))])
    if (count[count > 0] < k).any():
        order = np.argsort(out_row, kind="stable")
        out_row, out = out_row[order], out[order]
    edge = np.searchsorted(out_row, np.arange(rows + 1))
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        out[i:j].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out_row[1:] != out_row[:-1]) | (out[1:] != out[:-1])
    return out_row[new], out[new]


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class HashIndex:
    """Positions of 64-bit hashes in an array of distinct ones: a few direct tables, a gather each."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys).view(U)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.tables: list[np.ndarray] = []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            t = np.full(1 << self.bits, -1, np.int32)
            slot = self._slot(self.keys[left], len(self.tables))
            t[slot] = left
            self.tables.append(t)
            left = left[t[slot] != left]

    def _slot(self, h: np.ndarray, level: int) -> np.ndarray:
        return (h * U(2 * level + 1) + U(level)) >> U(64 - self.bits)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        for level, t in enumerate(self.tables):
            at = t[self._slot(h, level)]
            out = np.where((at >= 0) & (self.keys[at] == h), at, out)
        return out


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
