"""Array forms of texts inside a task: Arrow string columns as bytes, word bounds and 64-bit hashes.

Everything here works on one slice of a record batch at a time (about ``SLICE_BYTES`` of text, one
longer text alone), so memory stays a small multiple of the slice whatever the partition holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C0B)  # odd, 3 mod 8: its powers stay spread over 2**64
_U = np.uint64
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply rounds)."""
    x = x ^ _U(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i mod 2**64 for i < n (kept for the task, grown by doubling)."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        m = max(n, 1 << 20)
        for name, b in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            p = np.full(m, b, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of (byte+1) * B**j over j < i, mod 2**64."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end), the same wherever the bytes stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a copy per row; a null row is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``limit`` bytes each; a longer row is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of consecutive rows: byte bounds, row of each, first word of each row."""

    data: np.ndarray    # bytes of the slice
    offsets: np.ndarray  # row bounds in data
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray   # len rows + 1: words of row r are first[r]..first[r+1]

    def hashes(self, lower: bool = True) -> np.ndarray:
        d = self.data
        if lower:
            d = d + (((d >= 65) & (d <= 90)) << 5).astype(np.uint8)
        return span_hash(prefix_sums(d), self.start, self.end)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Word bounds of all rows at once; a word never crosses a row."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~space
    begins = word.copy()
    begins[1:] &= space[:-1]
    ends = word.copy()
    ends[:-1] &= space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, row, first)


def word_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(a, b, words of rows a..b) over a string column."""
    data, off = texts(column)
    for a, b in slices(off, limit):
        yield a, b, words(data[off[a]: off[b]], off[a: b + 1] - off[a])


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of k words inside a row; a row with 1..k-1 words gives its whole sequence."""
    n = len(h)
    count = np.diff(first)
    rows = np.repeat(np.arange(len(count)), count)
    left = np.repeat(first[1:], count) - np.arange(n)  # words left in the row, own included
    acc = np.full(n, 0x5851F42D4C957F2D, dtype=np.uint64)
    pad = np.concatenate([h, np.zeros(k, dtype=np.uint64)])
    for j in range(k):
        acc = mix(np.where(left > j, acc * _U(6364136223846793005) + pad[j: j + n], acc + _U(j)))
    take = (left >= k) | ((np.repeat(count, count) < k) & (np.arange(n) == np.repeat(first[:-1], count)))
    return acc[take], rows[take]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of v[i:i+w] for every i with a full window."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    out, have = v, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[w - have: w - have + n])
