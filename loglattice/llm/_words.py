"""Words and rolling hashes of whole Arrow string columns, vectorised over their byte buffers.

A word is a maximal run of bytes other than space and ``\\x09``-``\\x0d``.  Its 64-bit hash chains an invertible mixer over
its eight-byte pieces (BLAKE2b beyond 64 bytes), so no structure of the letters survives in it.  Runs of words are hashed
by Rabin-Karp polynomials modulo the prime 2**61 - 1: two unequal runs of w words meet with a chance of about w / 2**61 a
base, and callers that compare all runs of a corpus take two bases.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa

PRIME = (1 << 61) - 1
BASES = (0x1A3F9D5C7B20E64D, 0x0C8E51F2D96B37A5)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_CUT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of a little-endian piece
_LONG = 64
_CHUNK = 1 << 15


_libc = ctypes.CDLL(None)
if hasattr(_libc, "mallopt"):
    _libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, kept fixed: freed arrays go back to the system


def trim() -> None:
    """Give freed memory back; workers live on between tasks and stages and share their executor's limit."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(column: pa.Array, most: int = 2 << 20):
    """(first row, byte offsets, bytes) of consecutive rows with at most ``most`` bytes, or one longer row; null: empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if n and buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, offsets[at : end + 1] - offsets[at], data[offsets[at] : offsets[end]]
        at = end
    trim()


def word_spans(offsets: np.ndarray, data: np.ndarray, between: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every word; between: another table of the bytes that separate words."""
    word = ~(SPACE if between is None else between)[data]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    full = np.diff(offsets) > 0
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begins[heads], stops[tails] = word[heads], word[tails]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def word_hashes(offsets: np.ndarray, data: np.ndarray, lower: bool = False, between: np.ndarray | None = None, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each row's first word, with the total at the end).

    between: another table of the bytes that separate words; prefix: hash so many leading bytes of each word only.
    """
    starts, ends = word_spans(offsets, data, between)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    size = ends - starts
    if prefix:
        size = np.minimum(size, prefix)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    pieces = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from any place on
    hashes = mix((pieces[starts] & _CUT[np.minimum(size, 8)]) ^ mix(size.astype(np.uint64)))
    more, at = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(more):
        left = np.minimum(size[more] - at, 8)
        hashes[more] = mix(hashes[more] * np.uint64(0x9E3779B97F4A7C15) ^ (pieces[starts[more] + at] & _CUT[left]))
        at += 8
        more = more[size[more] > at]
    for k in np.flatnonzero(size > _LONG).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(padded[starts[k] : starts[k] + size[k]].tobytes(), digest_size=8).digest(), "little")
    return hashes, first


def _folded(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(PRIME)) + (x >> np.uint64(61))


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo PRIME for a, b of about 61 bits, in 64-bit steps: halves of 31 bits, 2**61 being 1."""
    low = np.uint64((1 << 31) - 1)
    a0, a1, b0, b1 = a & low, a >> np.uint64(31), np.uint64(b & ((1 << 31) - 1)), np.uint64(b >> 31)
    middle = a1 * b0 + a0 * b1
    return _folded(a0 * b0 + (a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)))


def _rolled(x: np.ndarray, width: int, base: int) -> np.ndarray:
    """The polynomial of every ``width`` consecutive values, by doubling: H(a+b) = H(a) * base**b + H(b) behind it."""
    out, covered, piece, size = None, 0, x, 1
    while True:
        power = pow(base, size, PRIME)
        if width & size:
            if out is None:
                out = piece
            else:
                n = len(piece) - covered
                out = _folded(_times(out[:n], power) + piece[covered:])
            covered += size
        if 2 * size > width:
            return out[: len(x) - width + 1]
        piece = _folded(_times(piece[:-size], power) + piece[size:])
        size *= 2


def runs(words: np.ndarray, first: np.ndarray, width: int, bases: int = 1) -> tuple[np.ndarray, ...]:
    """(place of the first word, Rabin-Karp hash by each base ...) of every run of ``width`` words that lies in one row."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in range(bases))
    inside = np.ones(n, bool)
    for back in range(1, width):  # a run may not begin within width - 1 words before the next row
        cut = first[1:-1] - back
        inside[cut[(cut >= 0) & (cut < n)]] = False
    values = [np.empty(n, np.uint64) for _ in range(bases)]
    for at in range(0, n, _CHUNK):  # chunks that stay in the processor's cache
        x = words[at : at + _CHUNK + width - 1] >> np.uint64(3)
        for out, base in zip(values, BASES, strict=False):
            out[at : at + _CHUNK] = mix(_rolled(x, width, base))
    return np.flatnonzero(inside), *(v[inside] for v in values)
