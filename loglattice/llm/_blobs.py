"""Compact binary runs of sorted 64-bit hashes, the unit in which hashes are shuffled.

Rows of single hashes cost about 30 bytes each in a shuffle; a sorted run stored as byte planes of its gaps costs
about 6.  Every run belongs to one bucket of the hash range, so a group of runs holds all occurrences of its hashes.
"""

from __future__ import annotations

import zlib

import numpy as np


def pack_ints(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values as byte planes without the empty ones."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = [i for i in range(8) if len(values) and planes[i].any()]
    return bytes([sum(1 << i for i in used)]) + b"".join(planes[i].tobytes() for i in used)


def unpack_ints(data: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    planes, at = np.zeros((8, n), np.uint8), 1
    for i in range(8):
        if data[0] >> i & 1:
            planes[i] = np.frombuffer(data, np.uint8, n, at)
            at += n
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64), data[at:]


def pack_run(hashes: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted hashes, and for each hash the same place of every column."""
    gaps = hashes.copy()
    gaps[1:] -= hashes[:-1]
    return len(hashes).to_bytes(8, "little") + pack_ints(gaps) + b"".join(pack_ints(c) for c in columns)


def unpack_run(data: bytes, columns: int = 0) -> list[np.ndarray]:
    view = memoryview(data)
    n, rest = int.from_bytes(view[:8], "little"), view[8:]
    gaps, rest = unpack_ints(rest, n)
    out = [np.cumsum(gaps, dtype=np.uint64)]
    for _ in range(columns):
        values, rest = unpack_ints(rest, n)
        out.append(values)
    return out


def pack_table(*columns: np.ndarray) -> bytes:
    """Integer columns of one length, deflated; ids that follow each other shrink to almost nothing."""
    n = len(columns[0])
    body = [np.diff(c.astype(np.int64), prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return n.to_bytes(8, "little") + zlib.compress(b"".join(body), 1)


def unpack_table(data: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    flat = np.frombuffer(zlib.decompress(data[8:]), np.uint8).reshape(columns, 8, n)
    return [np.cumsum(np.ascontiguousarray(flat[i].T).view("<i8").reshape(-1)) for i in range(columns)]


def bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Cuts of a sorted run into equal ranges of the hash space."""
    bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_hashes, bounds), [len(sorted_hashes)]))
