"""Packed arrays of numbers, and hashes of sequences."""

from __future__ import annotations

from functools import cache

import numpy as np
import zstandard


@cache
def _squeeze() -> zstandard.ZstdCompressor:
    """One per process; a new one for each message would cost more than its work."""
    return zstandard.ZstdCompressor(level=1)


@cache
def _expand() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _planes(values: np.ndarray) -> bytes:
    """Byte planes, compressed: the high bytes of small numbers cost nothing."""
    planes = values.view(np.uint8).reshape(len(values), -1).T
    return _squeeze().compress(np.ascontiguousarray(planes).tobytes())


def _unplanes(data: bytes, kind: type, n: int) -> np.ndarray:
    raw = np.frombuffer(_expand().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).reshape(n)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as compressed differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)).astype(np.uint64))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unplanes(data, np.uint64, n), dtype=np.uint64)


def pack_numbers(values: np.ndarray, kind: type = np.uint32) -> bytes:
    return _planes(values.astype(kind))


def unpack_numbers(data: bytes, n: int, kind: type = np.uint32) -> np.ndarray:
    return _unplanes(data, kind, n)


def mix(keys: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys evenly (the finalizer of a public 64-bit mixer)."""
    k = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        k = (k ^ (k >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        k = (k ^ (k >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return k ^ (k >> np.uint64(31))


def chain(keys: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Key of a sequence made longer by one element."""
    with np.errstate(over="ignore"):
        return mix(keys * np.uint64(0x9E3779B97F4A7C15) + more)
