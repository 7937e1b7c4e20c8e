"""Blocks of documents and their dictionaries.

Corpus-wide numbers (how often a shingle, word or context occurs) are needed for every token of every text.
Instead of one shuffled row per token, documents are dealt into blocks of about equal text size by a hash; each
block sends the sorted list of its distinct keys, cut into parts by key, as one packed row per part; each part
adds up the blocks and answers every block's list in the same order.  Rows stay few and small, hot keys appear
once per block, and no list is ever complete in one place.
"""

from __future__ import annotations

import numpy as np
import zstandard

_BITS = 8


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as compressed differences (byte planes, so that the high zeros vanish)."""
    d = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = d.view(np.uint8).reshape(-1, _BITS).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    planes = raw.reshape(_BITS, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view("<u8").ravel(), dtype=np.uint64)


def pack_numbers(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack_numbers(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def pack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor) over uint64 arrays."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
