"""Compact payloads that blocks and owners exchange: Rice-coded sorted fingerprints, bitmaps, packed words and counts."""

from __future__ import annotations

import numpy as np
import zstandard


def rice_encode(values: np.ndarray, bits: int) -> bytes:
    """Golomb code with divisor 2**k of the gaps between sorted distinct unsigned values below 2**``bits``.

    One byte holds k; then each gap has its quotient in unary (ones, then a zero) and its remainder in k bits.
    """
    n = len(values)
    if not n:
        return b""
    v = values.astype(np.uint64)
    gaps = np.diff(v, prepend=np.uint64(0))
    mean = max(1.0, 2.0**bits / (n + 1))
    k = int(np.clip(np.floor(np.log2(mean * 0.69 + 1e-9)), 0, 63)) if mean > 1 else 0
    k = max(k, int(int(gaps.max()) >> 16).bit_length())  # keeps every quotient below 2**16
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1 + k)
    out = np.ones(int(ends[-1]), np.uint8)
    stops = ends - k - 1
    out[stops] = 0
    for j in range(k):
        out[stops + 1 + j] = (gaps >> np.uint64(k - 1 - j)).astype(np.uint8) & 1
    return bytes([k]) + np.packbits(out).tobytes()


def rice_decode(data: bytes, n: int) -> np.ndarray:
    """The ``n`` values that :func:`rice_encode` was given."""
    if not n:
        return np.zeros(0, np.uint64)
    k = data[0]
    flags = np.unpackbits(np.frombuffer(data, np.uint8, offset=1))
    zeros = np.flatnonzero(flags == 0)
    stops, at, where = np.empty(n, np.int64), 0, 0
    for i in range(n):  # the next zero at or after ``at`` ends a unary part
        while zeros[where] < at:
            where += 1
        stops[i] = zeros[where]
        at = int(zeros[where]) + k + 1
    begins = np.concatenate(([0], stops[:-1] + k + 1))
    gaps = (stops - begins).astype(np.uint64) << np.uint64(k)
    for j in range(k):
        gaps |= flags[stops + 1 + j].astype(np.uint64) << np.uint64(k - 1 - j)
    return np.cumsum(gaps, dtype=np.uint64)


def pack_words(words: list[bytes]) -> bytes:
    """Words without line feeds, in the order given."""
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    joined = zstandard.ZstdDecompressor().decompress(data)
    return joined.split(b"\n") if joined else []


def pack_numbers(values: np.ndarray) -> bytes:
    """Integers or floats; bytes of equal weight stand together, which compresses small counts well."""
    a = np.ascontiguousarray(values)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_numbers(data: bytes, kind: type) -> np.ndarray:
    joined = zstandard.ZstdDecompressor().decompress(data)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(joined, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)
