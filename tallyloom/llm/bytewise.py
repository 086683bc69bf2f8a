"""Vectorized work on the bytes of many texts at once: words, hashes of spans, packed columns."""

from __future__ import annotations

import numpy as np
import zstandard

U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20_17).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_powers: dict[int, np.ndarray] = {}
#: Bytes of text that are worked on at once, to bound a worker's memory.
CHUNK = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, n of them at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        n = max(n, CHUNK + 4096)
        have = np.full(n, base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n > CHUNK + 4096:  # one very long text: don't keep its table
            return have
        _powers[base] = have
    return have


def prefix_hash(a: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i], times the step's inverse power i, a polynomial hash of a[i:j]."""
    p = np.zeros(len(a) + 1, U)
    np.cumsum(_BYTE[a] * powers(_STEP, len(a))[: len(a)], out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = (p[end] - p[start]) * powers(_BACK, len(p))[start]
    return mixed(h + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, text index) of the words of all texts."""
    a = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = SPACES[a]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[0::2], edge[1::2]
    first = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=first[1:])
    return a, start, end, np.searchsorted(first, start, "right") - 1


def chunks(texts: list[bytes], size: int = CHUNK):
    """(first, last) index ranges of texts of about size bytes together; a longer text stands alone."""
    first = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield first, i
            first, total = i, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def slices(column, size: int = CHUNK):
    """(first, last) row ranges of a string column of about size bytes together; a longer text stands alone."""
    import pyarrow.compute as pc

    length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) + 1
    total, first = np.concatenate(([0], np.cumsum(length))), 0
    while first < len(length):
        last = max(first + 1, int(np.searchsorted(total, total[first] + size, "right")) - 1)
        yield first, last
        first = last


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null gives an empty text."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


_z: dict[int, zstandard.ZstdCompressor] = {}


def packed(*columns: np.ndarray, level: int = 1) -> bytes:
    """Columns of numbers as one compressed blob."""
    if level not in _z:
        _z[level] = zstandard.ZstdCompressor(level=level)
    head = np.array([len(columns), *(x for c in columns for x in (ord(c.dtype.char), len(c)))], "<i8")
    return _z[level].compress(b"".join([head.tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)]))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8), 8 + 16 * n, []
    for k in range(n):
        kind, size = np.dtype(chr(head[2 * k])), int(head[2 * k + 1])
        out.append(np.frombuffer(raw, kind, size, at))
        at += kind.itemsize * size
    return out


def by_bucket(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, columns of its rows) of every bucket that has rows; keeps the order within a bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    edges = np.flatnonzero(np.diff(b, prepend=-1))
    cut = [c[order] for c in columns]
    for s, e in zip(edges, [*edges[1:], len(b)], strict=True):
        yield int(b[s]), [c[s:e] for c in cut]
