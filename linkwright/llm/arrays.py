"""Array helpers shared by the operators: Arrow text to bytes, words to hashes, packed columns.

Everything here works on bounded slices of a batch, so a worker's memory does not depend on
the number of rows in its partition.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext

U64 = np.uint64
SLICE_BYTES = 2 << 20


def _lean_worker() -> None:
    """In a Python worker: freed arrays and Arrow buffers of over 8 MB go back to the system at once, so that an idle worker is small."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):  # another C library than glibc
        return
    mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
    mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


if TaskContext.get() is not None:
    _lean_worker()
_MUL = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; every output bit depends on every input bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


BYTE_CODES = mix((np.arange(256, dtype=U64) + U64(1)) * _MUL)
_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 1 << 64)
#: Powers of the base are kept up to this many; longer inputs take them as products of two tables.
_POWERS = 1 << 18
_powers: dict[int, np.ndarray] = {}


def _table(base: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None:
        have, done = np.ones(_POWERS, U64), 1
        while done < _POWERS:
            have[done : 2 * done] = have[:done] * U64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have
    return have


def powers_at(exponent: np.ndarray, base: int = _BASE) -> np.ndarray:
    """base**exponent modulo 2**64, from tables of a fixed size."""
    exponent = np.asarray(exponent, U64)
    out = _table(base)[(exponent & U64(_POWERS - 1)).astype(np.int64)]
    high = exponent >> U64(_POWERS.bit_length() - 1)
    step = _POWERS
    while len(high) and high.max():
        out *= _table(pow(base, step, 1 << 64))[(high & U64(_POWERS - 1)).astype(np.int64)]
        high, step = high >> U64(_POWERS.bit_length() - 1), step * _POWERS
    return out


def prefix_codes(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hashes() takes the hash of any byte range; made in pieces of a fixed size."""
    out = np.zeros(len(data) + 1, U64)
    powers = _table(_BASE)
    for a in range(0, len(data), _POWERS):
        piece = data[a : a + _POWERS]
        code = BYTE_CODES[piece] * powers[: len(piece)]
        if a:
            code *= U64(pow(_BASE, a, 1 << 64))
        np.cumsum(code, out=code)
        np.add(code, out[a], out=out[a + 1 : a + 1 + len(piece)])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers_at(start, _UNBASE) + (end - start).astype(U64) * _MUL)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and offsets; NULL is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of at most limit bytes each; a longer text has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and where each row's words begin."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words after lower-casing A-Z, and where each row's words begin."""
    data = lower_ascii(data)
    starts, ends, rows = word_spans(data, offsets)
    return span_hashes(prefix_codes(data), starts, ends), rows


def ngrams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive word hashes (those over a row's end are to be left out)."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for k in range(n):
        out += codes[k : k + m] * U64(pow(_BASE, k + 1, 1 << 64))
    return mix(out)


def shingle_sets(codes: np.ndarray, rows: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Each row's sorted distinct n-word shingles; with fewer words, the whole sequence as one."""
    every, out = ngrams(codes, n), []
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(every[a : b - n + 1]))
        elif b > a:
            out.append(ngrams(codes[a:b], b - a) ^ U64(b - a))
        else:
            out.append(np.zeros(0, U64))
    return out


def pack(*columns: np.ndarray, level: int = 1) -> bytes:
    """Columns of one length as compressed byte planes; equal dtypes are needed to unpack()."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(planes))


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    sizes = [np.dtype(t).itemsize for t in dtypes]
    n, out, at = len(raw) // sum(sizes), [], 0
    for t, s in zip(dtypes, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * s].reshape(s, n).T).reshape(-1).view(t))
        at += n * s
    return out


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def group_bounds(sorted_keys: np.ndarray):
    """First and last place of each run of equal keys."""
    head = group_starts(sorted_keys)
    return zip(head.tolist(), np.append(head, len(sorted_keys))[1:].tolist(), strict=True) if len(head) else ()


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + c) for each start and count."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(at - starts, counts)
