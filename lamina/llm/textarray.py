"""Vectorised text primitives: a batch of texts as one array, with runs found and hashed without a loop over words."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SLICE = 1 << 19
#: The code points of Unicode's White_Space property, as first and last of each range.
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
LETTER, NUMBER, SPACE, OTHER = 1, 2, 0, 3


@cache
def _libc():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Gives freed memory back to the system; workers wait idle between tasks, and several share a machine."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None and hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def lean(work):
    """``work``, a function of a table or of batches, that releases what it has freed when it ends."""

    @wraps(work)
    def done(data):
        result = work(data)
        if isinstance(result, pa.Table):
            release()
            return result

        def batches():
            yield from result
            release()

        return batches()

    return done


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); equal inputs give equal outputs everywhere."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _symbol_values() -> np.ndarray:
    return mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n and those of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, _SLICE + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = []
        for base in (_BASE, inverse):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _POWERS.append(out)
    return _POWERS[0], _POWERS[1]


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial hash; entry i covers the symbols before i."""
    if symbols.dtype == np.uint8:
        values = _symbol_values()[symbols]
    else:
        wide = symbols.astype(np.uint64)
        values = np.where(wide < 1 << 16, _symbol_values()[symbols & 0xFFFF], mix(wide))
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(values * powers(len(symbols))[0][: len(symbols)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, the same for the same symbols wherever they stand."""
    raw = (prefix[ends] - prefix[starts]) * powers(len(prefix) - 1)[1][starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SHORT = 64


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: longer ones, among which polynomials modulo a power of two have known collisions, by BLAKE2b."""
    out = span_hash(prefix_hash(data), starts, ends)
    for i in np.flatnonzero(ends - starts > _SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def equal_spans(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each i, whether ``x[a[i] : a[i] + n[i]]`` equals ``y[b[i] : b[i] + n[i]]``: short ones symbol by symbol over all of them at once."""
    out = np.ones(len(n), bool)
    for i in np.flatnonzero(n > _SHORT):
        out[i] = np.array_equal(x[a[i] : a[i] + n[i]], y[b[i] : b[i] + n[i]])
    short = np.flatnonzero(n <= _SHORT)
    short = short[np.argsort(-n[short].astype(np.int8), kind="stable")]
    at, to, off = a[short], b[short], np.zeros(len(short), bool)
    reach = np.searchsorted(-n[short], -np.arange(1, _SHORT + 1), "right")
    for k, m in enumerate(reach[reach > 0].tolist()):
        off[:m] |= x[at[:m] + k] != y[to[:m] + k]
    out[short[off]] = False
    return out


def distinct(symbols: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct spans: where one of each is in ``first``, for every span which one it is, and the hashes of the distinct ones.

    Hashes only bring equal spans together; each is then compared with the one it would be, and those that merely agree with it in their
    hash become distinct spans of their own, after the others.
    """
    running = prefix_hash(symbols)
    hashes, at, inverse = np.unique(span_hash(running, first, end), return_index=True, return_inverse=True)
    one = at[inverse]
    other = np.flatnonzero(one != np.arange(len(first)))
    one, n = one[other], (end - first)[other]
    same = n == (end - first)[one]
    same[same] = equal_spans(symbols, first[other][same], symbols, first[one][same], n[same])
    if not same.all():
        odd: dict[bytes, int] = {}
        more: list[int] = []
        for i in other[~same].tolist():
            spelled = symbols[first[i] : end[i]].tobytes()
            if spelled not in odd:
                odd[spelled] = len(at) + len(more)
                more.append(i)
            inverse[i] = odd[spelled]
        hashes = np.append(hashes, span_hash(running, first[more], end[more]))
        at = np.append(at, more)
    return at, inverse, hashes


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and its n + 1 offsets into them, nulls as empty; no copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    buffers = column.buffers()
    if not n or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, most: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive rows whose bytes sum to about ``most``; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def byte_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and 09 to 0D."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words_by_row(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and the n + 1 bounds of each row's words; a word never crosses two rows."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    word = ~space
    start = word.copy()
    start[1:] &= space[:-1]
    end = np.zeros(len(data) + 1, bool)
    end[1:] = word
    end[1:-1] &= space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner[word[inner]]] = True
    end[inner[word[inner - 1]]] = True
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, offsets)


@cache
def classes() -> np.ndarray:
    """For every code point: letter, number, white space or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            out[code] = LETTER
        elif kind == "N":
            out[code] = NUMBER
    for first, last in WHITE_SPACE:
        out[first : last + 1] = SPACE
    return out


def code_points(texts: list[str], separator: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts, each followed by ``separator``, as code points; and where each begins, with the total at the end."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(separator) for t in texts], out=starts[1:])
    joined = separator.join(texts) + separator if texts else ""
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts
