"""Vectorised text primitives over Arrow string buffers.

Texts stay in their UTF-8 buffers: words are found, lower-cased and hashed with
numpy for a whole slice of documents at once, never one Python object a word. Slices
are cut by bytes, not rows, so working memory is bounded whatever the row sizes;
a text longer than a slice is a slice of its own and is processed whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_M = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x5851F42D4C957F2D)  # odd, so it has an inverse modulo 2**64

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x + _M
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``limit`` bytes. A null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offs = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def lowered(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in lower case, byte lengths unchanged."""
    out = LOWER[buf]
    if len(buf) > 1:
        latin = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][latin] += 32
    return out


def plain_apostrophes(buf: np.ndarray) -> np.ndarray:
    """Typographic apostrophes (U+2018, U+2019, U+02BC) as runs of ASCII ones, byte lengths unchanged."""
    out = buf.copy()
    for tail in ((0xE2, 0x80, 0x98), (0xE2, 0x80, 0x99), (0xCA, 0xBC)):
        n = len(buf) - len(tail) + 1
        if n > 0:
            at = np.flatnonzero(buf[:n] == tail[0])
            for j, byte in enumerate(tail):
                at = at[buf[at + j] == byte]
            for j in range(len(tail)):
                out[at + j] = 39
    return out


def spans(buf: np.ndarray, offs: np.ndarray, member: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes in ``member`` that don't cross rows."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = member[buf]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offs, starts, "right") - 1


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("p", _BASE), ("i", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x)
    return _powers["p"], _powers["i"]


def hasher(buf: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Gives 64-bit hashes of byte spans (starts, ends) of a slice, from one polynomial prefix sum over it."""
    p, inverse = _power(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=prefix[1:])
    return lambda starts, ends: mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hasher(buf)(starts, ends)


def word_hashes(buf: np.ndarray, offs: np.ndarray, member: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a slice and their row numbers."""
    starts, ends, rows = spans(buf, offs, member)
    return span_hashes(lowered(buf), starts, ends), rows


def hash_text(word: str) -> int:
    """The hash that :func:`word_hashes` gives for one word."""
    b = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(lowered(b), np.array([0]), np.array([len(b)]))[0])


def row_sums(rows: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    """Sums (or counts) by row number."""
    return np.bincount(rows, values, n)[:n]
