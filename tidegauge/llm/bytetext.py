"""Vectorised word splitting and fingerprinting over Arrow string buffers.

Texts stay UTF-8 bytes: every delimiter used here is ASCII, so byte positions split code points never.
A word's fingerprint is a polynomial over random 64-bit byte codes modulo 2**64, finalised with a mixer;
the temporaries are bounded by the span constant, not by the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPAN = 1 << 20
_BLOCK = 2 << 20
_U = np.uint64


def _byte_codes(seed: int) -> np.ndarray:
    codes = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
    codes[65:91] = codes[97:123]  # A-Z count as a-z
    return codes


_CODES = _byte_codes(20_240_501)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, _U(base & (2**64 - 1)))
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def byte_class(delimiters: bytes) -> np.ndarray:
    """A table of 256 booleans: True where the byte belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[list(delimiters)] = False
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds), in place on a copy."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(29)
    return h


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of len+1) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type == pa.null():
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def blocks(offsets: np.ndarray, most: int = _BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(buf: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per text the number of the first word (len+1). A word never crosses texts."""
    n = len(buf)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = word_bytes[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word with A-Z lower-cased."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + _SPAN, "right")))
        part = buf[at : ends[j - 1]]
        up, down = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODES[part] * up[: len(part)], out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        h = (total[e] - total[s]) * down[s]
        out[i:j] = mix(h + (e - s).astype(np.uint64) * _U(0xA0761D6478BD642F))
        i = j
    return out


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all runs of ``width`` consecutive words, across the whole array."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h *= _U(0x9FB21C651E98DF25)
        h += words[j : j + n]
    return mix(h + _U(width))


def shingle_sets(column: pa.Array, word_bytes: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct fingerprints of its ``width``-word shingles.

    A text of fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    buf, offsets = text_buffer(column)
    for lo, hi in blocks(offsets):
        part, own = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = word_spans(part, own, word_bytes)
        words = word_hashes(part, starts, ends)
        runs = rolling(words, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            elif b > a:
                yield rolling(words[a:b], b - a)
            else:
                yield runs[:0]
