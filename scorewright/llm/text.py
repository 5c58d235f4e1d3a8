"""Words and word n-grams of Arrow text columns as flat numpy arrays.

A word is a maximal run of bytes other than space and the five control characters 09-0D; A-Z count as a-z. Work
proceeds over pieces of half a megabyte of whole texts, so memory doesn't grow with the batch, and what a reused worker
keeps between tasks doesn't grow with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are neither letters, digits nor part of a longer character
NOT_LETTERS = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Piece:
    """Some whole texts: rows lo to hi of the batch, their bytes and the offsets of each."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


@dataclass
class Words:
    """Words of a piece: byte spans, the row of each (counted from the piece), a hash of each."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of the first word of each row, and one past the last row's


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a column into runs of whole texts of about ``most`` bytes; a longer text is a run of its own."""
    raw, offsets = text_arrays(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield Piece(lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KEPT_POWERS = PIECE_BYTES + 1
_POWERS: list[np.ndarray] = []


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    table = np.full(n, base, np.uint64)
    table[0] = 1
    return np.cumprod(table, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2**64. Those of a piece are kept, those of a longer text aren't."""
    if n > _KEPT_POWERS:
        return _power_table(_BASE, n), _power_table(_BASE_INV, n)
    if not _POWERS:
        _POWERS.extend(_power_table(base, _KEPT_POWERS) for base in (_BASE, _BASE_INV))
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of the bytes; differences give hashes of any span."""
    power, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span from :func:`prefix_sums`."""
    _, inverse = powers(len(sums))
    return mix(((sums[end] - sums[start]) * inverse[start]) ^ (np.asarray(end - start).astype(np.uint64) << np.uint64(48)))


def word_spans(piece: Piece, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of all words of a piece, and the index of each row's first word and one past the last row's."""
    data = piece.data
    inside = ~separator[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    at = piece.offsets[:-1]
    at = at[at < len(data)]
    opens[at] |= inside[at]
    before = at[at > 0] - 1
    closes[before] |= inside[before]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, piece.offsets)


def words(piece: Piece, separator: np.ndarray = _SEPARATOR) -> Words:
    """All words of a piece, between bytes that ``separator`` marks."""
    start, end, first = word_spans(piece, separator)
    row = np.repeat(np.arange(piece.hi - piece.lo), np.diff(first))
    sums = prefix_sums(_LOWER[piece.data])
    return Words(start, end, row, span_hash(sums, start, end), first)


def ngram_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``n`` words within a row; a shorter row with words gives its whole sequence."""
    count = np.diff(w.first)
    if len(w.hash) >= n:
        value = np.full(len(w.hash) - n + 1, np.uint64(n))
        for k in range(n):
            value = mix(value ^ w.hash[k : len(w.hash) - n + 1 + k]) + np.uint64(0x9E3779B97F4A7C15)
        keep = w.row[: len(value)] == w.row[n - 1 :]
        value, row = value[keep], w.row[: len(keep)][keep]
    else:
        value, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k, r in enumerate(short):
            x = np.full(1, np.uint64(count[r]))
            for h in w.hash[w.first[r] : w.first[r + 1]]:
                x = mix(x ^ h) + np.uint64(0x9E3779B97F4A7C15)
            extra[k] = x[0]
        value, row = np.concatenate([value, extra]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        value, row = value[order], row[order]
    return value, row


def distinct(value: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; by sorting, which is faster here than by hashing."""
    value = np.sort(value)
    return value[np.r_[True, value[1:] != value[:-1]]] if len(value) else value


def row_sets(value: np.ndarray, row: np.ndarray, n_rows: int) -> list[np.ndarray]:
    """The distinct values of each row, sorted. ``row`` ascends."""
    cut = np.searchsorted(row, np.arange(n_rows + 1))
    return [distinct(value[cut[i] : cut[i + 1]]) for i in range(n_rows)]
