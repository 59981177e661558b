"""Words of Arrow text batches as numpy arrays: hashes, byte ranges, windows and shingles.

A word is a run of bytes other than space and the control characters 9 to 13. All work is vectorised over whole batches; a
batch is walked in stretches of about a megabyte, cut between words, so that memory stays a small multiple of the batch.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

STRETCH = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _byte_values() -> np.ndarray:
    return mixed((np.arange(256, dtype=np.uint64) + U(1)) * BASE) | U(1)


BYTE_VALUE = _byte_values()
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
MARKS = SPACE.copy()  # spaces and ASCII punctuation
MARKS[:128] |= ~np.array([chr(c).isalnum() for c in range(128)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), STRETCH + 4096)
            inverse = U(pow(int(BASE), -1, 1 << 64))
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, inverse)]), dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


@dataclass
class Words:
    """Words of a batch: ``hash``, byte range in ``data``, and ``first[i]:first[i + 1]`` as the words of row i."""
    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words_of(column: pa.Array, lower: bool = False, gaps: np.ndarray = SPACE) -> Words:
    """Words of each row of a text column; ``lower`` folds A-Z; ``gaps`` tells which bytes end a word."""
    data, offsets = text_bytes(column)
    if lower and len(data):
        data = LOWER[data]
    edges = np.unique(offsets)
    hashes, starts, ends = [], [], []
    at, total = 0, len(data)
    while at < total:
        stop = min(at + STRETCH, total)
        while stop < total:  # end the stretch before a space, wherever the next one is
            gap = np.flatnonzero(gaps[data[stop:stop + STRETCH]])
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(stop + STRETCH, total)
        part = data[at:stop]
        inside = ~gaps[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = edges[np.searchsorted(edges, at):np.searchsorted(edges, stop)] - at  # a row's text ends a word, too
        begins[cuts[cuts < len(part)]] = inside[cuts[cuts < len(part)]]
        s = np.flatnonzero(begins)
        lasts = inside.copy()
        lasts[:-1] &= ~inside[1:]
        before = cuts[cuts > 0] - 1
        lasts[before] = inside[before]
        e = np.flatnonzero(lasts) + 1
        up, down = _POWERS.of(len(part) + 1)
        total_to = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[part] * up[:len(part)], out=total_to[1:])
        hashes.append(mixed((total_to[e] - total_to[s]) * down[s]))
        starts.append((s + at).astype(np.int64))
        ends.append((e + at).astype(np.int64))
        at = stop
    none = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else none
    return Words(data, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), start, np.concatenate(ends) if ends else none,
                 np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; places too near the end are left out. Rows are not told apart."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    out = hashes[:size].copy()
    for k in range(1, n):
        out *= STEP
        out += hashes[k:k + size]
    return mixed(out)


def within_rows(words: Words, n: int) -> np.ndarray:
    """Places at which n words of one row begin."""
    row_end = np.repeat(words.first[1:], words.counts)
    return np.flatnonzero(np.arange(len(row_end)) + n <= row_end)


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Cut a batch so that each piece has about ``most`` bytes of text; a longer text is a piece of its own."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, min(stop, batch.num_rows) - at)
        at = stop
