"""Words and shingle hashes of a batch of texts, computed on the bytes of the whole batch at once."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    # fixed values: the primes of XXH64
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows with about ``limit`` bytes each (one row at least), so buffers stay small."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
    run = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(run)) + 1 if len(run) else []
    start = 0
    for end in [*edges, len(texts)]:
        if end > start:
            yield int(start), texts.slice(start, end - start)
        start = end


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and each text's end in them; nulls are empty."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2^64, kept between batches."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        base, turned = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        base[0] = turned[0] = 1
        _POWERS[:] = [np.multiply.accumulate(base), np.multiply.accumulate(turned)]
    return _POWERS[0][:n], _POWERS[1][:n]


class Words:
    """Lower-cased words of a batch: ``buf`` holds every word and one space, ``start``/``end`` its bytes, ``doc`` its row."""

    def __init__(self, texts: pa.Array, gaps: np.ndarray = _SPACE):
        data, ends = raw(texts)
        space = gaps[data]
        # a text's end closes its last word
        opens = ~space
        opens[1:] &= space[:-1]
        inner = ends[:-1][ends[:-1] < len(data)]
        opens[inner] = ~space[inner]
        first = np.flatnonzero(opens)
        closes = np.zeros(len(data) + 1, dtype=bool)
        closes[1:][~space] = True
        closes[1:-1] &= space[1:] if len(data) else False
        closes[ends[1:]] |= np.concatenate([[False], ~space])[ends[1:]]
        closes[0] = False
        last = np.flatnonzero(closes)
        self.doc = np.searchsorted(ends, first, side="right") - 1
        length = last - first
        self.end = np.cumsum(length + 1) - 1
        self.start = self.end - length
        self.buf = np.full(int(self.end[-1]) + 1 if len(first) else 0, 32, dtype=np.uint8)
        # all bytes of words move to their new places in one go
        keep = ~space
        place = np.flatnonzero(keep) + np.repeat(self.start - first, length)
        self.buf[place] = _LOWER[data[keep]]
        self.rows = len(ends) - 1

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, by Karp-Rabin prefix sums over all bytes."""
        power, inverse = _powers(len(self.buf) + 1)
        with np.errstate(over="ignore"):
            prefix = np.zeros(len(self.buf) + 1, dtype=np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * power[:len(self.buf)], out=prefix[1:])
            return remix((prefix[self.end] - prefix[self.start]) * inverse[self.start], 1)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, start, end) of each shingle of ``size`` words; a shorter text has its whole sequence."""
        n = len(self.doc)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        counts = np.bincount(self.doc, minlength=self.rows)
        begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
        place = np.arange(n) - begins[self.doc]
        span = np.minimum(counts, size)[self.doc]
        full = np.flatnonzero(place + span <= counts[self.doc])
        return self.doc[full], self.start[full], self.end[full + span[full] - 1]


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the byte spans, all spans side by side."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    n8 = np.ndarray(len(buf) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
    n4 = np.ndarray(len(buf) + 5, dtype="<u4", buffer=padded.data, strides=(1,))
    length = (end - start).astype(np.int64)
    at, seed = start.astype(np.int64).copy(), np.uint64(seed)
    with np.errstate(over="ignore"):
        acc = np.full(len(at), seed + _P5, dtype=np.uint64)
        wide = np.flatnonzero(length >= 32)
        if len(wide):
            v = [np.full(len(wide), x, dtype=np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            rounds, where, live = length[wide] // 32, at[wide].copy(), np.arange(len(wide))
            turn = 0
            while len(live):
                for lane in range(4):
                    x = v[lane][live] + n8[where[live] + 8 * lane] * _P2
                    v[lane][live] = _rot(x, 31) * _P1
                where[live] += 32
                turn += 1
                live = live[rounds[live] > turn]
            h = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for lane in v:
                h = (h ^ (_rot(lane * _P2, 31) * _P1)) * _P1 + _P4
            acc[wide] = h
            at[wide] = where
        acc += length.astype(np.uint64)
        left = end - at
        live = np.flatnonzero(left >= 8)
        while len(live):
            k = _rot(n8[at[live]] * _P2, 31) * _P1
            acc[live] = _rot(acc[live] ^ k, 27) * _P1 + _P4
            at[live] += 8
            live = live[end[live] - at[live] >= 8]
        live = np.flatnonzero(end - at >= 4)
        if len(live):
            acc[live] = _rot(acc[live] ^ (n4[at[live]].astype(np.uint64) * _P1), 23) * _P2 + _P3
            at[live] += 4
        live = np.flatnonzero(end > at)
        while len(live):
            acc[live] = _rot(acc[live] ^ (padded[at[live]].astype(np.uint64) * _P5), 11) * _P1
            at[live] += 1
            live = live[end[live] > at[live]]
        acc ^= acc >> np.uint64(33)
        acc *= _P2
        acc ^= acc >> np.uint64(29)
        acc *= _P3
        acc ^= acc >> np.uint64(32)
    return acc


def remix(h: np.ndarray, turn: int) -> np.ndarray:
    """Another well-mixed 64-bit hash of the same key."""
    with np.errstate(over="ignore"):
        x = h + np.uint64((turn * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
