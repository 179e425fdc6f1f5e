"""Words of whole Arrow batches as numpy arrays: cut, lower-cased and hashed without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: A word's hash is a polynomial in this odd number, modulo 2^64, mixed at the end.
_BASE = 0x9E3779B97F4A7C15 | 1
_MIXERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
#: Bytes of texts that are cut at once, bytes of words that are hashed at once.
BYTES, BLOCK = 4 << 20, 1 << 20


def mix(x: np.ndarray, i: int) -> np.ndarray:
    """One of three bijections of 64-bit numbers that spread their bits."""
    x = (x ^ (x >> np.uint64(29))) * _MIXERS[i]
    x = (x ^ (x >> np.uint64(32))) * _MIXERS[(i + 1) % 3]
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Tables:
    size, up, down = 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if n > cls.size:
            cls.size = max(n, BLOCK + 1)
            cls.up, cls.down = _powers(_BASE, cls.size), _powers(pow(_BASE, -1, 1 << 64), cls.size)


@dataclass
class Words:
    """Words of some documents in order: document index, line number, and where the word lies in `data`."""

    doc: np.ndarray
    line: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def where(self, keep: np.ndarray) -> Words:
        return Words(self.doc[keep], self.line[keep], self.start[keep], self.end[keep], self.data)

    def hashes(self) -> np.ndarray:
        """64-bit hashes, block by block: prefix sums of the polynomial's terms give every word's value."""
        out, at = np.empty(len(self.start), np.uint64), 0
        while at < len(out):
            begin = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, begin + BLOCK, "right")))
            own = self.data[begin:self.end[to - 1]]
            _Tables.reach(len(own) + 1)
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(own * _Tables.up[:len(own)], out=sums[1:])
            s, e = self.start[at:to] - begin, self.end[at:to] - begin
            out[at:to] = mix((sums[e] - sums[s]) * _Tables.down[s] + (e - s).astype(np.uint64), 0)
            at = to
        return out


def cut(column: pa.Array) -> Iterator[Words]:
    """Words of a string column without nulls, some documents at a time; document indices count from the column's start."""
    texts = column.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + BYTES, "right")) - 1)
        yield _cut(raw[ends[first]:ends[last]], ends[first:last + 1] - ends[first], first)
        first = last


def _cut(raw: np.ndarray, ends: np.ndarray, first: int) -> Words:
    # Differences of bytes wrap around, so each range is one comparison.
    blank = (raw == 32) | (raw - np.uint8(9) < 5)
    edge = np.ones(len(raw) + 1, bool)  # before byte i: a blank or the start of a document
    edge[1:-1] = blank[:-1]
    edge[ends] = True
    start = np.flatnonzero(~blank & edge[:-1])
    after = np.ones(len(raw) + 1, bool)
    after[:-1] = blank
    after[ends] = True
    end = np.flatnonzero(~blank & after[1:]) + 1
    # Documents and line breaks are looked up among the words, as they are fewer.
    count = np.diff(np.searchsorted(start, ends))
    breaks = np.flatnonzero(raw == 10)
    after_breaks = np.repeat(np.arange(len(breaks) + 1), np.diff(np.r_[0, np.searchsorted(start, breaks), len(start)]))
    line = after_breaks - np.repeat(np.searchsorted(breaks, ends[:-1]), count)
    return Words(np.repeat(np.arange(first, first + len(count)), count), line, start, end, raw + ((raw - np.uint8(65) < 26) * np.uint8(32)))
