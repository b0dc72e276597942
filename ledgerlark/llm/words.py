"""Words of Arrow text columns as numpy arrays, hashed in bulk.

A word is ``[^\\x20\\x09-\\x0D]+``.  These bytes never occur inside a multi-byte UTF-8
character, so words are found on the raw buffer, for a whole batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """``start``/``end``: byte positions in ``data``; ``first``: index of each text's first word, with the total at the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.start))


def split_words(texts: pa.Array) -> Words:
    """Words of a string array; null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    space = _SPACE[raw]
    before = np.concatenate([[True], space[:-1]]) if len(raw) else space.copy()
    after = np.concatenate([space[1:], [True]]) if len(raw) else space.copy()
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    before[inner] = True
    after[inner - 1] = True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    return Words(raw, start, end, np.searchsorted(start, bounds))


def word_hashes(words: Words, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes, eight bytes a step."""
    size = words.end - words.start
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))
    h = mix(size.astype(np.uint64) + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    todo = np.arange(len(size))
    at = 0
    while len(todo):
        left = np.minimum(size[todo] - at, 8)
        chunk = eight[words.start[todo] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64))
        h[todo] = mix((h[todo] ^ chunk) * _M1 + np.uint64(at + 1))
        at += 8
        todo = todo[size[todo] > at]
    return h


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive values, by doubling; the last ``n - 1`` starts are cut off."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total, done, power, span = None, 0, h, 1
    while True:
        if n & span:
            part = power[done:]
            total = part if total is None else mix(total[: len(part)] * _M1 + part)
            done += span
        span *= 2
        if span > n:
            return total[: len(h) - n + 1]
        half = span // 2
        power = mix(power[: len(power) - half] * _M1 + power[half:])


def sliding(values: np.ndarray, n: int, fold) -> np.ndarray:
    """``fold`` (np.minimum or np.maximum) over each ``n`` consecutive values."""
    if len(values) < n:
        return values[:0]
    span, got = 1, values
    while span * 2 <= n:
        got = fold(got[: len(got) - span], got[span:])
        span *= 2
    return fold(got[: len(values) - n + 1], got[n - span : n - span + len(values) - n + 1])


def pieces_of(rows: pa.RecordBatch, column: str, chars: int):
    """Slices of ``rows`` whose texts have about ``chars`` code points at most; a longer text is a slice of its own."""
    if not len(rows):
        return
    size = np.cumsum(pc.fill_null(pc.utf8_length(rows.column(column)), 0).to_numpy(zero_copy_only=False))
    cuts = np.unique([0, *np.searchsorted(size, np.arange(chars, size[-1], chars)), len(size)])
    for a, b in zip(cuts, cuts[1:]):
        yield rows.slice(a, b - a)
