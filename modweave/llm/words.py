"""Words of whole columns of texts at once: places and 64-bit hashes, by numpy over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ASCII_LOWER, mix64

#: For each byte 1 if it belongs to a word: all but blank and the controls from tab to carriage return.
IN_WORD = bytes(0 if b == 32 or 9 <= b <= 13 else 1 for b in range(256))
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
#: What is left of eight bytes when a word ends after so many.
_FRONT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@dataclass
class Words:
    """The words of some texts: word ``k`` is ``data[start[k]:end[k]]``, text ``i`` has words ``first[i]`` to ``first[i + 1]``."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False, most: int | None = None) -> np.ndarray:
        """A hash of each word, of A-Z as a-z if ``lower``, of its first ``most`` bytes only if given.

        Eight bytes at a time go through a bijection, so two words of eight bytes at most and of one length never share
        a hash; any other two do by a chance of about 2^-64.
        """
        length = self.end - self.start
        if most is not None:
            length = np.minimum(length, most)
        data = (self.data.translate(ASCII_LOWER) if lower else self.data) + bytes(8)
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        out = mix64(eight[self.start] & _FRONT[np.minimum(length, 8)]) + length.astype(np.uint64) * _LENGTH
        left, done = np.flatnonzero(length > 8), 8
        while len(left):
            rest = length[left] - done
            out[left] = mix64(out[left] ^ (eight[self.start[left] + done] & _FRONT[np.minimum(rest, 8)]))
            left, done = left[rest > 8], done + 8
        return mix64(out)


def find_words(column: pa.Array, in_word: bytes = IN_WORD) -> Words:
    """The words of a string column; null texts have none. ``in_word`` tells by a byte's code whether it belongs to a word."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers, n = column.buffers(), len(column)
    offsets = np.zeros(n + 1, np.int64)
    if n and buffers[1] is not None:
        offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = buffers[2][offsets[0] : offsets[-1]].to_pybytes() if buffers[2] is not None and offsets[-1] > offsets[0] else b""
    offsets = offsets - offsets[0]
    word = np.frombuffer(data.translate(in_word), bool)
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    full = offsets[1:] > offsets[:-1]
    at, last = offsets[:-1][full], offsets[1:][full] - 1
    begin[at], stop[last] = word[at], word[last]
    start = np.flatnonzero(begin)
    return Words(data, start, np.flatnonzero(stop) + 1, np.searchsorted(start, offsets))


def byte_slices(column: pa.Array, most: int) -> Iterator[slice]:
    """Runs of rows of about ``most`` bytes; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    begin = 0
    while begin < len(ends):
        had = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, had + most, side="right")))
        yield slice(begin, end)
        begin = end


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, one place of each, and each key's number among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``counts`` of them, one run after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts - starts, counts)
