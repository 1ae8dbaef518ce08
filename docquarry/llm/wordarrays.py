"""Words of many texts at once, as arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of ASCII white space.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text begins (one position more than texts). No nulls."""
    array = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    array = array.cast(pa.large_string())
    at = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8)[at[0] : at[-1]] if len(array) and array.buffers()[2] else np.zeros(0, np.uint8)
    return data, at - at[0]


def binary_array(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def word_buckets(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each byte string (large_binary, none empty), by a polynomial of its bytes."""
    w = pa.concat_arrays([words])
    at = np.frombuffer(w.buffers()[1], np.int64)[w.offset : w.offset + len(w) + 1] if len(w) else np.zeros(1, np.int64)
    if len(at) == 1:
        return np.zeros(0, np.int64)
    data = np.frombuffer(w.buffers()[2], np.uint8)[at[0] : at[-1]]
    sizes, first = np.diff(at), at[:-1] - at[0]
    powers = np.cumprod(np.full(int(sizes.max()), _BASE, np.uint64), dtype=np.uint64)
    mixed = _mixed(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(first, sizes)], first))
    return (mixed % np.uint64(buckets)).astype(np.int64)


@dataclass
class Words:
    """The words of some documents, one after the other."""

    data: np.ndarray  #: their bytes without white space
    at: np.ndarray  #: where each word begins in data; one position more than words
    docs: np.ndarray  #: where each document's words begin; one position more than documents

    @classmethod
    def of(cls, texts: pa.ChunkedArray | pa.Array, lower: bool = False) -> Words:
        data, at = text_bytes(texts)
        inside = ~_SPACE[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[at[:-1][at[:-1] < len(data)]] = False  # words end with their document
        starts = np.flatnonzero(inside & ~before)
        kept = data[inside]
        begins = (np.cumsum(inside) - 1)[starts] if len(starts) else np.zeros(0, np.int64)
        return cls(_LOWER[kept] if lower else kept, np.append(begins, len(kept)).astype(np.int64), np.searchsorted(starts, at).astype(np.int64))

    def __len__(self) -> int:
        return len(self.at) - 1

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """For each word the number of its distinct word, and the distinct words."""
        encoded = binary_array(self.data, self.at).dictionary_encode()
        return encoded.indices.to_numpy(), encoded.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; every distinct word is hashed once."""
        codes, distinct = self.codes()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))[codes]


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``width`` words, sum of word * base^(width - 1 - place) mod 2^64.

    Windows of doubled width come from two of half the width; the binary digits of ``width`` say which to join.
    """
    if len(words) < width:
        return np.zeros(0, np.uint64)
    total, done, power, size = None, 0, words, 1
    while True:
        if width & size:
            if total is None:
                total = power
            else:  # the window so far, followed by `size` more words
                n = len(words) - done - size + 1
                total = total[:n] * _BASE ** np.uint64(size) + power[done : done + n]
            done += size
        if size * 2 > width:
            return _mixed(total)
        power = power[: len(power) - size] * _BASE ** np.uint64(size) + power[size:]
        size *= 2


def inside_documents(docs: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` window starts have their whole window in one document."""
    ok = np.zeros(max(0, n), bool)
    if n > 0:
        mark = np.zeros(n + 1, np.int64)
        a, b = docs[:-1], docs[1:] - width + 1
        some = b > a
        np.add.at(mark, a[some], 1)
        np.add.at(mark, b[some], -1)
        ok = np.cumsum(mark[:-1]) > 0
    return ok
