"""Words of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def spans(data: np.ndarray, at: np.ndarray, other: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words of texts data[at[i]:at[i+1]]; the words of
    text i are first[i] to first[i+1]. ``other`` marks the bytes that no word holds."""
    inside = ~other[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(data))]
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray = _SPACE) -> tuple[np.ndarray, list[bytes]]:
    """(index of each word among the distinct ones, the distinct words); words as from spans()."""
    if not len(starts):
        return np.zeros(0, np.int32), []
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    own = data[~other[data]]
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(own)])
    found = column.dictionary_encode()
    return np.asarray(found.indices), found.dictionary.to_pylist()


def hashes(words: list[bytes]) -> np.ndarray:
    of = xxhash.xxh3_64_intdigest
    return np.fromiter(map(of, words), np.uint64, len(words))
