"""Words and lines of many texts as Arrow arrays, and exact numbers for equal ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import word_bounds


def binaries(body: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Byte strings of these sizes, laid one after the other in body."""
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])


def words_of(body: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words [^\\x20\\x09-\\x0D]+ of all texts in order, and the first word of each text (rows + 1)."""
    starts, ends, of = word_bounds(body, offsets)
    return binaries(body[~((body == 32) | ((body >= 9) & (body <= 13)))], ends - starts), of


def numbers(values: pa.Array) -> np.ndarray:
    """A number for each value; equal values, and no others, have equal numbers."""
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def owners(of: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(of) - 1), np.diff(of))


def recurring(keys: np.ndarray, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows at rising positions: those whose key recurs in their text, those with an earlier one of their key there, and the nearest
    such. owner: a number of its text for each position."""
    order = np.argsort(keys)
    equal = keys[order[1:]] == keys[order[:-1]]
    some = np.zeros(len(order), bool)
    some[1:] |= equal
    some[:-1] |= equal
    few = order[some]
    few = few[np.lexsort((at[few], keys[few]))]
    again = np.flatnonzero((keys[few[1:]] == keys[few[:-1]]) & (owner[at[few[1:]]] == owner[at[few[:-1]]])) + 1
    now, before = at[few[again]], at[few[again - 1]]
    place = np.argsort(now)
    return np.union1d(now, before), now[place], before[place]


def covered(at: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of `size` positions the windows of this length at these positions cover."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0
