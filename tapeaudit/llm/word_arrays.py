"""Words of whole texts as Arrow arrays: runs of anything but the six ASCII white space characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text each; a longer text has a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, before = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start, before = stop, int(ends[stop - 1])


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, one after the other, and where each text's words begin (one more offset ends
    the last); a null text has none."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = parts.offsets.to_numpy().astype(np.int64)
    pieces = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    real = pc.greater(pc.binary_length(pieces), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return pieces.filter(real), before[offsets - offsets[0]]


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words as numbers, equal for equal words, and the word of each number."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def joined(words: pa.Array, offsets: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    before = np.concatenate([[0], np.cumsum(keep)])[offsets]
    lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), words.filter(pa.array(keep, pa.bool_())))
    return pc.binary_join(lists, " ")


def per_text(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each text's words are marked."""
    return np.diff(np.concatenate([[0], np.cumsum(marked)])[offsets])
