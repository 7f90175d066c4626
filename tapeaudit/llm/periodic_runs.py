"""Periodic runs of words: seeds on diagonals, extended once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_arrays

#: A run repeats its period so often, and has so many words, at least.
TIMES, LEAST = 4, 6
#: Bytes of text that a task works on at once (a longer text is worked on alone).
CHUNK = 2_000_000
# Odd 64-bit multipliers of the SplitMix64 generator, fixed values.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for each pair (a, b)."""
    x = (a ^ (a >> np.uint64(30))) * _M1 + b
    return (x ^ (x >> np.uint64(27))) * _M2


def _next(names: np.ndarray, other: np.ndarray, by: int) -> np.ndarray:
    """Names of what `names` and, `by` words later, `other` cover together; the last `by` are of no use."""
    return _mixed(names, np.concatenate([other[by:], other[:by]]))


def _neighbours(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place in `at` whose name occurs again, with the next place of that name."""
    order = np.argsort(names)
    same = names[order[1:]] == names[order[:-1]]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    names, at = names[order[again]], at[order[again]]
    order = np.lexsort((at, names))
    names, at = names[order], at[order]
    same = names[1:] == names[:-1]
    return at[:-1][same], at[1:][same]


def seeds(words: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonals that may carry a run: (lag, place), by lag and place, neighbours on a diagonal merged.

    `left` is the number of words from a place to the end of its text. A run of period q matches itself, q words
    later, over at least max(LEAST, TIMES * q) - q words. For lags from 2^j below 2^(j+1) that is 5 words
    (j = 0) or 3 * 2^j, so the k-grams of this length are indexed. They are as long as the period, so inside a
    run a k-gram comes back after exactly one period: neighbouring occurrences are all the pairs that are needed.
    """
    one = _mixed(words.astype(np.uint64), np.uint64(1))
    two = _next(one, one, 1)
    four = _next(two, two, 2)
    names, half, doubled, low, longest = _next(four, one, 4), one, two, 1, int(left.max(initial=0))
    lags, places = [], []
    while longest >= max(LEAST, TIMES * low):
        k = max(LEAST - low, (TIMES - 1) * low)
        at = np.flatnonzero(left >= k)
        here, there = _neighbours(names[at], at)
        lag = there - here
        fits = (lag >= low) & (lag < 2 * low)
        lags.append(lag[fits])
        places.append(here[fits])
        low *= 2
        half, doubled = doubled, _next(doubled, doubled, low)
        names = _next(doubled, half, 2 * low)  # 2 * low and low words
    if not lags:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lag, place = np.concatenate(lags), np.concatenate(places)
    order = np.lexsort((place, lag))
    lag, place = lag[order], place[order]
    fresh = np.ones(len(lag), bool)
    fresh[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
    return lag[fresh], place[fresh]


def _matching(words: np.ndarray, i: int, lag: int, step: int) -> int:
    """How many words from place i on, in direction `step`, equal the word `lag` later."""
    n, block = 0, 32
    while True:
        if step > 0:
            a = words[i + n : min(i + n + block, len(words) - lag)]
            b = words[i + n + lag : i + n + lag + len(a)]
        else:
            low = max(i - n - block + 1, 0)
            a, b = words[low : i - n + 1][::-1], words[low + lag : i - n + 1 + lag][::-1]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return n + int(differ[0])
        n += len(a)
        if len(a) < block:
            return n
        block *= 2


def find_runs(words: np.ndarray, left: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run; texts follow one another with a word between them that occurs once."""
    found, covered = [], {}
    lag, place = seeds(words, left)
    for q, i in zip(lag.tolist(), place.tolist()):
        if i < covered.get(q, 0):
            continue
        ahead = _matching(words, i, q, 1)
        start = i - (_matching(words, i - 1, q, -1) if i else 0)
        covered[q] = i + max(ahead, 1)
        length = i + ahead - start + q
        if ahead and length >= max(LEAST, TIMES * q):
            found.append((start, length, q))
    return found


def _worked(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of each text."""
    words, offsets = word_arrays.split(texts)
    codes, known = word_arrays.numbered(words)
    n = np.diff(offsets)
    # one word of its own after each text: text t's words begin at offsets[t] + t
    owner = np.repeat(np.arange(len(n)), n)
    spread = np.arange(len(codes)) + owner
    line = np.full(len(codes) + len(n), -1, np.int64)
    line[spread] = codes
    line[offsets[1:] + np.arange(len(n))] = len(known) + np.arange(len(n))
    left = np.zeros(len(line), np.int64)
    left[spread] = offsets[owner + 1] - np.arange(len(codes))
    begin = offsets[:-1] + np.arange(len(n))
    runs: list[list] = [[] for _ in n]
    steps = np.zeros(len(line) + 1, np.int64)
    for start, length, q in sorted(find_runs(line, left), key=lambda r: (r[0], r[2])):
        t = int(np.searchsorted(begin, start, "right")) - 1
        runs[t].append({"start": start - int(begin[t]), "length": length, "period": q})
        steps[start + q] += 1
        steps[start + length] -= 1
    keep = np.cumsum(steps)[:-1][spread] == 0
    return pa.array(n, pa.int64()), pa.array(runs, RUNS), word_arrays.joined(words, offsets, keep)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, runs (array of start, length, period; by start, then period) and the
    text without the repeats.

    Words are runs of anything but ASCII white space. A run is a stretch of words with smallest period q and at
    least max(6, 4 * q) words that cannot be made longer on either side. The first period of a run stays; a word is
    left out when some run contains it after that run's first period. What stays is joined by one space.

    Seeds are neighbouring occurrences of k-grams in one text, by classes of lag; each seed is extended along its
    diagonal by comparing words, unless an extension on that diagonal got that far before. So the work of a text
    of n words is n log n, whatever it repeats. K-grams are compared by 64-bit names; a run that is returned was
    compared word by word.

    Texts are worked on where they are read: no shuffle, and a lost task is computed again. A null or empty
    text, or white space alone, has no words, no runs and the text "". Rows that repeat an id are rows of their own.
    No rows in, no rows out. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_words", "runs", "text"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for part in parts:
            texts = part.column(1)
            for start, stop in word_arrays.slices(texts, CHUNK):
                worked = _worked(texts.slice(start, stop - start))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(start, stop - start), *worked], names)

    schema = f"`{id_col}` {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
