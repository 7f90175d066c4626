"""Substring dedup: words of windows that occurred before are removed."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_arrays

#: Words of a window.
WINDOW = 20
#: Bytes of text in a chunk: a thousandth of the corpus, within these limits (a longer text has a chunk of its own).
CHUNK_MIN, CHUNK_MAX = 4_000_000, 32_000_000
#: Sampled keys per chunk, from which the borders of chunks are taken.
KEYS = 16
# Odd bases of the two polynomials, fixed values (multipliers of the xxHash family).
BASES = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)

INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def rolling(words: np.ndarray, base: np.uint64, size: int) -> np.ndarray:
    """Rabin-Karp hashes sum(words[i + j] * base^(size - 1 - j)) mod 2^64 of all runs of `size` words, put together
    from runs of 1, 2, 4, ... words."""
    out, n, power = np.zeros(len(words), np.uint64), 0, np.uint64(1)  # of `n` words, base^n
    block, wide, factor = words, 1, base  # of `wide` words, base^wide
    with np.errstate(over="ignore"):
        while True:
            if size & wide:
                ahead = np.zeros(len(words), np.uint64)
                ahead[: max(len(words) - n, 0)] = block[n:]
                out = out * factor + ahead if n else block.copy()
                n, power = n + wide, power * factor
            if n == size:
                return out[: max(len(words) - size + 1, 0)]
            ahead = np.zeros(len(words), np.uint64)
            ahead[: max(len(words) - wide, 0)] = block[wide:]
            block, wide, factor = block * factor + ahead, wide * 2, factor * factor


class Chunk:
    """The documents of a chunk in corpus order, and the hashes of their windows."""

    def __init__(self, table: pa.Table, size: int):
        kept = table.group_by(["id", "fp", "text"], use_threads=False).aggregate([("copies", "sum")])
        order = pc.sort_indices(kept, sort_keys=[("id", "ascending"), ("fp", "ascending"), ("text", "ascending")], null_placement="at_end")
        self.docs = kept.take(order)
        self.words, self.offsets = word_arrays.split(self.docs["text"].combine_chunks() if len(self.docs) else pa.array([], pa.string()))
        codes, known = word_arrays.numbered(self.words)
        digests = [xxhash.xxh3_128_intdigest(w) for w in known.to_pylist()]
        low = np.array([d & (2**64 - 1) for d in digests], np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
        high = np.array([d >> 64 for d in digests], np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
        # windows lie within one document
        ends = np.repeat(self.offsets[1:], np.diff(self.offsets))
        self.starts = np.flatnonzero(ends - np.arange(len(codes)) >= size)
        hi = rolling(low, BASES[0], size)[self.starts]
        lo = (rolling(high, BASES[1], size)[self.starts] >> np.uint64(48)).astype(np.uint16)
        self._number(hi, lo)

    def _number(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """The different hashes in order (hi, lo), which of them each window has, and the first window of each."""
        order = np.argsort(hi)
        a, b = hi[order], lo[order]
        same = a[1:] == a[:-1]
        if (same & (b[1:] != b[:-1])).any():
            order = np.lexsort((lo, hi))
            a, b = hi[order], lo[order]
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        new = np.concatenate([np.ones(min(len(a), 1), bool), ~same])
        self.hi, self.lo = a[new], b[new]
        self.number = np.empty(len(a), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.first = np.minimum.reduceat(order, np.flatnonzero(new)) if len(a) else order

    def buckets(self, bits: int) -> np.ndarray:
        """Where the hashes of each of 2^bits buckets begin and end."""
        tops = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
        return np.concatenate([[0], np.searchsorted(self.hi, tops), [len(self.hi)]])

    def result(self, earlier: np.ndarray, size: int) -> pa.Table:
        """What is left when the windows go whose hash (one flag per hash) occurs in an earlier chunk, or before in
        this one."""
        gone = self.starts[earlier[self.number] | (self.first[self.number] != np.arange(len(self.starts)))]
        steps = np.zeros(len(self.words) + 1, np.int64)
        steps[gone] += 1
        steps[gone + size] -= 1
        removed = np.cumsum(steps)[:-1] > 0
        edge = np.zeros(len(removed) + 1, bool)
        edge[self.offsets] = True  # a document begins, or the last one ends
        begins = removed & (edge[:-1] | ~np.concatenate([[False], removed[:-1]]))
        ends = removed & (edge[1:] | ~np.concatenate([removed[1:], [False]]))
        home = np.repeat(self.offsets[:-1], np.diff(self.offsets))
        spans = pa.StructArray.from_arrays(
            [pa.array((np.flatnonzero(begins) - home[begins]).astype(np.int64)), pa.array((np.flatnonzero(ends) + 1 - home[ends]).astype(np.int64))], ["start", "end"]
        )
        before = np.concatenate([[0], np.cumsum(begins)])[self.offsets]
        return pa.table({
            "id": self.docs["id"], "copies": self.docs["copies_sum"], "n_words": pa.array(np.diff(self.offsets), pa.int64()),
            "n_removed": pa.array(word_arrays.per_text(removed, self.offsets), pa.int64()),
            "removed": pa.ListArray.from_arrays(pa.array(before, pa.int32()), spans), "text": word_arrays.joined(self.words, self.offsets, ~removed),
        })


def packed(hi: np.ndarray, lo: np.ndarray) -> bytes:
    """Sorted hashes as gaps of as many bytes as the largest needs, then their second parts."""
    gaps = np.diff(hi, prepend=np.uint64(0))
    wide = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([wide]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes() + lo.astype("<u2").tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = blob[0]
    n = (len(blob) - 1) // (wide + 2)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :wide] = np.frombuffer(blob, np.uint8, n * wide, 1).reshape(n, wide)
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64), np.frombuffer(blob, "<u2", n, 1 + n * wide)


def _hashes(size: int, bits: int) -> Callable[[pa.Table], pa.Table]:
    """A chunk's different window hashes, a row per bucket."""

    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, size)
        at = chunk.buckets(bits)
        used = np.flatnonzero(np.diff(at))
        base = used.astype(np.uint64) << np.uint64(64 - bits) if bits else np.zeros(len(used), np.uint64)
        blobs = [packed(chunk.hi[at[b] : at[b + 1]] - z, chunk.lo[at[b] : at[b + 1]]) for b, z in zip(used.tolist(), base)]
        return pa.table({"bucket": pa.array(used, pa.int64()), "chunk": pa.array([table["chunk"][0].as_py()] * len(used), pa.int64()), "hashes": pa.array(blobs, pa.binary())})

    return run


def _earlier(table: pa.Table) -> pa.Table:
    """For each hash of each chunk in a bucket, one bit: does it occur in an earlier chunk?"""
    table = table.sort_by("chunk")
    blobs = [unpacked(b) for b in table["hashes"].to_pylist()]
    sizes = [len(h) for h, _ in blobs]
    hi, lo = np.concatenate([h for h, _ in blobs]), np.concatenate([x for _, x in blobs])
    order = np.lexsort((np.arange(len(hi)), lo, hi))
    same = (hi[order[1:]] == hi[order[:-1]]) & (lo[order[1:]] == lo[order[:-1]])
    flags = np.zeros(len(hi), bool)
    flags[order[1:]] = same
    bits = [np.packbits(f).tobytes() for f in np.split(flags, np.cumsum(sizes)[:-1])]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "earlier": pa.array(bits, pa.binary())})


def _results(size: int, bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, flags: pa.Table) -> pa.Table:
        chunk = Chunk(table, size)
        at = chunk.buckets(bits)
        earlier = np.zeros(len(chunk.hi), bool)
        for b, said in zip(flags["bucket"].to_pylist(), flags["earlier"].to_pylist()):
            earlier[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(said, np.uint8), count=int(at[b + 1] - at[b]))
        return chunk.result(earlier, size)

    return run


def _place(i, fp: int) -> tuple:
    return i is None, 0 if i is None else i, fp


def _borders(rows: DataFrame, chunks: int, n: int) -> list[tuple]:
    """Keys (id, hash of the text) that part the corpus into about `chunks` pieces of equal size: quantiles, by size, of
    the keys whose hash falls into a share of all. They decide who works on what, never what comes out."""
    share = max(1, n // (KEYS * chunks))
    some = rows.filter(F.pmod(F.xxhash64("id", "fp"), F.lit(share)) == 0).groupBy("id", "fp").agg(F.max(F.octet_length("text")).alias("size"))
    keys = sorted((_place(r.id, r.fp), r.size + 1) for r in some.collect())
    ends = np.cumsum([s for _, s in keys])
    wanted = np.searchsorted(ends, ends[-1] * np.arange(1, chunks) / chunks) if len(keys) else []
    return sorted({keys[k][0] for k in wanted})


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, chunk_bytes: int | None = None) -> DataFrame:
    """One row per document: id, n_words, n_removed, removed (array of start, end: the maximal intervals of words that
    go) and the text without them, its words joined by one space.

    A window is `size` consecutive words (runs of anything but ASCII white space, unchanged) of one document. A
    word goes when a window covers it whose words also start earlier: in a document before, or at a smaller start in
    the same one. Windows are judged on the input.

    Documents are parted into chunks that follow one another in corpus order. A chunk hashes every window (two
    Rabin-Karp polynomials, 80 bits) and sends each different hash once to the hash's bucket, sorted and packed. A bucket
    answers each chunk with one bit per hash: does an earlier chunk have it? The chunk marks the windows and merges
    them. So texts are shuffled once (both uses of them read the same shuffle), and 8 bytes per window; a passage that
    every document has costs a chunk one hash, whatever the number of its copies. A chunk holds a thousandth of the
    corpus within CHUNK_MIN and CHUNK_MAX bytes (or `chunk_bytes`), and there are about as many buckets. The
    driver holds one border per chunk and collects KEYS sampled keys per chunk.

    Two different windows are taken for equal when all 80 bits agree: with n windows n^2 / 2^81 are expected in all.

    Rows come in order of id, those without one last; rows that share an id, or have none, in the order of
    their texts' hashes. Of rows that repeat an id and a text the later copies lose every window. A null text has
    no words. Texts of fewer than `size` words stay. Ids are of any one type that can be ordered. No rows in,
    no rows out. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", F.xxhash64("text").alias("fp"), "text")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    total = whole.size or 0
    chunks = ceil((total + 1) / (chunk_bytes or min(CHUNK_MAX, max(CHUNK_MIN, total // 1000))))
    borders = _borders(rows, chunks, whole.n) if chunks > 1 else []
    bits = max(len(borders), 0).bit_length()

    def dealt(parts: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for part in parts:
            # rows that are repeated here travel once
            some = pa.Table.from_batches([part]).group_by(["id", "fp", "text"], use_threads=False).aggregate([([], "count_all")])
            chunk = [bisect_right(borders, _place(i, fp)) for i, fp in zip(some["id"].to_pylist(), some["fp"].to_pylist())]
            out = pa.table({"chunk": pa.array(chunk, pa.int64()), "id": some["id"], "fp": some["fp"], "text": some["text"], "copies": some["count_all"]})
            yield from out.to_batches()

    apart = rows.mapInArrow(dealt, f"chunk bigint, id {kind}, fp bigint, text string, copies bigint").groupBy("chunk")
    hashes = apart.applyInArrow(_hashes(size, bits), "bucket bigint, chunk bigint, hashes binary")
    flags = hashes.groupBy("bucket").applyInArrow(_earlier, "chunk bigint, bucket bigint, earlier binary")
    spans = "array<struct<start: bigint, end: bigint>>"
    left = apart.cogroup(flags.groupBy("chunk")).applyInArrow(
        _results(size, bits), f"id {kind}, copies bigint, n_words bigint, n_removed bigint, removed {spans}, text string"
    )
    again, enough = F.col("k") > 1, F.col("n_words") >= size
    gone = F.when(enough, F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("end")))).otherwise(F.col("removed"))
    return left.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("k")).select(
        F.col("id").alias(id_col), "n_words",
        F.when(again & enough, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(again, gone).otherwise(F.col("removed")).alias("removed"),
        F.when(again & enough, "").otherwise(F.col("text")).alias("text"),
    )
