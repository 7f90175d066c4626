"""Vector codes: each part of a vector is replaced by the number of its nearest codebook entry."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cut
from .common import small_enough

#: Parts of a vector, entries of a codebook (bits of a mask), training rounds, units per 1.0.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are looked up at once.
STEP = 1024
#: Rows of a hot label meet its sum in so many tasks.
SALTS = 32


class Book:
    """The codebook of one part position: up to 64 entries of integers.

    Per dimension the entries' coordinates are sorted, and prefix k has the bits of the first k of them. A range of
    coordinates is then the difference of two prefixes, and the AND over the dimensions holds every entry in
    the cube of that radius: all that are at most so far away, and some in its corners.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # entries x dimensions
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        bits = np.uint64(1) << order.astype(np.uint64)
        self.prefix = np.concatenate([np.zeros((1, entries.shape[1]), np.uint64), np.bitwise_or.accumulate(bits, axis=0)])
        between = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        np.fill_diagonal(between, np.iinfo(np.int64).max)
        near = np.sort(between.min(axis=1))[len(entries) // 2] if len(entries) > 1 else 0
        self.radius = isqrt(int(near)) + 1  # as far as entries usually are from one another

    def candidates(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries in the cube of `radius` around each point."""
        masks = np.full(len(points), ~np.uint64(0))
        for d in range(points.shape[1]):
            low = np.searchsorted(self.sorted[:, d], points[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], points[:, d] + radius, "right")
            masks &= self.prefix[high, d] & ~self.prefix[low, d]
        return masks

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each point's nearest entry (the lower one of a tie) and the squared distance."""
        number, far = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        open_ = np.arange(len(points))
        radius = np.full(len(points), self.radius, np.int64)
        while len(open_):
            masks = self.candidates(points[open_], radius[open_])
            bits = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, entry = np.nonzero(bits)
            square = ((points[open_[row]] - self.entries[entry]) ** 2).sum(axis=1)
            # pairs are in order of row and entry: the first smallest one of a row is the lower entry
            begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
            met = open_[row[begins]]
            least = np.minimum.reduceat(square, begins) if len(row) else square
            is_least = np.flatnonzero(square == np.repeat(least, np.diff(np.concatenate([begins, [len(row)]]))))
            rows, at = np.unique(row[is_least], return_index=True)
            sure = least <= radius[met] ** 2  # nothing outside the cube is that near
            number[met], far[met] = entry[is_least[at]], least
            # found in a corner: that far and no farther; found nothing: look twice as far
            radius[open_] *= 2
            radius[met] = np.ceil(np.sqrt(least.astype(np.float64))).astype(np.int64) + 1
            done = np.zeros(len(points), bool)
            done[met[sure]] = True
            open_ = open_[~done[open_]]
        return number, far


def _integers(vectors: pa.Array, size: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(vectors), size)


def _limit(size: int) -> float:
    """Components up to this one keep all sums of squares within 62 bits."""
    return isqrt((1 << 60) // max(size, 1)) / SCALE / 2


def _sums(books: np.ndarray, size: int) -> Callable:
    """A task's counts and sums of the parts assigned to each entry; one row per part, entry and position."""
    wide = size // PARTS

    def run(parts: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        lookup = [Book(b) for b in books]
        total, n = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for part in parts:
            for at in range(0, part.num_rows, STEP):
                points = _integers(part.column(1).slice(at, STEP), size)
                for p, book in enumerate(lookup):
                    mine = points[:, p * wide : (p + 1) * wide]
                    number, _ = book.nearest(mine)
                    np.add.at(total[p], number, mine)
                    n[p] += np.bincount(number, minlength=books.shape[1])
        p, e, d = np.nonzero(np.broadcast_to((n > 0)[:, :, None], books.shape))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(d), pa.array(total[p, e, d]), pa.array(n[p, e])], ["part", "entry", "place", "total", "n"])

    return run


def _codes(books: np.ndarray, size: int) -> Callable:
    wide = size // PARTS

    def work(points: np.ndarray) -> list[pa.Array]:
        lookup = [Book(b) for b in books]
        both = [book.nearest(points[:, p * wide : (p + 1) * wide]) for p, book in enumerate(lookup)]
        codes = np.stack([b[0] for b in both], axis=1).astype(np.uint8)
        return [pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(np.sum([b[1] for b in both], axis=0), pa.int64())]

    return work


def train(kept: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x positions) after `rounds` rounds from the vectors `first`.

    What comes back from a round is a row per part, entry and position, so 64 numbers per component of a vector, however
    many vectors there are. Tasks add up their own before anything is shuffled.
    """
    size = first.shape[1]
    books = first.reshape(len(first), PARTS, size // PARTS).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        parts = kept.mapInArrow(_sums(books, size), "part bigint, entry bigint, place bigint, total bigint, n bigint")
        new = books.copy()
        for r in parts.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            new[r.part, r.entry, r.place] = r.total // r.n
        books = new
    return books


def _with_label_error(coded: DataFrame, id_col: str) -> DataFrame:
    coded = cut(coded)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    salt: list[str] = []
    if small_enough(sums):
        sums = F.broadcast(sums)
    else:
        salt = ["salt"]
        sums = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        coded = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    a, b = coded.alias("a"), sums.alias("b")
    same = F.col("a.label").eqNullSafe(F.col("b.label"))
    for s in salt:
        same = same & (F.col(f"a.{s}") == F.col(f"b.{s}"))
    return a.join(b, same).select(F.col("a.id").alias(id_col), "a.code", "a.error", "b.label_error")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, code, error, label_error) of every kept vector, and the codebooks (parts x entries x positions).

    Vectors that are null or hold a null or non-finite component are left out. Components become floor(256 * x). A
    vector is cut into 16 equal parts; the codebook of a part starts from the 64 smallest ids and is trained for
    two rounds. `code` has two hex digits per part, `error` is the squared distance of a vector to its code,
    `label_error` the sum of it over all rows of the label, rows without a label together.

    Nearest entries are exact: see Book. The codebooks (64 numbers per component) are all that is collected or sent
    to tasks. A table of sums per label that is not small meets its rows in salted groups.

    The first kept vector whose length is a positive multiple of 16 sets the length. A kept vector of another length, and
    one with components so large that a sum of squares could leave 62 bits (beyond some 250,000 at 64
    components) has no code: code and error are null, it counts in no sum and no codebook. With fewer than 64 vectors a
    codebook has fewer entries; entries that are equal are told apart by their number, the lower one wins. Ids
    may be null (they come last) or repeated (then the vector's values decide the order); every row stays a row. No
    rows in, no rows out, and the codebooks are empty. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.filter(F.col("vector").isNotNull() & finite)
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    head = kept.filter((F.size("vector") > 0) & (F.size("vector") % PARTS == 0)).orderBy(*order).select(F.size("vector").alias("n")).first()
    size = head.n if head is not None else 0
    usable = (F.size("vector") == size) & F.forall("vector", lambda x: F.abs(x) <= _limit(size)) if size else F.lit(False)
    good = kept.filter(usable)
    entries = good.orderBy(*order).limit(ENTRIES).select("vector").collect()
    if not entries:
        none = kept.select(F.col("id").alias(id_col), F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"), F.lit(None).cast("bigint").alias("label_error"))
        return none, np.zeros((PARTS, 0, 0), np.int64)
    first = np.floor(np.array([r.vector for r in entries]) * SCALE).astype(np.int64)
    books = train(good.select("id", "vector"), first)
    work = _codes(books, size)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, STEP):
                ids, vectors, labels = part.slice(at, STEP).columns
                yield pa.RecordBatch.from_arrays([ids, labels, *work(_integers(vectors, size))], ["id", "label", "code", "error"])

    kinds = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error bigint"
    coded = good.select("id", "vector", "label").mapInArrow(run, kinds)
    bare = kept.filter(~usable).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    return _with_label_error(coded.unionByName(bare), id_col), books
