"""Near-duplicate documents: DartMinHash signatures of weighted word shingles, banded, checked and joined into classes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cut
from . import bpe
from .common import hinted, unused
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
#: Texts of one band that are compared in one task with another such block.
BLOCK = 128
#: Characters of text that a task works on at once.
CHUNK = 200_000
#: What a text counts there at least, for the darts of a short text are as many.
LEAST = 2_000
WORD = re.compile(r"\w+")

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Chance of at most 0, 1, 2, ... darts in a region of area 1.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 20)]))
_words: bpe.Memory = bpe.Memory(60_000)  # per worker process: hashes of words


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def shingles(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of a text's word shingles; a text of fewer words is one shingle, one without words none."""
    found = WORD.findall(text.lower())
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    _words.room_for(len(found))
    for w in set(found):
        if w not in _words:
            _words[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    runs = max(1, len(h) - size + 1)
    out = np.full(runs, np.uint64(min(size, len(h))))
    for k in range(min(size, len(h))):
        out = _mix(out * _C1 + h[k : k + runs])
    return np.unique(out, return_counts=True)


def elements(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A weighted set as a plain one: the second, third, ... copy of a shingle are elements of their own, so the
    Jaccard similarity of two such sets is the weighted one (sum of minima over sum of maxima)."""
    which = np.repeat(np.arange(len(hashes)), counts)
    copy = np.arange(len(which)) - _starts(counts)[which]
    return np.sort(np.where(copy == 0, hashes[which], _mix(hashes[which] + copy.astype(np.uint64) * _C1)))


def dart_minhash(sets: list[tuple[np.ndarray, np.ndarray]], coordinates: int) -> np.ndarray:
    """A row of `coordinates` values per weighted set (none may be empty); two sets agree in a coordinate with
    the probability of their weighted Jaccard similarity.

    Each element has its own darts, thrown by its hash alone: a Poisson process over weight x rank, in regions of area
    1. A set sees the darts below its element's weight and takes, per coordinate, the one of lowest rank. Only
    ranks up to t / (total weight) are thrown, t darts being expected; sets with a coordinate left empty go on with twice as many.
    """
    out = np.zeros((len(sets), coordinates), np.uint32)
    todo = np.arange(len(sets))
    darts = coordinates * (np.log(coordinates) + 2)
    while len(todo):
        sizes = np.array([len(sets[i][0]) for i in todo])
        element = np.concatenate([sets[i][0] for i in todo])
        weight = np.concatenate([sets[i][1] for i in todo]).astype(np.float64)
        owner = np.repeat(np.arange(len(todo)), sizes)
        top = darts / np.bincount(owner, weight)
        high, wide = np.ceil(top).astype(np.int64)[owner], np.ceil(weight).astype(np.int64)
        cell = np.repeat(np.arange(len(element)), high * wide)
        inside = np.arange(len(cell)) - _starts(high * wide)[cell]
        w0, r0 = inside // high[cell], inside % high[cell]
        region = _mix(_mix(element[cell] + w0.astype(np.uint64) * _C1) ^ (r0.astype(np.uint64) * _C3 + _C2))
        thrown = np.searchsorted(_POISSON, _unit(region), side="right")
        at = np.repeat(np.arange(len(cell)), thrown)
        nth = np.arange(len(at)) - _starts(thrown)[at]
        dart = _mix(region[at] + (nth + 1).astype(np.uint64) * _C1)
        rank = r0[at] + _unit(_mix(dart + _C1))
        seen = (w0[at] + _unit(_mix(dart + _C2)) < weight[cell[at]]) & (rank < top[owner[cell[at]]])
        dart, rank, of = dart[seen], rank[seen], owner[cell[at[seen]]]
        slot = of * coordinates + (_mix(dart + _C3) % np.uint64(coordinates)).astype(np.int64)
        order = np.lexsort((rank, slot))
        slot, first = np.unique(slot[order], return_index=True)
        found = np.zeros(len(todo) * coordinates, np.uint32)
        found[slot] = dart[order][first] >> np.uint64(32)
        full = np.bincount(slot // coordinates, minlength=len(todo)) == coordinates
        out[todo[full]] = found.reshape(-1, coordinates)[full]
        todo = todo[~full]
        darts *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band, which holds the band's number too."""
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1))
    for r in range(rows):
        key = _mix(key * _C1 + signatures[:, r::rows][:, :bands].astype(np.uint64))
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, row_id, row_fp, node (128-bit name of the shingles and their counts; null without words) and bands of each row."""
    i, text = F.col(id_col), F.col(text_col).cast("string")
    source = docs.select(i.alias("id"), F.coalesce(i.cast("string"), F.lit("")).alias("row_id"), F.xxhash64(i.isNull(), text).alias("row_fp"), text.alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for part in parts:
            at = 0
            for group in bpe.batches((t.as_py() or "" for t in part.column(3)), CHUNK, LEAST):
                sets = [shingles(t, size) for t in group]
                full = [k for k, s in enumerate(sets) if len(s[0])]
                nodes, keys = [None] * len(group), [None] * len(group)
                if full:
                    for k, row in zip(full, band_keys(dart_minhash([sets[k] for k in full], bands * rows), bands, rows).tolist()):
                        keys[k] = row
                        nodes[k] = xxhash.xxh3_128_digest(sets[k][0].tobytes() + sets[k][1].tobytes())
                own = [part.column(c).slice(at, len(group)) for c in range(3)]
                at += len(group)
                yield pa.RecordBatch.from_arrays([*own, pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names)

    names = ["id", "row_id", "row_fp", "node", "bands"]
    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, row_id string, row_fp bigint, node binary, bands array<bigint>")


def _shingle_sets(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """node, items (elements of the weighted shingle set) of the given rows (node, row_id, row_fp)."""
    i, text = F.col(id_col), F.col(text_col).cast("string")
    source = docs.select(F.coalesce(i.cast("string"), F.lit("")).alias("row_id"), F.xxhash64(i.isNull(), text).alias("row_fp"), text.alias("text"))
    wanted = source.join(hinted(rows), ["row_id", "row_fp"]).select("node", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for part in parts:
            at = 0
            for group in bpe.batches((t.as_py() for t in part.column(1)), CHUNK):
                items = [elements(*shingles(t, size)).view(np.int64) for t in group]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(group)), pa.array(items, pa.list_(pa.int64()))], ["node", "items"])
                at += len(group)

    return wanted.mapInArrow(run, "node binary, items array<bigint>")


def block_links(nodes: list[bytes], sets: list[np.ndarray], labels: list[bytes], threshold: float) -> list[tuple[bytes, bytes]]:
    """Links (similarity of `threshold` or more) that join the labels of a block as far as any such links do.

    Shared elements are counted for all texts of the block by a matrix product over a few thousand elements at a
    time. What leaves is at most one link per label, however many pairs are similar.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, which, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    column = (np.cumsum(shared) - 1)[which]
    keep = shared[which]
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both, step = np.zeros((len(sets), len(sets)), np.float64), 4096
    for low in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, (low, low + step))
        one = np.zeros((len(sets), step), np.float32)
        one[owner[a:b], column[a:b] - low] = 1
        both += one @ one.T
    near = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    parent = {x: x for x in labels}

    def root(x: bytes) -> bytes:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    _, group = np.unique(np.array([x.hex() for x in labels]), return_inverse=True)
    for i, j in np.argwhere(np.triu(near, 1) & (group[:, None] != group[None, :])):
        a, b = root(labels[i]), root(labels[j])
        if a != b:
            parent[a] = b
            out.append((nodes[i], nodes[j]))
    return out


def _block_links(members: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links inside bands (band, node, label, main: the band's largest label) by pairs of blocks; see block_links.

    Nodes of the main label are connected already. They are dealt to blocks behind those of the others, and only pairs
    of blocks of which one holds others are compared: the work grows with others times members.
    """
    others = F.col("label") != F.col("main")
    sizes = members.groupBy("band").agg(F.sum(others.cast("int")).alias("m"), F.sum((~others).cast("int")).alias("k"))
    placed = members.join(sizes, "band").withColumns({"front": F.ceil(F.col("m") / block), "back": F.ceil(F.col("k") / block)})
    mine = F.when(others, F.pmod(F.xxhash64("node"), "front")).otherwise(F.col("front") + F.pmod(F.xxhash64("node"), "back"))
    last = F.col("front") - 1 + F.when(others, F.col("back")).otherwise(0)
    pairs = placed.select("band", "node", "label", mine.cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("other")).select(
        "band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "label"
    )
    schema = "a binary, b binary"

    def run(t: pa.Table) -> pa.Table:
        found = block_links(t["node"].to_pylist(), [np.asarray(x.values) for x in t["items"]], t["label"].to_pylist(), threshold)
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([x for _, x in found], pa.binary())})

    return pairs.join(sets, "node").groupBy("band", "i", "j").applyInArrow(run, schema).distinct()


def _unconnected(shared: DataFrame, known: DataFrame) -> DataFrame:
    """band, node, label and main (the label most of the band's nodes have) in bands whose nodes have different labels."""
    labelled = shared.filter("n > 2").select("band", "node").join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per_label = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    split = per_label.groupBy("band").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels"))
    return cut(labelled.join(split.filter("labels > 1").select("band", "main"), "band"))


def links(docs: DataFrame, signed: DataFrame, id_col: str, text_col: str, size: int, threshold: float, block: int) -> DataFrame:
    """Checked links (a, b) between shingle sets that connect all sets which any similar pair with a common band connects.

    1. Sets that share a band are compared with the one of them that meets most others (a star per band:
       as many comparisons as there are rows).
    2. In bands whose sets are not yet all connected, those outside the band's largest class are compared exactly
       with all of the band, block by block; pairs are not emitted.
    """
    entries = signed.filter("node is not null").select("node", F.explode("bands").alias("band")).distinct()
    full = entries.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut(entries.join(full, "band"))
    popular = shared.groupBy("node").agg(F.sum("n").alias("meets"))
    hubs = shared.join(popular, "node").groupBy("band").agg(F.max(F.struct("meets", "node"))["node"].alias("hub"))
    stars = shared.join(hubs, "band").filter("node <> hub").select("node", "hub").distinct()

    first = signed.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("row_id", "row_fp")).alias("r"))
    sets = cut(_shingle_sets(docs, cut(first.select("node", "r.row_id", "r.row_fp")), id_col, text_col, size))
    common = F.size(F.array_intersect("items", "hub_items")).cast("double")
    alike = common >= threshold * (F.size("items") + F.size("hub_items") - common) - 1e-9
    star_links = cut(
        stars.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("items").alias("hub_items")), "hub")
        .filter(alike).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    )
    return star_links.union(_block_links(_unconnected(shared, components(star_links)), sets, threshold, block))


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD,
    bands: int = BANDS, rows: int = ROWS, block: int = BLOCK,
) -> DataFrame:
    """One row per document: id, class_id (smallest id of its class), class_size, kept (true for one row per class).

    Texts are sets of shingles of `size` words (`\\w+` of the lower-cased text) weighted by their counts. Two
    texts are linked when they share a band of their DartMinHash signatures and their weighted Jaccard similarity,
    computed exactly, is `threshold` or more; classes are what the links connect. With 24 bands of 5, a pair
    at 0.8 shares none with probability 7e-5.

    Copies are one node from the start, so a text that a third of the rows hold costs one row. A band with many
    different texts costs one comparison per text if its texts are all similar to one; only what stays
    unconnected there is compared with the band, block by block.

    A text of fewer than `size` words is one shingle; a null, empty or wordless one is in a class of its own. Rows
    without an id never give the class its id unless all are without. Rows that repeat an id and a text
    share a class. The row kept is the one of the smallest id, of several such the one whose text's hash is smallest;
    of rows equal in both it is any one. No rows in, no rows out. Other columns are not read.
    """
    signed = cut(signatures(docs, id_col, text_col, size, bands, rows))
    found = components(links(docs, signed, id_col, text_col, size, threshold, block))
    members = signed.join(found, "node", "left").select("id", "row_id", "row_fp", F.coalesce("label", "node").alias("class"))
    stored = cut(members.withColumn("number", F.monotonically_increasing_id()))  # tells equal rows apart
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row_fp", "number")
    classes = stored.filter("class is not null").groupBy("class").agg(
        F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(order)["number"].alias("first")
    )
    alone = F.col("class").isNull()
    out = stored.join(classes, "class", "left")
    return out.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        (alone | (F.col("number") == F.col("first"))).alias("kept"), "row_id", "row_fp",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` that near_dedup keeps, all columns unchanged; of rows that repeat an id and a text any one."""
    judged = near_dedup(docs, id_col, text_col, **how).groupBy("row_id", "row_fp").agg(F.bool_and("kept").alias("all"), F.bool_or("kept").alias("one"))
    row_id, row_fp, one = unused(docs, "__row_id", "__row_fp", "__one")
    some = cut(judged.filter("not all").select("row_id", "row_fp", "one").toDF(row_id, row_fp, one))
    i = F.col(id_col)
    keyed = docs.withColumns({row_id: F.coalesce(i.cast("string"), F.lit("")), row_fp: F.xxhash64(i.isNull(), F.col(text_col).cast("string"))})
    same = [row_id, row_fp]
    whole = keyed.join(hinted(some), same, "left_anti")
    repeated = some.filter(F.col(one))
    if not repeated.isEmpty():  # tasks reduce the copies of a row on their own
        whole = whole.unionByName(keyed.join(hinted(repeated), same, "left_semi").dropDuplicates(same))
    return whole.drop(*same)
