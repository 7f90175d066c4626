"""Cross-entropy difference scoring with two matched n-gram models over one vocabulary."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import hinted

#: Added count per word, and how many observations the single-word model is worth as a prior of the pair model.
ALPHA, PRIOR = 0.5, 4.0
#: Bytes of text in a chunk: a thousandth of the corpus, within these limits (a longer text has a chunk of its own).
CHUNK_MIN, CHUNK_MAX = 4_000_000, 32_000_000
WORD = re.compile(r"\w+")
#: Stands before a text's first word.
START = np.uint64(0x9E3779B97F4A7C15)
_hashes: bpe.Memory = bpe.Memory(60_000)  # per worker process


def tokens(text: str) -> np.ndarray:
    """The text's words (`\\w+`, lower-cased) as 64-bit hashes."""
    found = WORD.findall(text.lower())
    _hashes.room_for(len(found))
    for w in set(found):
        if w not in _hashes:
            _hashes[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def pack(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, as many bytes as the largest needs; bytes that are mostly zero compress well."""
    wide = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    wide = blob[0]
    out = np.zeros(((len(blob) - 1) // wide, 8), np.uint8)
    out[:, :wide] = np.frombuffer(blob, np.uint8, offset=1).reshape(wide, -1).T
    return out.view("<u8").ravel()


class Chunk:
    """The documents of a chunk, its different words (the start of a text is one of them) and its different pairs."""

    def __init__(self, table: pa.Table):
        # equal rows are one row here, with the number of its copies
        self.docs = table.group_by(["id", "fp", "text", "mine"], use_threads=False).aggregate([("copies", "sum")])
        found = [tokens(t.as_py()) for t in self.docs["text"]]
        self.sizes = np.array([len(x) for x in found], np.int64)
        w = np.concatenate([*found, [START]]).astype(np.uint64)
        self.words, which = np.unique(w, return_inverse=True)
        self.word = which[:-1]
        self.context = np.concatenate([which[-1:], which[:-2]])[: len(self.word)]
        self.context[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = which[-1]
        before = self.words[self.context]
        both = (before * np.uint64(0xBF58476D1CE4E5B9) + w[:-1]) * np.uint64(0x94D049BB133111EB)
        self.pairs, self.pair = np.unique(both ^ (both >> np.uint64(29)), return_inverse=True)

    def columns(self) -> dict[str, tuple[np.ndarray, dict[str, np.ndarray]]]:
        """Names and counts, in target rows (t) and in all rows (b), of words, words as context (c) and pairs."""
        every = np.repeat(self.docs["copies_sum"].to_numpy(), self.sizes)
        mine = every * np.repeat(self.docs["mine"].to_numpy(), self.sizes)

        def count(which, n, weights):
            return np.bincount(which, weights, n).astype(np.uint64)

        n, m = len(self.words), len(self.pairs)
        words = {"wt": count(self.word, n, mine), "wb": count(self.word, n, every), "ct": count(self.context, n, mine), "cb": count(self.context, n, every)}
        return {"words": (self.words, words), "pairs": (self.pairs, {"pt": count(self.pair, m, mine), "pb": count(self.pair, m, every)})}


#: What travels: names of words and their counts, names of pairs and theirs.
COUNTS = {"words": ("wt", "wb", "ct", "cb"), "pairs": ("pt", "pb")}
SENT = [x for kind, counts in COUNTS.items() for x in (kind, *counts)]
ANSWERED = [c for counts in COUNTS.values() for c in counts]


def _buckets(names: np.ndarray, bits: int) -> np.ndarray:
    """Where the names of each of 2^bits buckets begin and end."""
    tops = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(names, tops), [len(names)]])


def _counted(bits: int) -> Callable[[pa.Table], pa.Table]:
    """A chunk's names and counts, a row per bucket."""

    def run(table: pa.Table) -> pa.Table:
        out = {"bucket": pa.array(range(1 << bits), pa.int64()), "chunk": pa.array([table["chunk"][0].as_py()] * (1 << bits), pa.int64())}
        for kind, (names, counts) in Chunk(table).columns().items():
            at = _buckets(names, bits)
            cut = [slice(i, j) for i, j in zip(at[:-1], at[1:])]
            out[kind] = pa.array([pack(np.diff(names[c], prepend=np.uint64(0))) for c in cut], pa.binary())
            out |= {name: pa.array([pack(x[c]) for c in cut], pa.binary()) for name, x in counts.items()}
        return pa.table(out)

    return run


def _sums(table: pa.Table, kind: str) -> tuple[np.ndarray, list[int], dict[str, np.ndarray]]:
    """Which of the bucket's different names each entry has, where chunks end, and the counts of each name."""
    names = [np.cumsum(unpack(x), dtype=np.uint64) for x in table[kind].to_pylist()]
    known, which = np.unique(np.concatenate(names), return_inverse=True)
    sums = {c: np.bincount(which, np.concatenate([unpack(x) for x in table[c].to_pylist()]), len(known)).astype(np.uint64) for c in COUNTS[kind]}
    return which, np.cumsum([len(x) for x in names])[:-1], sums


def _added(table: pa.Table) -> pa.Table:
    """To each chunk of a bucket the counts of its names in all chunks."""
    out = {"chunk": table["chunk"], "bucket": table["bucket"]}
    for kind in COUNTS:
        which, ends, sums = _sums(table, kind)
        out |= {c: pa.array([pack(x) for x in np.split(n[which], ends)], pa.binary()) for c, n in sums.items()}
    return pa.table(out)


def _totals(table: pa.Table) -> pa.Table:
    """Different words of a bucket, and how often they occur in target rows and in all rows."""
    sums = _sums(table, "words")[2]
    return pa.table({"n": [int((sums["wb"] > 0).sum())], "t": [int(sums["wt"].sum())], "b": [int(sums["wb"].sum())]})


def _scored(bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A row per different row of the chunk with its losses per word, given the counts of its names in all chunks."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        said = answers.to_pylist()
        totals = next(x for x in said if x["bucket"] < 0)
        target, background, vocabulary = float(totals["t"]), float(totals["b"]), max(1, totals["n"])
        got = {}
        for kind, names in (("words", chunk.words), ("pairs", chunk.pairs)):
            at = _buckets(names, bits)
            got |= {c: np.zeros(len(names)) for c in COUNTS[kind]}
            for x in said:
                if x["bucket"] >= 0:
                    for c in COUNTS[kind]:
                        got[c][at[x["bucket"]] : at[x["bucket"] + 1]] = unpack(x[c])
        doc = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)
        losses = []
        for m, scale in (("t", 1.0), ("b", target / max(background, 1.0))):
            single = (got[f"w{m}"] * scale + ALPHA) / (target + ALPHA * vocabulary)
            word = PRIOR * single[chunk.word]
            loss = np.log(got[f"c{m}"] * scale + PRIOR)[chunk.context] - np.log(got[f"p{m}"][chunk.pair] * scale + word)
            losses.append(np.bincount(doc, loss, len(chunk.sizes)) / np.maximum(chunk.sizes, 1))
        none = chunk.sizes == 0
        t, b, difference = (pa.array(x, pa.float64(), mask=none) for x in (*losses, losses[0] - losses[1]))
        return pa.table({
            "id": chunk.docs["id"], "copies": chunk.docs["copies_sum"], "n_tokens": pa.array(chunk.sizes, pa.int64()),
            "target_loss": t, "background_loss": b, "score": difference,
        })

    return run


def _together(parts: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Rows that are repeated here travel once."""
    for part in parts:
        some = pa.Table.from_batches([part]).group_by(part.schema.names, use_threads=False).aggregate([([], "count_all")])
        yield from some.rename_columns([*part.schema.names, "copies"]).to_batches()


def cross_entropy_difference(
    docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int | None = None
) -> DataFrame:
    """Score every document against the documents whose ids `target_ids` lists (its first column): id, n_tokens,
    target_loss, background_loss and score (their difference per word; low is like the target).

    Both models share vocabulary, order and smoothing, and have the single-word model as prior of the pair model;
    the target model has the listed documents, the background all. The background's counts are scaled to the
    target's number of words, so that both models give the same weight to what they have not seen.

    Words, contexts and pairs are counted under 64-bit names, with no limit to their number. Documents are dealt into
    chunks by hash. A chunk sends each name and its counts once to the name's bucket, sorted and packed; a bucket adds
    up the chunks and answers each with the counts of the names it sent. So every document is scored where its text is,
    nothing but counts travels, texts are shuffled once (both uses of them read the same shuffle), and a word that is
    everywhere costs a chunk one name. The number of words, of target words and of different words is added up from the
    buckets and sent to each chunk. A chunk holds a thousandth of the corpus within CHUNK_MIN and
    CHUNK_MAX bytes (or `chunk_bytes`), and there are about as many buckets.

    Ids that repeat in `target_ids`, are null or are missing from `docs` change nothing. A null, empty or wordless text has
    0 tokens and null losses. With no target both models are smoothed alike and say little, but every row has a
    score. Rows that repeat an id are rows of their own. No rows in, no rows out.
    """
    wanted = target_ids.select(F.col(target_ids.columns[0]).alias("__target")).filter("__target is not null").distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(hinted(wanted), F.col("id") == F.col("__target"), "left")
    rows = rows.select("id", F.xxhash64(F.col("id").isNull(), "text").alias("fp"), "text", F.col("__target").isNotNull().alias("mine"))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    chunks = ceil((size + 1) / (chunk_bytes or min(CHUNK_MAX, max(CHUNK_MIN, size // 1000))))
    bits = (chunks - 1).bit_length()
    kind = docs.schema[id_col].dataType.simpleString()
    dealt = rows.select(F.pmod(F.xxhash64("id", "fp"), F.lit(chunks)).alias("chunk"), "*")
    apart = dealt.mapInArrow(_together, f"chunk bigint, id {kind}, fp bigint, text string, mine boolean, copies bigint").groupBy("chunk")
    binary = ", ".join(f"{c} binary" for c in SENT)
    counts = apart.applyInArrow(_counted(bits), f"bucket bigint, chunk bigint, {binary}").groupBy("bucket")
    answers = counts.applyInArrow(_added, "chunk bigint, bucket bigint, " + ", ".join(f"{c} binary" for c in ANSWERED))
    totals = counts.applyInArrow(_totals, "n bigint, t bigint, b bigint").agg(*(F.sum(c).alias(c) for c in "ntb"))
    everyone = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint")))
    totals = totals.filter("n is not null").select(everyone.alias("chunk"), F.lit(-1).cast("bigint").alias("bucket"), "n", "t", "b")
    answers = answers.unionByName(totals, allowMissingColumns=True)
    out = apart.cogroup(answers.groupBy("chunk")).applyInArrow(
        _scored(bits), f"id {kind}, copies bigint, n_tokens bigint, target_loss double, background_loss double, score double"
    )
    each = out.withColumn("copies", F.explode(F.expr("sequence(1L, copies)")))
    return each.select(F.col("id").alias(id_col), "n_tokens", "target_loss", "background_loss", "score")
