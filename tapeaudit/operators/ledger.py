"""A stored hash-chained ledger that is appended to in batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GENESIS = "0" * 64


def canonical(*cols: str) -> Column:
    """JSON of the named columns with sorted keys, no spaces, and nulls kept."""
    return F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})


def chain_fold(entries: DataFrame, by: list[str], order: str, payload: str, heads: DataFrame | None = None, start: str = GENESIS) -> DataFrame:
    """by, order, payload, seq, prev_hash and entry_hash of new entries, each chain going on from its head.

    `heads` has by, seq and entry_hash of the last stored entry of a chain; a chain without one starts at seq 0 from
    `start`. A null payload counts as the text null. Chaining is sequential: a chain's entries pass through one
    task in order. They are sorted on disk if need be and folded one by one, so a task holds one hash however long
    a chain is; different chains run in parallel.
    """
    rows = entries.select(*by, order, payload)
    if heads is not None:
        last = heads.select(*by, F.col("seq").cast("bigint").alias("_seq"), F.col("entry_hash").alias("_hash"))
        rows = rows.join(last, by, "left")
    else:
        rows = rows.withColumns({"_seq": F.lit(None).cast("bigint"), "_hash": F.lit(None).cast("string")})
    kept = [*by, order, payload]
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]
    width = len(by)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        chain, seq, before = None, -1, start
        for part in parts:
            said = part.column(width + 1).cast(pa.string()).to_pylist()
            keys = zip(*(part.column(i).to_pylist() for i in range(width)))
            out = [], [], []
            for key, text, last, head in zip(keys, said, part.column(width + 2).to_pylist(), part.column(width + 3).to_pylist()):
                if key != chain:
                    chain, seq, before = key, -1 if last is None else last, start if head is None else head
                seq += 1
                mine = hashlib.sha256((before + ("null" if text is None else text)).encode()).hexdigest()
                for column, value in zip(out, (seq, before, mine)):
                    column.append(value)
                before = mine
            yield pa.RecordBatch.from_arrays([*part.columns[: width + 2], pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], [*kept, "_at", "prev_hash", "entry_hash"])

    placed = rows.select(*kept, "_seq", "_hash").repartition(*by).sortWithinPartitions(*by, order, payload)
    return placed.mapInArrow(run, ", ".join(kinds) + ", _at bigint, prev_hash string, entry_hash string")


class Ledger:
    """Chains of entries in `path`: `entries/version=N` and `heads/version=N` per batch, published by
    `manifest/version=N`, which is written last. What an interrupted batch left behind is never read, and its retry
    overwrites it. A batch that was appended before is left out. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, by: dict[str, str]):
        self.spark, self.path, self.by = spark, path, list(by)
        keys = ", ".join(f"`{k}` {t}" for k, t in by.items())
        self.schemas = {
            "entries": f"{keys}, seq bigint, payload string, prev_hash string, entry_hash string",
            "heads": f"{keys}, seq bigint, entry_hash string", "manifest": "batch string",
        }

    def _read(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{self.schemas[name]}, version bigint").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{self.schemas[name]}, version bigint")

    def _published(self, name: str) -> DataFrame:
        return self._read(name).join(self._read("manifest").select("version").distinct(), "version").drop("version")

    def entries(self) -> DataFrame:
        return self._published("entries")

    def heads(self) -> DataFrame:
        """The last entry of every chain."""
        return self._published("heads").groupBy(*self.by).agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("entry_hash"))

    def append(self, batch: DataFrame, order: str, batch_id: str, payload: str = "payload") -> None:
        """Add the entries of `batch` (by, order, payload) to their chains, in order."""
        told = self._read("manifest").agg(F.max("version").alias("v"), F.max(F.col("batch") == batch_id).alias("again")).first()
        if told.again:
            return
        version = 0 if told.v is None else told.v + 1
        at = {name: f"{self.path}/{name}/version={version}" for name in self.schemas}
        new = chain_fold(batch, self.by, order, payload, self.heads())
        new.select(*self.by, F.col("_at").alias("seq"), F.col(payload).cast("string").alias("payload"), "prev_hash", "entry_hash").write.mode("overwrite").parquet(at["entries"])
        written = self.spark.read.schema(self.schemas["entries"]).parquet(at["entries"])
        heads = written.groupBy(*self.by).agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("entry_hash"))
        heads.write.mode("overwrite").parquet(at["heads"])
        self.spark.range(1).select(F.lit(batch_id).alias("batch")).coalesce(1).write.mode("overwrite").parquet(at["manifest"])
