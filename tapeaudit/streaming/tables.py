"""A stored table that micro-batches are merged into, one partition at a time.

Layout: `rows/version=N/part=P` holds the rows that version N wrote for partition P, `<derived>/version=N/part=P`
what was derived from them, and `manifest/version=N` one line per partition of that version, with the stream
and the batch that made it. The newest line of a partition is in force. A version is published by its manifest,
which is written last: what an interrupted batch left behind is never read, and its retry overwrites it.
One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "part string, stream string, batch bigint, version bigint"


class MergedTable:
    """Rows with a key, kept once: the first delivery of a key stays, however often, whenever and in whatever file it
    comes again.

    `part` names a row's partition (a string) and must follow from the key's row alone, so that repeats of a key meet
    in one partition. Of the partitions that a batch has rows for, the keys are read; those with new rows are
    written again. `derived` are tables made
    of whole partitions, such as bars of ticks.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], part: Column,
        derived: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] | None = None,
    ):
        self.spark, self.path, self.keys, self.part, self.derived = spark, path, list(keys), part, derived or {}
        self.schemas = {"rows": schema} | {name: s for name, (s, _) in self.derived.items()}

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def in_force(self) -> DataFrame:
        return self.manifest().groupBy("part").agg(F.max("version").alias("version"))

    def _stored(self, name: str, places: Iterable[tuple[str, int]]) -> DataFrame:
        paths = [f"{self.path}/{name}/version={v}/part={p}" for p, v in places]
        reader = self.spark.read.option("basePath", f"{self.path}/{name}").schema(f"{self.schemas[name]}, part string, version bigint")
        return reader.parquet(*paths).drop("part", "version")

    def merge(self, batch: DataFrame, stream: str, batch_id: int) -> None:
        """Add what is new in `batch`; a batch that was merged before is left out."""
        lines = self.manifest()
        seen = lines.agg(F.max("version").alias("v"), F.max((F.col("stream") == stream) & (F.col("batch") == batch_id)).alias("again")).first()
        if seen.again:
            return
        version = 0 if seen.v is None else seen.v + 1
        rest = [f.name for f in self.spark.createDataFrame([], self.schemas["rows"]).schema if f.name not in self.keys]
        new = batch.select(*self.keys, F.struct(*rest).alias("r")).groupBy(*self.keys).agg(F.min("r").alias("r"))
        new = new.select(*self.keys, "r.*").withColumn("part", self.part).persist()
        fresh = new
        try:
            found = new.select("part").distinct().join(self.in_force(), "part", "left").collect()  # partitions of one batch
            places = {r.part: r.version for r in found if r.version is not None}
            if places:
                fresh = new.join(self._stored("rows", places.items()).select(*self.keys), self.keys, "left_anti").persist()
            touched = fresh.select("part").distinct()
            parts = [r.part for r in touched.collect()]
            if not parts:
                return
            rows, again = fresh, [(p, places[p]) for p in parts if p in places]
            if again:
                rows = rows.unionByName(self._stored("rows", again).withColumn("part", self.part))
            rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/rows/version={version}")
            for name, (_, derive) in self.derived.items():
                made = derive(self._stored("rows", [(p, version) for p in parts])).withColumn("part", self.part)
                made.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{name}/version={version}")
            said = touched.select("part", F.lit(stream).alias("stream"), F.lit(batch_id).cast("bigint").alias("batch"))
            said.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        finally:
            fresh.unpersist()
            new.unpersist()

    def read(self, name: str = "rows") -> DataFrame:
        """The table as published: the newest version of each partition."""
        schema = f"{self.schemas[name]}, part string, version bigint"
        try:
            every = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schemas[name])
        # a line per partition against partition columns: versions that are not in force are pruned from the scan
        return every.join(self.in_force(), ["part", "version"]).drop("part", "version")
