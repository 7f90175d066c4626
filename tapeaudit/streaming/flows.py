"""Structured Streaming flows: arriving bars, predictions, their results and quality rows.

Arriving ticks and predictions are merged into stored tables (`tables.MergedTable`), of which a
micro-batch touches only the partitions that it has rows for.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bar_quality import bar_issues
from .tables import MergedTable

TICKS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for logs and checkpoints, inside the folder the cluster names."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        return tempfile.mkdtemp(prefix=f"spark-{name}-")
    import uuid

    return f"{base}/{name}-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, path: str, schema: str, glob: str | None = None, per_trigger: int = 1) -> DataFrame:
    """Parquet files as they arrive, in folders of any depth."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True)
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(path)


def run_to_end(stream: DataFrame, checkpoint: str, batch=None, out: str | None = None) -> None:
    """Process everything available, then stop."""
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    q = w.foreachBatch(batch).start() if batch else w.format("parquet").option("path", out).outputMode("append").start()
    q.awaitTermination()


def hourly_bars(ticks: DataFrame) -> DataFrame:
    """Hourly bars of a symbol from (event_id, symbol, ts, value), in order of time and event."""
    tick = F.struct("ts", "event_id")
    return ticks.groupBy("symbol", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.min_by("value", tick).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", tick).alias("close"), F.count(F.lit(1)).alias("volume"),
    ).withColumn("ts", F.col("hour"))


def bar_table(spark: SparkSession, path: str) -> MergedTable:
    """Ticks by event, stored by day, and the hourly bars of every day (an hour never spans two)."""
    bars = "symbol string, hour timestamp_ntz, open double, high double, low double, close double, volume bigint, ts timestamp_ntz"
    day = F.date_format("ts", "yyyy-MM-dd")
    return MergedTable(spark, path, "event_id bigint, symbol string, ts timestamp_ntz, value double", ["event_id"], day, {"bars": (bars, hourly_bars)})


def _stream_of(checkpoint: str) -> str:
    """A stream is named by its checkpoint, so two streams never take each other's batches for their own."""
    return hashlib.md5(checkpoint.encode()).hexdigest()[:12]


def stream_upsert_bars(ticks: DataFrame, table: str, checkpoint: str) -> None:
    """Merge arriving ticks into the stored bars: an event counts once, in whatever file, stream or batch it is repeated.

    A batch reads and writes the days that it touches. An event keeps its day when it is sent again. Ticks
    without an event id are told apart by symbol, time and value.
    """
    stored = bar_table(ticks.sparkSession, table)
    ticks = ticks.withColumn("event_id", F.coalesce("event_id", F.xxhash64("symbol", "ts", "value")))
    run_to_end(ticks, checkpoint, lambda df, n: stored.merge(df, _stream_of(checkpoint), n))


def latest_bars(spark: SparkSession, table: str) -> DataFrame:
    """Every (symbol, hour) of the stored bars."""
    return bar_table(spark, table).read("bars").drop("ts")


def prediction_table(spark: SparkSession, path: str) -> MergedTable:
    return MergedTable(spark, path, "symbol string, dt date, y_prob double", ["dt", "symbol"], F.date_format("dt", "yyyy-MM"))


def stream_predictions(scored: DataFrame, table: str, checkpoint: str) -> None:
    """Append a prediction once per (dt, symbol): the first one stays, across batches, streams and restarts.

    A batch reads and writes the months that it touches, not the whole log.
    """
    stored = prediction_table(scored.sparkSession, table)
    run_to_end(scored, checkpoint, lambda df, n: stored.merge(df, _stream_of(checkpoint), n))


def stream_matured(predictions: DataFrame, outcomes: DataFrame, out: str, checkpoint: str, wait: str = "30 days") -> None:
    """Each prediction once, with its outcome (`matured`) or without (`pending`).

    Both streams carry `ts`, the time of the signal. An outcome may arrive in any later batch within `wait` behind
    the watermark, which follows the slower of the two streams; a prediction whose time it has passed without an
    outcome comes out as pending, and its state goes. A last prediction with an outcome far ahead closes the books.
    """
    p = predictions.withWatermark("ts", wait).alias("p")
    o = outcomes.withWatermark("ts", wait).alias("o")
    j = p.join(o, F.expr("p.symbol = o.symbol and p.ts = o.ts"), "left_outer")
    status = F.when(F.col("o.symbol").isNull(), "pending").otherwise("matured").alias("status")
    rows = j.select("p.symbol", "p.ts", "p.y_prob", "o.ret_net", "o.win", status)
    run_to_end(rows, checkpoint, out=out)


def stream_dq_values(ticks: DataFrame, out: str, checkpoint: str, low: float = 1.0, high: float = 90.0) -> None:
    """Quality rows as they arrive: missing, non-positive and extreme values."""
    v = F.col("value")
    issue = F.when(v.isNull(), "missing").when(v < low, "low").when(v > high, "extreme")
    rows = ticks.withColumn("issue", issue).filter("issue is not null").select("event_id", "symbol", "ts", "issue", "value")
    run_to_end(rows, checkpoint, out=out)


def stream_dq(bars: DataFrame, out: str, checkpoint: str, delay: str) -> None:
    """Issues of arriving bars, those that need the bar before included: see `bar_issues`."""
    with _rocksdb(bars.sparkSession):
        run_to_end(bar_issues(bars, delay), checkpoint, out=out)


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Keyed state with timers needs this state store."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
