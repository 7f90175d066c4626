"""Streaming queries run to the end of what is available; their final state has an oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cut
from ..streaming import flows
from .base import CTES, query, r, rounded
from .outcomes import predictions

CTES["x_ticks"] = "SELECT event_id, 'E' || (user_id % 25) AS symbol, ts, value FROM events"


#: Files of a delivery, and files that a micro-batch takes.
DELIVERIES, PER_TRIGGER = 8, 4


def symbol():
    return F.concat(F.lit("E"), F.col("user_id") % 25).alias("symbol")


def ticks(d):
    s = flows.read_files(d.spark, d.dir, flows.TICKS, "events.parquet")
    return s.select("event_id", symbol(), "ts", "value")


@query(
    "stream_upsert_bars",
    """SELECT symbol, date_trunc('hour', ts) AS hour, round(arg_min(value, ROW(ts, event_id)),6)+0.0 AS open, round(max(value),6)+0.0 AS high, round(min(value),6)+0.0 AS low,
 round(arg_max(value, ROW(ts, event_id)),6)+0.0 AS close, count(*) AS volume FROM x_ticks GROUP BY 1, 2""",
)
def stream_upsert_bars(d):
    """Ticks in dated folders; hours are spread over the files, every third event comes twice, and all files come again."""
    w = flows.work_dir(d.spark, "bars")
    e = d.spark.read.parquet(f"{d.dir}/events.parquet")
    for day, rows in (("1", e.filter("event_id % 2 = 0")), ("2", e.filter("event_id % 2 = 1 or event_id % 3 = 0"))):
        rows.repartition(DELIVERIES // 2, "event_id").write.parquet(f"{w}/ticks/{day}")
    s = flows.read_files(d.spark, f"{w}/ticks", flows.TICKS, per_trigger=PER_TRIGGER).select("event_id", symbol(), "ts", "value")
    for again in ("", "2"):  # the same deliveries under another stream must not change the result
        flows.stream_upsert_bars(s, f"{w}/table", f"{w}/checkpoint{again}")
    return rounded(flows.latest_bars(d.spark, f"{w}/table"))


@query(
    "stream_dq_values",
    """SELECT event_id, symbol, ts, CASE WHEN value<1 THEN 'low' ELSE 'extreme' END AS issue, round(value,6)+0.0 AS value FROM x_ticks WHERE value<1 OR value>90""",
)
def stream_dq_values(d):
    w = flows.work_dir(d.spark, "dq")
    flows.stream_dq_values(ticks(d), f"{w}/out", f"{w}/checkpoint")
    return rounded(d.spark.read.parquet(f"{w}/out"))


#: Bars arrive in so many files, a tenth of them one file late; what a file spans, twice, is the delay.
BAR_FILES = 12
FAR = "2100-01-01"


@query("stream_dq", "SELECT symbol, dt, severity, issue, round(detail,6)+0.0 AS detail FROM x_issues")
def stream_dq(d):
    """The issues of all bars, found as files arrive, equal those of the batch rules."""
    from .load import _spoiled

    w = flows.work_dir(d.spark, "dqbars")
    bars = _spoiled(d).select("symbol", "dt", "open", "high", "low", "close", "adj_close", "volume")
    ends = bars.agg(F.min("dt").alias("a"), F.max("dt").alias("b")).first()
    span = (ends.b - ends.a).days // BAR_FILES + 1
    late = (F.pmod(F.xxhash64("symbol", "dt"), F.lit(10)) == 0).cast("int")
    bars = cut(bars.withColumn("file", F.floor(F.datediff("dt", F.lit(ends.a)) / span) + late))
    for k in range(BAR_FILES + 1):
        bars.filter(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(f"{w}/in")
    marker = d.spark.range(1).select(*[F.lit(FAR).cast("date").alias(c) if c == "dt" else F.lit(None).cast(bars.schema[c].dataType).alias(c) for c in bars.columns if c != "file"])
    marker.coalesce(1).write.mode("append").parquet(f"{w}/in")
    schema = "symbol string, dt date, open double, high double, low double, close double, adj_close double, volume bigint"
    flows.stream_dq(flows.read_files(d.spark, f"{w}/in", schema), f"{w}/out", f"{w}/checkpoint", f"{2 * span} days")
    return rounded(d.spark.read.parquet(f"{w}/out"))


SCORED = "symbol string, dt date, y_prob double, ts timestamp"
OUTCOME = "symbol string, ts timestamp, ret_net double, win int"
CTES["x_sp"] = "SELECT symbol, dt, y_prob, fwd_ret_5d_net, y_true FROM x_pred WHERE model_name='gbm'"


def _scored(d):
    p = predictions(d, shared=True).filter("model_name = 'gbm'")
    return p.select("symbol", "dt", "y_prob", F.col("dt").cast("timestamp").alias("ts"), F.col("fwd_ret_5d_net").alias("ret_net"), F.col("y_true").cast("int").alias("win"))


@query("stream_predictions", f"SELECT symbol, dt, {r('y_prob')} FROM x_sp")
def stream_predictions(d):
    """Two streams deliver the same predictions into one table."""
    w = flows.work_dir(d.spark, "pred")
    _scored(d).select("symbol", "dt", "y_prob").write.parquet(f"{w}/scored")
    s = flows.read_files(d.spark, f"{w}/scored", "symbol string, dt date, y_prob double", per_trigger=4)
    for stream in ("a", "b"):
        flows.stream_predictions(s, f"{w}/table", f"{w}/checkpoint-{stream}")
    return rounded(flows.prediction_table(d.spark, f"{w}/table").read())


#: Predictions arrive in so many files; outcomes arrive a file later, some never.
SCORE_FILES = 6


@query(
    "stream_matured",
    """SELECT symbol, dt, round(y_prob,6)+0.0 AS y_prob, CASE WHEN day(dt) <> 17 THEN round(fwd_ret_5d_net,6)+0.0 END AS ret_net,
 CASE WHEN day(dt) <> 17 THEN CAST(y_true AS INTEGER) END AS win, CASE WHEN day(dt) = 17 THEN 'pending' ELSE 'matured' END AS status FROM x_sp""",
)
def stream_matured(d):
    """Outcomes come one micro-batch after their predictions; those of every 17th of a month never come."""
    w = flows.work_dir(d.spark, "matured")
    rows = _scored(d)
    ends = rows.agg(F.min("dt").alias("a"), F.max("dt").alias("b")).first()
    span = (ends.b - ends.a).days // SCORE_FILES + 1
    rows = cut(rows.withColumn("file", F.floor(F.datediff("dt", F.lit(ends.a)) / span)))
    far = [F.lit(FAR).cast("date").alias("dt"), F.lit(FAR).cast("timestamp").alias("ts")]
    marker = d.spark.range(1).select(F.lit("").alias("symbol"), *far, *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("y_prob", "ret_net", "win")])
    for k in range(SCORE_FILES + 2):
        p, o = rows.filter(F.col("file") == k), rows.filter((F.col("file") == k - 1) & (F.dayofmonth("dt") != 17))
        p = marker if k > SCORE_FILES else p
        o = marker if k > SCORE_FILES else o
        p.select("symbol", "dt", "y_prob", "ts").coalesce(1).write.mode("append").parquet(f"{w}/scored")
        o.select("symbol", "ts", "ret_net", "win").coalesce(1).write.mode("append").parquet(f"{w}/outcomes")
    s = flows.read_files(d.spark, f"{w}/scored", SCORED)
    o = flows.read_files(d.spark, f"{w}/outcomes", OUTCOME)
    flows.stream_matured(s, o, f"{w}/out", f"{w}/checkpoint", f"{2 * span} days")
    done = d.spark.read.parquet(f"{w}/out").filter("symbol <> ''")
    return rounded(done.select("symbol", F.col("ts").cast("date").alias("dt"), "y_prob", "ret_net", "win", "status"))
