"""Event studies: abnormal returns around events, and their placebo."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MARKET
from ..functions import lagged, sym_order, uniform


def abnormal_returns(ix: DataFrame, market: str = MARKET) -> DataFrame:
    """(symbol, dt, pos, n, abn): return minus the market's, and the position of the
    session in the symbol's own history."""
    m = ix.filter(F.col("symbol") == market).select(
        "dt", (F.col("adj_close") / lagged("adj_close") - 1.0).alias("mkt")
    )
    w = sym_order()
    s = ix.filter(F.col("symbol") != market).select(
        "symbol",
        "dt",
        (F.row_number().over(w) - 1).alias("pos"),
        F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n"),
        (F.col("adj_close") / lagged("adj_close") - 1.0).alias("ret"),
    )
    return s.join(m, "dt", "left").select("symbol", "dt", "pos", "n", (F.col("ret") - F.col("mkt")).alias("abn"))


def anchors(events: DataFrame, px: DataFrame, symbol: str = "symbol", date: str = "event_dt") -> DataFrame:
    """Events counted per (symbol, session position); repeated events keep their weight."""
    e = events.groupBy(F.col(symbol).alias("symbol"), F.col(date).alias("dt")).agg(
        F.count(F.lit(1)).alias("weight")
    )
    return e.join(px.select("symbol", "dt", "pos"), ["symbol", "dt"]).select("symbol", "pos", "weight")


def event_time(anchored: DataFrame, px: DataFrame, lo: int, hi: int) -> DataFrame:
    """One row per anchor and k in [lo, hi] that has an abnormal return.

    Anchors are distinct sessions, so the expansion is bounded by sessions times
    the window, whatever the number of events.
    """
    k = F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("k")
    e = anchored.select("symbol", F.col("pos").alias("anchor"), "weight", k)
    p = px.filter("abn is not null").select("symbol", F.col("pos").alias("at"), "abn")
    e = e.withColumn("at", F.col("anchor") + F.col("k"))
    return e.join(p, ["symbol", "at"]).select("symbol", "anchor", "k", "weight", "abn")


def car(timed: DataFrame) -> DataFrame:
    """Mean abnormal return by k and its running sum from the first k."""
    m = timed.groupBy("k").agg(
        F.sum("weight").alias("n"),
        F.try_divide(F.sum(F.col("weight") * F.col("abn")), F.sum("weight")).alias("mean_abn"),
    )
    # one row per k: the window length is a parameter
    run = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return m.withColumn("car", F.sum("mean_abn").over(run))


def placebo_anchors(events: DataFrame, px: DataFrame, lo: int, hi: int, salt: str = "placebo") -> DataFrame:
    """As many random sessions per symbol as it has events, away from both ends.

    `events` needs a unique `event_id`; the pick is a hash of it.
    """
    n = px.groupBy("symbol").agg(F.max("n").alias("n"))
    start, pool = F.lit(abs(lo)), F.col("n") - hi - 1 - abs(lo)
    usable = F.col("n") > abs(lo) + hi + 2
    e = events.join(n, "symbol").withColumn("_u", uniform(F.lit(salt), "event_id"))
    pos = F.when(usable, start + F.floor(F.col("_u") * pool)).otherwise(F.floor(F.col("_u") * F.col("n")))
    return e.withColumn("pos", pos.cast("int")).groupBy("symbol", "pos").agg(F.count(F.lit(1)).alias("weight"))


# fixed values: windows of the membership study, in sessions from the event
WINDOWS = (
    (-250, -126), (-125, -64), (-63, -22), (-21, -6), (-5, -1), (0, 0), (0, 5), (1, 10), (1, 21), (1, 63),
)


def window_table(timed: DataFrame, by=("side",), windows=WINDOWS) -> DataFrame:
    """Summed abnormal return per event and window, averaged per event date, with t over dates."""
    by = list(by)
    w = F.explode(
        F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in windows])
    ).alias("w")
    e = timed.select("*", w).filter(F.col("k").between(F.col("w.lo"), F.col("w.hi")))
    per_event = e.groupBy(*by, "event_dt", "symbol", "w.lo", "w.hi").agg(F.sum("abn").alias("abn"))
    per_date = per_event.groupBy(*by, "event_dt", "lo", "hi").agg(
        F.avg("abn").alias("abn"), F.count(F.lit(1)).alias("m")
    )
    return per_date.groupBy(*by, "lo", "hi").agg(
        F.count(F.lit(1)).alias("dates"),
        F.sum("m").alias("events"),
        F.avg("abn").alias("mean_abn"),
        F.try_divide(F.avg("abn"), F.stddev_samp("abn") / F.sqrt(F.count(F.lit(1)))).alias("t"),
    )


def hedged_short(ix: DataFrame, events: DataFrame, hold: int = 10, cost: float = 0.0014) -> DataFrame:
    """Short each addition at the event close, long the market, for `hold` sessions."""
    w = sym_order()
    f = ix.select("symbol", "dt", (F.lead("adj_close", hold).over(w) / F.col("adj_close") - 1.0).alias("f"))
    m = f.filter(F.col("symbol") == MARKET).select("dt", F.col("f").alias("m"))
    e = events.select("symbol", F.col("event_dt").alias("dt")).distinct()
    r = e.join(f, ["symbol", "dt"]).join(m, "dt").filter("f is not null and m is not null")
    return r.select("symbol", "dt", (F.col("m") - F.col("f") - 2 * cost).alias("ret"))
