"""Earnings announcements as signals.

An event group is one symbol's announcements, one per symbol and hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cut, lagged, sym_order
from . import asof, calendar, xsection
from .features import expanding_z, streak

DRIFT_WINDOW = 60
STALE_AFTER = 250
MIN_HISTORY = 4
SCORES = ("sue", "surprise_pct", "drift_window", "beat_streak", "surprise_accel", "days_since")


def event_features(events: DataFrame) -> DataFrame:
    """sue, beat_streak and surprise_accel from the symbol's earlier announcements."""
    order = ["tradeable_from", "announced_at"]
    e = events.filter(F.col("surprise_pct").isNotNull() & F.col("tradeable_from").isNotNull())
    e = e.withColumn("_o", F.row_number().over(Window.partitionBy("symbol").orderBy(*order)))
    e = expanding_z(e, "surprise_pct", "sue", order="_o", min_prior=MIN_HISTORY)
    e = streak(e, F.col("surprise_pct") > 0, "beat_streak", order="_o")
    return e.withColumn("surprise_accel", F.col("sue") - lagged("sue", order="_o")).drop("_o")


def attach(panel: DataFrame, events: DataFrame, cal: DataFrame) -> DataFrame:
    """The six announcement scores on every panel row; blank when older than 250 sessions."""
    ev = event_features(events)
    cols = ["sue", "surprise_pct", "beat_streak", "surprise_accel"]
    p = asof.asof_backward(panel, ev, "tradeable_from", cols, order=F.col("announced_at"))
    p = calendar.session_age(p, cal, "tradeable_from", "_age")
    fresh = ~(F.coalesce(F.col("_age") > STALE_AFTER, F.lit(False)))
    inside = F.coalesce(F.col("_age").between(0, DRIFT_WINDOW), F.lit(False))
    return p.select(
        *panel.columns,
        *[F.when(fresh, F.col(c)).alias(c) for c in cols],
        inside.cast("double").alias("drift_window"),
        (-F.col("_age")).alias("days_since"),
    )


def attach_reaction(panel: DataFrame, events: DataFrame, ix: DataFrame, cal: DataFrame) -> DataFrame:
    """Second version: surprise, the market's reaction on the event session, and their
    product of signs; only inside the drift window."""
    ret0 = ix.select(
        "symbol",
        F.col("dt").alias("tradeable_from"),
        (F.col("adj_close") / lagged("adj_close") - 1.0).alias("event_reaction"),
    )
    ev = event_features(events).join(ret0, ["symbol", "tradeable_from"], "left")
    cols = ["sue", "surprise_pct", "event_reaction"]
    p = asof.asof_backward(panel, ev, "tradeable_from", cols, order=F.col("announced_at"))
    p = calendar.session_age(p, cal, "tradeable_from", "age")
    inside = F.coalesce(F.col("age").between(0, DRIFT_WINDOW), F.lit(False))
    p = p.select(*panel.columns, *[F.when(inside, F.col(c)).alias(c) for c in cols], "age")
    return p.withColumn("sue_x_reaction", F.col("sue") * F.signum("event_reaction"))


def quality_tests(events: DataFrame, ix: DataFrame, drift: int = 60) -> DataFrame:
    """Does the surprise move the price: correlation with the event-session move, move and later drift of the fifth with
    the largest surprises less those of the fifth with the smallest, the move on event sessions against others, and the
    share of events with almost no move."""
    w = sym_order()
    px = ix.select(
        "symbol",
        "dt",
        (F.col("adj_close") / lagged("adj_close") - 1.0).alias("move"),
        (F.lead("adj_close", drift).over(w) / F.col("adj_close") - 1.0).alias("drift"),
    )
    ev = events.groupBy("symbol", F.col("tradeable_from").alias("dt")).agg(
        F.max_by("surprise_pct", "announced_at").alias("surprise_pct")
    )
    j = px.join(ev, ["symbol", "dt"], "left").filter("move is not null")
    hit = F.col("surprise_pct").isNotNull()
    j = cut(j)
    fifth = j.filter(hit).withColumns({"_all": F.lit(1), "_key": F.concat("symbol", F.lit("|"), "dt")})
    fifth = xsection.with_bucket(fifth, ["_all"], "surprise_pct", 5, tie="_key")
    edge = lambda c: F.avg(F.when(F.col("bucket") == F.col("top_bucket"), F.col(c))) - F.avg(F.when(F.col("bucket") == 0, F.col(c)))
    ends = fifth.agg(edge("move").alias("move_spread"), edge("drift").alias("drift_spread")).withColumn("_j", F.lit(1))
    a = j.agg(
        F.count(F.when(hit, 1)).alias("events"),
        F.corr(F.when(hit, F.col("surprise_pct")), F.col("move")).alias("surprise_move_corr"),
        F.corr(F.when(hit & F.col("drift").isNotNull(), F.col("surprise_pct")), F.col("drift"))
        .alias("surprise_drift_corr"),
        F.stddev_samp(F.when(hit, F.col("move"))).alias("_e"),
        F.stddev_samp(F.when(~hit, F.col("move"))).alias("_o"),
        F.avg(F.when(hit, (F.abs("move") < 0.005).cast("int"))).alias("share_near_zero"),
    )
    a = a.withColumn("event_vol_ratio", F.try_divide("_e", "_o")).drop("_e", "_o")
    return a.withColumn("_j", F.lit(1)).join(ends, "_j").drop("_j")
