"""As-of joins: the latest event known at each row's date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(
    panel: DataFrame, events: DataFrame, known: str, cols, by=("symbol",), dt="dt", order: Column | None = None
) -> DataFrame:
    """Attach `cols` of the latest event with known <= dt (same day counts).

    Events are first reduced to one per (by, known) - the one with the greatest
    `order` - so a group holds at most one event per day plus the panel rows.
    The join is a union and a running `last`: one shuffle, no range join.
    """
    by, cols = list(by), list(cols)
    body = F.struct(F.col(known).alias(known), *[F.col(c) for c in cols if c != known])
    pick = F.max_by(body, order) if order is not None else F.max(body)
    ev = (
        events.filter(F.col(known).isNotNull())
        .groupBy(*by, F.col(known).alias("_t"))
        .agg(pick.alias("_e"))
    )
    rest = [c for c in panel.columns if c not in by]
    left = panel.select(*by, F.col(dt).alias("_t"), F.lit(1).alias("_side"), F.struct(*rest).alias("_p"))
    both = left.unionByName(ev.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("_e", F.last("_e", ignorenulls=True).over(w)).filter("_side = 1")
    return hit.select(
        *by,
        *[F.col("_p")[c].alias(c) for c in rest],
        *[F.col("_e")[c].alias(c) for c in dict.fromkeys([known, *cols]) if c not in panel.columns],
    )


def trailing_sums(
    panel: DataFrame, events: DataFrame, at: str, sums, sessions: int = 90, by=("symbol",), dt="day_index"
) -> DataFrame:
    """Sums of event columns over session indexes [dt - sessions, dt], both ends included."""
    by, sums = list(by), list(sums)
    ev = (
        events.filter(F.col(at).isNotNull())
        .groupBy(*by, F.col(at).alias(dt))
        .agg(*[F.sum(c).alias("_s_" + c) for c in sums])
    )
    rest = [c for c in panel.columns if c not in (*by, dt)]
    left = panel.select(*by, dt, F.struct(F.lit(1).alias("_is"), *rest).alias("_p"))
    both = left.unionByName(ev, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(dt).rangeBetween(-sessions, 0)
    out = both.select(
        *by, dt, "_p", *[F.coalesce(F.sum("_s_" + c).over(w), F.lit(0)).alias(c) for c in sums]
    ).filter(F.col("_p").isNotNull())
    return out.select(*by, dt, *[F.col("_p")[c].alias(c) for c in rest], *sums)
