"""Trading calendar, sessions and the joins that move dates onto sessions.

Calendar-wide windows hold one row per date; their size is the number of days
between the first and the last bar, whatever the number of bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MARKET
from ..functions import cut, dealt


def trading_calendar(bars: DataFrame) -> DataFrame:
    """Distinct bar dates with a dense index from 0 (dow: 0 = Sunday).

    Stored, so that its size is known and a join with it does not shuffle the bars.
    """
    d = bars.select("dt").distinct()
    days = d.select(
        "dt",
        (F.row_number().over(Window.orderBy("dt")) - 1).alias("day_index"),
        F.year("dt").alias("year"),
        F.month("dt").alias("month"),
        (F.dayofweek("dt") - 1).alias("dow"),
    )
    return cut(days)


def index_bars(bars: DataFrame, calendar: DataFrame, symbols: DataFrame, rows: int | None = None) -> DataFrame:
    """Bars with their session index, sector and kind; unknown symbols drop out.

    With `rows`, the number of bars, symbols are dealt over as many tasks as keep the windows that follow small.
    """
    days = bars.join(calendar.select("dt", "day_index"), "dt")
    return dealt(days, rows, "symbol").join(symbols.select("symbol", "sector", "kind"), "symbol")


def snap_forward(
    rows: DataFrame, sessions: DataFrame, date: str, out: str, by=(), strict: str | None = None
) -> DataFrame:
    """Move `date` to the first session on or after it (after it where `strict` is true).

    `sessions` is (by..., dt[, day_index]).  Only distinct (by, date) keys are
    windowed, so a symbol with very many rows does not make a large group.
    Rows after the last session get null.
    """
    by = list(by)
    ask = F.col(date) if strict is None else F.date_add(F.col(date), F.col(strict).cast("int"))
    rows = rows.withColumn("_ask", ask)
    keys = rows.select(*by, F.col("_ask").alias("d")).distinct().filter(F.col("d").isNotNull())
    pay = F.struct([c for c in sessions.columns if c not in by])
    both = keys.select(
        *by, "d", F.lit(1).alias("asks"), F.lit(None).cast(sessions.select(pay).schema[0].dataType).alias("s")
    ).unionByName(sessions.select(*by, F.col("dt").alias("d"), F.lit(0).alias("asks"), pay.alias("s")))
    w = (
        Window.partitionBy(*by)
        .orderBy(F.col("d").desc(), F.col("asks"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    snapped = (
        both.withColumn("s", F.last("s", ignorenulls=True).over(w))
        .filter("asks = 1")
        .select(*by, F.col("d").alias("_ask"), F.col("s").alias("_s"))
    )
    joined = rows.join(snapped, [*by, "_ask"], "left")
    cols = [joined["_s.dt"].alias(out)]
    if "day_index" in sessions.columns:
        cols.append(joined["_s.day_index"].alias(out + "_index"))
    return joined.select(*[c for c in rows.columns if c != "_ask"], *cols)


def resolve_tradeable_from(
    events: DataFrame, calendar: DataFrame, at: str = "announced_at", close_hour: int = 16, zone: str | None = None
) -> DataFrame:
    """Session on which an announcement can first be traded.

    At or after the close it is the first session strictly after the day,
    otherwise the first session on or after it.  `zone` converts instants.
    """
    local = F.col(at) if zone is None else F.from_utc_timestamp(F.col(at), zone)
    e = events.withColumn("_day", local.cast("date")).withColumn("_late", F.hour(local) >= close_hour)
    return snap_forward(e, calendar.select("dt"), "_day", "tradeable_from", strict="_late").drop(
        "_day", "_late"
    )


def lag_sessions(
    rows: DataFrame, calendar: DataFrame, date: str, out: str, sessions: int = 10
) -> DataFrame:
    """The session `sessions` after the first session on or after `date`; rows whose
    target lies past the calendar drop out."""
    snapped = snap_forward(rows, calendar.select("dt", "day_index"), date, "_on")
    later = calendar.select((F.col("day_index") - sessions).alias("_on_index"), F.col("dt").alias(out))
    return snapped.join(later, "_on_index").drop("_on_index", "_on")


def session_age(rows: DataFrame, calendar: DataFrame, since: str, out: str, dt: str = "dt") -> DataFrame:
    """Sessions between `since` and `dt` by calendar index."""
    c = calendar.select("dt", "day_index")
    a = c.select(F.col("dt").alias(dt), F.col("day_index").alias("_a"))
    b = c.select(F.col("dt").alias(since), F.col("day_index").alias("_b"))
    return rows.join(a, dt, "left").join(b, since, "left").withColumn(out, F.col("_a") - F.col("_b")).drop(
        "_a", "_b"
    )


def market_only(df: DataFrame, symbol: str = MARKET) -> DataFrame:
    return df.filter(F.col("symbol") == symbol)
