"""Quality rules on arriving bars that need the bar before, which may arrive in any order within a delay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.quality import EXTREME_MOVE, GAP_DAYS

BAR = "day int, open double, high double, low double, close double, adj_close double, volume bigint"
ISSUES = "symbol string, day int, severity string, issue string, detail double"
DAY_MS = 86_400_000


class BarRules(StatefulProcessor):
    """State of a symbol: its last final bar, and the bars that are not final yet.

    A bar is final when the watermark has passed its session. Then the symbol's timer fires, final bars are judged in
    session order against the one before, and the last of them is kept for the next time. Of bars of one session the
    one that arrived last counts. A symbol has one timer per micro-batch, not one per bar, and its waiting bars are
    read and written together.
    """

    def __init__(self, limit: float = EXTREME_MOVE, days: int = GAP_DAYS):
        self.limit, self.days = limit, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", BAR)
        self.last = handle.getValueState("last", "day int, adj_close double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is not None:
            new = [
                (int(bar[0]), *map(float, bar[1:6]), int(bar[6]))
                for part in rows for bar in part[["day", "open", "high", "low", "close", "adj_close", "volume"]].itertuples(index=False, name=None)
            ]
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0] * DAY_MS + 1)  # the watermark is beyond the session
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bars = {bar[0]: bar for bar in self.waiting.get()} if self.waiting.exists() else {}
        final = sorted(d for d in bars if d * DAY_MS < timerValues.getCurrentWatermarkInMs())
        out = []
        if final:
            before = self.last.get() if self.last.exists() else None
            for day in final:
                bar = bars.pop(day)
                out += [(key[0], day, *x) for x in self.judged(bar, before)]
                before = day, bar[5]
            self.last.update(before)
            self.waiting.clear()
            if bars:
                self.waiting.put(list(bars.values()))
                self.handle.registerTimer(min(bars) * DAY_MS + 1)
        yield pd.DataFrame(out, columns=["symbol", "day", "severity", "issue", "detail"])

    def judged(self, bar: tuple, before: tuple | None) -> Iterator[tuple[str, str, float]]:
        """Issues of a bar, given the (day, adj_close) before it."""
        day, o, h, lo, c, adj, volume = bar
        if h < lo or h < o or h < c or lo > o or lo > c:
            yield "error", "ohlc_ordering", h - lo
        if volume == 0:
            yield "warn", "zero_volume", 0.0
        if before is not None:
            was, price = before
            if price > 0 and abs(adj / price - 1.0) > self.limit:
                yield "warn", "extreme_move", adj / price - 1.0
            if day - was > self.days:
                yield "warn", "calendar_gap", float(day - was)

    def close(self) -> None:
        pass


def bar_issues(bars: DataFrame, delay: str) -> DataFrame:
    """The issues of a stream of bars (symbol, dt, prices, volume), those of `quality.dq_issues` on all of them.

    Bars may come in any order as long as none is later than `delay` behind the newest one; Spark counts later ones
    (numRowsDroppedByWatermark) and leaves them out. Issues come out when the watermark has passed their
    session. A row without a symbol moves the watermark and nothing else. Needs the RocksDB state store. State is one
    bar per symbol plus the bars within the delay; a symbol has at most one bar per session.
    """
    day = F.datediff("dt", F.lit("1970-01-01").cast("date"))
    timed = bars.withColumns({"day": day, "ts": F.col("dt").cast("timestamp"), "volume": F.coalesce("volume", F.lit(0)).cast("bigint")})
    keyed = timed.withWatermark("ts", delay).groupBy("symbol")
    found = keyed.transformWithStateInPandas(BarRules(), ISSUES, "append", "eventTime")
    return found.select("symbol", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("dt"), "severity", "issue", "detail")
