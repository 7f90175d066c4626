"""Insider trades and short interest as signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import asof

LOOKBACK = 90
# fixed values: the sign under which a high value is attractive
SIGNS = {
    "insider_buy_intensity": 1,
    "insider_net_flow": 1,
    "insider_buyer_breadth": 1,
    "short_ratio": -1,
    "short_change": -1,
    "days_to_cover": -1,
}
SIGNALS = tuple(SIGNS)
# fixed values: trades on the open market; grants, gifts and other codes say nothing about a price
PURCHASE, SALE = "P", "S"


def value_at_market(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Purchases and sales priced at the close of their day; unmatched, empty or back-dated ones and other codes drop."""
    trades = trades.filter(F.col("trans_code").isin(PURCHASE, SALE))
    px = bars.select("symbol", F.col("dt").alias("trans_date"), F.col("close").alias("mkt_price"))
    t = trades.join(px, ["symbol", "trans_date"]).withColumn("usd", F.col("shares") * F.col("mkt_price"))
    return t.filter("usd > 0 and shares > 0 and filing_date >= trans_date")


def insider_flows(panel: DataFrame, trades: DataFrame, cal: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Dollars bought and sold and number of purchases over the last 90 sessions, by the
    session on which they were filed; filings on other days do not count."""
    c = cal.select(F.col("dt").alias("filing_date"), F.col("day_index").alias("fi"))
    buy, sell = F.col("trans_code") == PURCHASE, F.col("trans_code") == SALE
    ev = trades.join(c, "filing_date").select(
        "symbol",
        "fi",
        F.when(buy, F.col("usd")).otherwise(0.0).alias("buy_usd"),
        F.when(sell, F.col("usd")).otherwise(0.0).alias("sell_usd"),
        buy.cast("bigint").alias("n_buys"),
    )
    return asof.trailing_sums(panel, ev, "fi", ["buy_usd", "sell_usd", "n_buys"], lookback)


def attach(panel: DataFrame, trades: DataFrame, short: DataFrame, cal: DataFrame) -> DataFrame:
    """The six signed signals; needs adv and day_index.  `short` carries tradeable_from."""
    p = insider_flows(panel, trades, cal)
    p = asof.asof_backward(
        p, short, "tradeable_from", ["short_shares", "prev_short", "avg_daily_vol", "days_to_cover"],
        order=F.col("settlement_date"),
    )
    scale = F.col("adv") * LOOKBACK
    raw = {
        "insider_buy_intensity": F.try_divide(F.col("buy_usd"), scale),
        "insider_net_flow": F.try_divide(F.col("buy_usd") - F.col("sell_usd"), scale),
        "insider_buyer_breadth": F.col("n_buys").cast("double"),
        "short_ratio": F.try_divide(F.col("short_shares"), F.col("avg_daily_vol") * 21),
        "short_change": F.try_divide(F.col("short_shares") - F.col("prev_short"), F.col("prev_short")),
        "days_to_cover": F.col("days_to_cover"),
    }
    return p.select(*panel.columns, *[(SIGNS[k] * v).alias(k) for k, v in raw.items()])
