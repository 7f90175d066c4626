"""Forward labels: row t reads rows after t of the same symbol only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COSTS, MARKET
from ..functions import sym_order


def forward_return(h: int, col: str = "adj_close"):
    a = F.col(col)
    return F.when(a > 0, F.lead(col, h).over(sym_order()) / a - 1.0)


def labels(ix: DataFrame, cost: float = COSTS.round_trip, horizon: int = 5) -> DataFrame:
    """Forward returns, the net binary label, worst and best excursion, next open."""
    ahead = sym_order().rowsBetween(1, horizon)
    a, net = F.col("adj_close"), forward_return(horizon) - cost
    lo, hi = F.min("low").over(ahead), F.max("high").over(ahead)
    return ix.select(
        "symbol",
        "dt",
        "day_index",
        forward_return(1).alias("fwd_ret_1d"),
        forward_return(5).alias("fwd_ret_5d"),
        forward_return(21).alias("fwd_ret_21d"),
        net.alias("fwd_ret_5d_net"),
        F.when(net.isNotNull(), (net > 0).cast("int")).alias("label_win_5d"),
        lo.alias("fwd_min_low_5d"),
        hi.alias("fwd_max_high_5d"),
        F.when(a > 0, lo / a - 1.0).alias("fwd_mae_5d"),
        F.when(a > 0, hi / a - 1.0).alias("fwd_mfe_5d"),
        F.lead("open", 1).over(sym_order()).alias("next_open"),
    )


def forward_excess(ix: DataFrame, horizons=(21, 63), market: str = MARKET) -> DataFrame:
    """Forward return of each stock minus the market's over the same sessions of the stock."""
    m = ix.filter(F.col("symbol") == market).select("dt", F.col("adj_close").alias("mkt"))
    p = ix.filter(F.col("symbol") != market).join(m, "dt", "left")
    return p.select(
        "symbol",
        "dt",
        "day_index",
        *[(forward_return(h) - forward_return(h, "mkt")).alias(f"fwd_{h}") for h in horizons],
    )


def model_rows(panel: DataFrame, labelled: DataFrame) -> DataFrame:
    """Rows fit for modelling: 200 bars of history, features and the label present."""
    l = labelled.select(
        "symbol", "dt", "fwd_ret_1d", "fwd_ret_5d", "fwd_ret_5d_net", "fwd_ret_21d", "label_win_5d",
        "fwd_mae_5d", "fwd_mfe_5d", "next_open",
    )
    return panel.filter("bar_num > 200").join(l, ["symbol", "dt"]).dropna(
        subset=["vol_20_annual", "mom_126d", "rel_volume", "mkt_ret_1d", "label_win_5d"]
    )
