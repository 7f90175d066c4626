"""Point-in-time features: row t reads rows up to t of the same symbol only.

All windows share one partitioning and order, so the whole layer is one shuffle
and one sort.  A group is one symbol's sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MARKET, TRADING_DAYS
from ..functions import cut, full, lagged, ratio, rows_back, sym_order
from ..functions.frames import LONG, trailing, trailing_mean
from . import ranking


def _change(col, n: int = 1):
    prev = lagged(col, n)
    return F.when(prev > 0, F.col(col) / prev - 1.0)


def returns(ix: DataFrame) -> DataFrame:
    """Adds ret_1d, gap_pct, range_pct."""
    pc = lagged("close")
    return ix.select(
        "*",
        _change("adj_close").alias("ret_1d"),
        F.when(pc > 0, F.col("open") / pc - 1.0).alias("gap_pct"),
        F.when(F.col("low") > 0, (F.col("high") - F.col("low")) / F.col("low")).alias("range_pct"),
    )


def moving_averages(ix: DataFrame, spans=(20, 50, 200), col="adj_close") -> DataFrame:
    """Trailing means; partial windows at the start count."""
    d = ix.select("*", *[F.avg(col).over(rows_back(n)).alias(f"sma_{n}") for n in spans if n < LONG])
    for n in spans:
        if n >= LONG:
            d = trailing_mean(d, n, col, f"sma_{n}")
    return d


def volume_ratio(ix: DataFrame, n: int = 20) -> DataFrame:
    avg = F.avg("volume").over(rows_back(n))
    return ix.select(
        "*", avg.alias(f"vol_avg_{n}"), F.when(avg > 0, F.col("volume") / avg).alias("rel_volume")
    )


def extremes(ix: DataFrame, n: int = 252, prior: int = 20) -> DataFrame:
    """Trailing extremes with today, prior extremes without, and distances."""
    hi, lo = F.col(f"high_{n}"), F.col(f"low_{n}")
    return trailing(ix, n, {f"high_{n}": ("max", "high"), f"low_{n}": ("min", "low")}).select(
        "*",
        F.max("high").over(rows_back(prior, 1)).alias(f"prior_high_{prior}"),
        F.min("low").over(rows_back(prior, 1)).alias(f"prior_low_{prior}"),
        F.when(hi > 0, F.col("adj_close") / hi - 1.0).alias("dist_52w_high"),
        F.when(lo > 0, F.col("adj_close") / lo - 1.0).alias("dist_52w_low"),
    )


def realised_vol(ret: DataFrame, n: int = 20) -> DataFrame:
    """Annualised population deviation of returns; needs n returns and some variance."""
    w = rows_back(n)
    sd = F.stddev_pop("ret_1d").over(w)
    ok = (F.count("ret_1d").over(w) >= n) & (sd > 0)
    return ret.withColumn(f"vol_{n}_annual", F.when(ok, sd * F.sqrt(F.lit(float(TRADING_DAYS)))))


def true_range_col(first_bar_null: bool = True):
    """Largest of three ranges; on the first bar either null or high - low."""
    pc = lagged("close")
    hl = F.col("high") - F.col("low")
    wide = F.greatest(hl, F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    return F.when(pc.isNull(), F.lit(None) if first_bar_null else hl).otherwise(wide)


def average_true_range(ix: DataFrame, n: int = 14) -> DataFrame:
    t = ix.withColumn("true_range", true_range_col())
    t = t.withColumn(f"atr_{n}", full(F.avg("true_range"), "true_range", n))
    ok = (F.col(f"atr_{n}") > 0) & (F.col("close") > 0)
    return t.withColumn("atr_pct", F.when(ok, F.col(f"atr_{n}") / F.col("close")))


def momentum(ix: DataFrame, spans=(5, 21, 63, 126)) -> DataFrame:
    return ix.select("*", *[_change("adj_close", n).alias(f"mom_{n}d") for n in spans])


def trend_flags(ma: DataFrame) -> DataFrame:
    """Distances to the averages, regime flags and the bar number."""

    def dist(n):
        s = F.col(f"sma_{n}")
        return F.when(s > 0, F.col("adj_close") / s - 1.0).alias(f"dist_sma_{n}")

    return ma.select(
        "*",
        *[dist(n) for n in (20, 50, 200)],
        F.when(F.col("sma_50") > F.col("sma_200"), 1).otherwise(0).alias("regime_bull"),
        F.when(F.col("adj_close") > F.col("sma_200"), 1).otherwise(0).alias("above_200"),
        F.row_number().over(sym_order()).alias("bar_num"),
    )


# fixed values: column names
FEATURES = (
    "symbol", "dt", "day_index", "sector", "kind", "bar_num", "open", "high", "low", "close", "adj_close",
    "volume", "ret_1d", "gap_pct", "range_pct", "sma_20", "sma_50", "sma_200", "atr_14", "vol_20_annual",
    "dist_sma_20", "dist_sma_50", "dist_sma_200", "rel_volume", "dist_52w_high", "dist_52w_low", "atr_pct",
    "prior_high_20", "prior_low_20", "mom_5d", "mom_21d", "mom_63d", "mom_126d", "regime_bull", "above_200",
)


def features(ix: DataFrame) -> DataFrame:
    """The whole feature layer."""
    f = returns(ix)
    f = trend_flags(moving_averages(f))
    f = extremes(volume_ratio(f))
    f = momentum(average_true_range(realised_vol(f)))
    return f.select(*FEATURES)


def market_state(feats: DataFrame, symbol: str = MARKET) -> DataFrame:
    return feats.filter(F.col("symbol") == symbol).select(
        "dt",
        F.col("ret_1d").alias("mkt_ret_1d"),
        F.col("vol_20_annual").alias("mkt_vol_20"),
        F.col("dist_sma_200").alias("mkt_dist_sma_200"),
        F.col("regime_bull").alias("mkt_regime_bull"),
    )


XS_RANKS = {
    "mom_21d": "mom_21d_xs_rank",
    "rel_volume": "rel_volume_xs_rank",
    "vol_20_annual": "vol_20_xs_rank",
}


def feature_panel(feats: DataFrame, market: DataFrame, width: int | None = None) -> DataFrame:
    """Stocks with the market state of the date and three per-date percent ranks."""
    p = feats.filter(F.col("kind") == "stock").join(market, "dt", "left")
    for col, out in XS_RANKS.items():
        p = ranking.percent_rank(p, ["dt"], col, out, width)
    return p


# ---------------------------------------------------------------- study panel
def research_panel(ix: DataFrame, horizons=(21,), market: str = MARKET) -> DataFrame:
    """Factors and forward returns for cross-sectional studies (full windows)."""
    mkt = (
        ix.filter(F.col("symbol") == market)
        .select("dt", "day_index", "symbol", "adj_close")
        .select("dt", (F.col("adj_close") / lagged("adj_close") - 1.0).alias("mkt"))
    )
    # one row per session, stored: the join with it leaves the rows where their symbol's windows need them
    p = ix.filter(F.col("kind") == "stock").join(cut(mkt), "dt", "left")
    a = F.col("adj_close")
    p = p.withColumn("ret", a / lagged("adj_close") - 1.0).withColumn(
        "_usd", F.col("close") * F.col("volume")
    )
    p = p.select(
        "*",
        full(F.avg("_usd"), "_usd", 20).alias("adv"),
        full(F.stddev_samp("ret"), "ret", 63, 40).alias("vol63"),
        (a / lagged("adj_close", 126) - 1.0).alias("mom126"),
        (a / lagged("adj_close", 252) - 1.0).alias("mom252"),
        (-(a / lagged("adj_close", 5) - 1.0)).alias("reversal5"),
        *[(F.lead("adj_close", h).over(sym_order()) / a - 1.0).alias(f"fwd_{h}") for h in horizons],
    ).drop("_usd")
    p = _trailing_beta(p, 252, 120)
    return p.withColumn("size", size_col()).withColumn("half_bps", half_spread_bps())


def _trailing_beta(p: DataFrame, n: int, need: int) -> DataFrame:
    """Adds beta: covariance of ret with mkt over the variance of mkt in the last n rows, each from `need` values on.

    Both come from sums over the frame; daily returns are small against their spread, so nothing cancels.
    """
    both = F.col("ret").isNotNull() & F.col("mkt").isNotNull()
    x, y = F.when(both, F.col("ret")), F.when(both, F.col("mkt"))
    d = trailing(p, n, {
        "_k": ("count", x), "_x": ("sum", x), "_y": ("sum", y), "_xy": ("sum", x * y),
        "_m": ("count", "mkt"), "_z": ("sum", "mkt"), "_zz": ("sum", F.col("mkt") * F.col("mkt")),
    })
    cov = F.when(F.col("_k") >= need, (F.col("_xy") - F.col("_x") * F.col("_y") / F.col("_k")) / (F.col("_k") - 1))
    var = F.when(F.col("_m") >= need, (F.col("_zz") - F.col("_z") * F.col("_z") / F.col("_m")) / (F.col("_m") - 1))
    return d.withColumn("beta", ratio(cov, var)).drop("_k", "_x", "_y", "_xy", "_m", "_z", "_zz")


def size_col(adv="adv"):
    return F.log(F.greatest(F.col(adv), F.when(F.col(adv).isNotNull(), F.lit(1e5))))


# fixed values of the liquidity cost model
REF_ADV_USD = 212e6
REF_HALF_BPS = 2.0
TICK = 0.01
MIN_HALF_BPS, MAX_HALF_BPS = 1.0, 150.0


def half_spread_bps(price="close", adv="adv"):
    """Half spread in basis points from dollar volume, with a one-tick floor."""
    known = F.col(adv).isNotNull()
    liquid = REF_HALF_BPS * (REF_ADV_USD**0.5) / F.sqrt(F.greatest(F.col(adv), F.lit(1e5)))
    tick = (0.5 * TICK / F.greatest(F.col(price), F.lit(1.0))) * 10_000
    clipped = F.least(F.greatest(liquid, tick, F.lit(MIN_HALF_BPS)), F.lit(MAX_HALF_BPS))
    return F.when(known, clipped)


# ------------------------------------------------------------ other histories
def overnight_intraday(ix: DataFrame) -> DataFrame:
    """Where the return is earned: per symbol, overnight against intraday legs."""
    pc = lagged("close")
    p = ix.select(
        "symbol",
        F.when(pc > 0, F.col("open") / pc - 1.0).alias("overnight"),
        F.when(pc > 0, F.col("close") / F.col("open") - 1.0).alias("intraday"),
    ).filter("overnight is not null")
    y = float(TRADING_DAYS)
    agg = [F.count(F.lit(1)).alias("n")]
    for leg in ("overnight", "intraday"):
        agg += [
            (F.avg(leg) * y).alias(leg + "_ann"),
            (F.stddev_samp(leg) * y**0.5).alias(leg + "_vol"),
        ]
    a = p.groupBy("symbol").agg(*agg)
    for leg in ("overnight", "intraday"):
        a = a.withColumn(leg + "_sharpe", ratio(leg + "_ann", leg + "_vol"))
    total = F.col("overnight_ann") + F.col("intraday_ann")
    var = F.pow("overnight_vol", F.lit(2)) + F.pow("intraday_vol", F.lit(2))
    return (
        a.withColumn("overnight_share", ratio(F.col("overnight_ann"), total))
        .withColumn("overnight_var_share", ratio(F.pow("overnight_vol", F.lit(2)), var))
        .withColumn("breakeven_half_bps", F.col("overnight_ann") / y / 2 * 10_000)
    )


def market_regimes(ix: DataFrame, market: str = MARKET, min_obs: int = 250) -> DataFrame:
    """Market above its 200-session mean, and volatility against its own past.

    The thresholds are expanding quantiles of earlier sessions only.
    """
    m = ix.filter(F.col("symbol") == market).select("symbol", "dt", "day_index", "adj_close")
    m = m.withColumn("ret", F.col("adj_close") / lagged("adj_close") - 1.0)
    m = trailing_mean(m, 200, "adj_close", "sma_200", need=200)
    m = m.select(
        "*",
        (full(F.stddev_samp("ret"), "ret", 63) * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("vol63"),
    )
    past = sym_order().rowsBetween(Window.unboundedPreceding, -1)
    seen = F.count("vol63").over(past) >= min_obs
    hi = F.when(seen, F.percentile("vol63", F.lit(0.667)).over(past))
    lo = F.when(seen, F.percentile("vol63", F.lit(0.333)).over(past))
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return m.select(
        "dt",
        flag(F.col("adj_close") > F.col("sma_200")).alias("above"),
        flag(F.col("vol63") > hi).alias("vol_hi"),
        flag(F.col("vol63") < lo).alias("vol_lo"),
        "vol63",
    )


def drawdown(curve: DataFrame, by, value: str = "equity", order: str = "dt") -> DataFrame:
    """Running peak and the fall from it."""
    w = sym_order(by, order).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(value).over(w)
    return curve.withColumn("peak", peak).withColumn(
        "drawdown", ratio(F.col("peak") - F.col(value), F.col("peak"))
    )


def expanding_z(df: DataFrame, col: str, out: str, by="symbol", order="dt", min_prior: int = 4) -> DataFrame:
    """(x - mean of earlier rows) / deviation of earlier rows."""
    past = sym_order(by, order).rowsBetween(Window.unboundedPreceding, -1)
    z = ratio(F.col(col) - F.avg(col).over(past), F.stddev_samp(col).over(past))
    return df.withColumn(out, F.when(F.count(col).over(past) >= min_prior, z))


def streak(df: DataFrame, positive, out: str, by="symbol", order="dt", cap: int = 8) -> DataFrame:
    """Length of the current run of positive rows, at most `cap`."""
    w = sym_order(by, order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_pos", F.coalesce(positive, F.lit(False)).cast("int"))
    df = df.withColumn("_island", F.sum(1 - F.col("_pos")).over(run))
    by = [by] if isinstance(by, str) else list(by)
    inside = Window.partitionBy(*by, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.least(F.sum("_pos").over(inside), F.lit(cap)).cast("int")).drop(
        "_pos", "_island"
    )


def ffill(df: DataFrame, cols, by="symbol", order="dt") -> DataFrame:
    w = sym_order(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
