"""Rule signals and continuous scores as Column expressions over one symbol window.

RULES and SCORES are open registries: add a name with `register_rule` or
`register_score`, or a per-symbol pandas function with `register_grouped`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import full, lagged, ratio, rows_back, sym_order
from ..functions.frames import trailing, trailing_mean
from . import smoothing
from .features import true_range_col

def _px():
    """open, high, low, close, adjusted close, volume"""
    return [F.col(c) for c in ("open", "high", "low", "close", "adj_close", "volume")]


def _base(ix: DataFrame) -> DataFrame:
    """Full-window indicators that the rules compare."""
    _, _, _, C, _, V = _px()
    enough = lambda n: F.col("_bar") >= n

    def over(agg, n, end=0):
        return F.when(F.col("_bar") >= n + end, agg.over(rows_back(n, end)))

    d = ix.withColumn("_bar", F.row_number().over(sym_order()))
    d = trailing_mean(trailing_mean(d, 100, "adj_close", "_m100"), 200, "adj_close", "_m200")
    d = trailing(d, 252, {"_high": ("max", "high")})
    d = d.select(
        "*",
        *[over(F.avg("adj_close"), n).alias(f"m{n}") for n in (20, 50)],
        *[F.when(enough(n), F.col(f"_m{n}")).alias(f"m{n}") for n in (100, 200)],
        over(F.stddev_samp("adj_close"), 20).alias("s20"),
        over(F.min("low"), 14).alias("lo14"),
        over(F.max("high"), 14).alias("hi14"),
        over(F.min("low"), 20).alias("lo20"),
        *[over(F.max("high"), n, 1).alias(f"prior{n}") for n in (20, 55)],
        F.when(enough(253), lagged("_high")).alias("prior252"),
        F.when(enough(20), ratio(V, F.avg("volume").over(rows_back(20)))).alias("relvol"),
    ).drop("_m100", "_m200", "_high")
    d = d.withColumn("stoch", 100 * ratio(C - F.col("lo14"), F.col("hi14") - F.col("lo14")))
    d = d.withColumn("_fall", F.col("adj_close") < lagged("adj_close"))
    return smoothing.rsi(smoothing.macd(d), "adj_close", "rsi14")


def bollinger(ix: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    m = full(F.avg("adj_close"), "adj_close", n)
    s = full(F.stddev_samp("adj_close"), "adj_close", n)
    return ix.select("*", m.alias("bb_mid"), (m + k * s).alias("bb_up"), (m - k * s).alias("bb_low"))


def bollinger_squeeze(ix: DataFrame, n: int = 20, look: int = 120) -> DataFrame:
    """Band width at or below the 10 % quantile of its own last `look` values."""
    m = full(F.avg("adj_close"), "adj_close", n)
    s = full(F.stddev_samp("adj_close"), "adj_close", n)
    d = ix.withColumn("bb_width", ratio(4.0 * s, m))
    q = full(F.percentile("bb_width", F.lit(0.10)), "bb_width", look)
    return d.withColumn("squeeze", F.coalesce((F.col("bb_width") <= q).cast("int"), F.lit(0)))


def stochastic_k(ix: DataFrame, n: int = 14) -> DataFrame:
    lo, hi = full(F.min("low"), "low", n), full(F.max("high"), "high", n)
    return ix.withColumn("stoch_k", 100 * ratio(F.col("close") - lo, hi - lo))


def _c(name: str) -> Column:
    return F.col(name)


def _up_through(a: Column, b: Column) -> Column:
    return (a > b) & (lagged(a) <= lagged(b))


def _down_through(a: Column, b: Column) -> Column:
    return (a < b) & (lagged(a) >= lagged(b))


FAMILIES: dict[str, tuple[str, ...]] = {
    "average": (
        "golden_cross_50_200", "golden_cross_20_100", "death_cross_50_200", "above_sma_200",
        "above_sma_50", "cross_above_sma_50", "cross_above_sma_20", "ma_ribbon_aligned",
        "ema_cross_12_26",
    ),
    "oscillator": (
        "rsi_oversold_30", "rsi_oversold_20", "rsi_overbought_70", "rsi_cross_50",
        "macd_cross_up", "macd_hist_positive", "stochastic_oversold",
    ),
    "breakout": (
        "bollinger_lower_touch", "bollinger_upper_break", "donchian_break_20",
        "donchian_break_55", "new_52w_high", "resistance_break_volume", "support_bounce",
        "pullback_to_sma50",
    ),
    "candle": (
        "bullish_engulfing", "bearish_engulfing", "hammer", "shooting_star", "doji",
        "morning_star", "three_white_soldiers", "inside_bar", "outside_bar_up",
    ),
    "gap_volume": ("gap_up_2pct", "gap_down_2pct", "volume_spike_up", "volume_dryup"),
    "reversion": (
        "three_down_days", "big_down_day", "extreme_below_sma20", "oversold_in_uptrend",
    ),
}


def _rules() -> dict[str, Column]:
    m20, m50, m100, m200, s20 = (_c(x) for x in ("m20", "m50", "m100", "m200", "s20"))
    rsi, relvol = _c("rsi14"), _c("relvol")
    O, H, L, C, A, _ = _px()
    upper, lower = H - F.greatest(O, C), F.least(O, C) - L
    body, rng = F.abs(C - O), F.nullif(H - L, F.lit(0.0))
    green, pc, po = C > O, lagged("close"), lagged("open")
    falling = _c("_fall")
    band_low, band_up = m20 - 2.0 * s20, m20 + 2.0 * s20
    gap = O / pc - 1
    d3 = falling & lagged(falling) & lagged(falling, 2)
    pc2 = lagged("close", 2)
    return {
        "golden_cross_50_200": _up_through(m50, m200),
        "golden_cross_20_100": _up_through(m20, m100),
        "death_cross_50_200": _down_through(m50, m200),
        "above_sma_200": A > m200,
        "above_sma_50": A > m50,
        "cross_above_sma_50": _up_through(A, m50),
        "cross_above_sma_20": _up_through(A, m20),
        "ma_ribbon_aligned": (m20 > m50) & (m50 > m200),
        "ema_cross_12_26": _up_through(_c("ema_12"), _c("ema_26")),
        "rsi_oversold_30": (rsi < 30) & (lagged(rsi) >= 30),
        "rsi_oversold_20": (rsi < 20) & (lagged(rsi) >= 20),
        "rsi_overbought_70": (rsi > 70) & (lagged(rsi) <= 70),
        "rsi_cross_50": (rsi > 50) & (lagged(rsi) <= 50),
        "macd_cross_up": _up_through(_c("macd"), _c("macd_signal")),
        "macd_hist_positive": (_c("macd_hist") > 0) & (lagged("macd_hist") <= 0),
        "stochastic_oversold": (_c("stoch") < 20) & (lagged("stoch") >= 20),
        "bollinger_lower_touch": A < band_low,
        "bollinger_upper_break": _up_through(A, band_up),
        "donchian_break_20": C > _c("prior20"),
        "donchian_break_55": C > _c("prior55"),
        "new_52w_high": C > _c("prior252"),
        "resistance_break_volume": (C > _c("prior20")) & (relvol > 1.5),
        "support_bounce": (C <= _c("lo20") * 1.02) & (A > m200),
        "pullback_to_sma50": (L <= m50) & (C > m50) & (m50 > m200),
        "bullish_engulfing": (pc < po) & green & (C >= po) & (O <= pc),
        "bearish_engulfing": (pc > po) & (C < O) & (O >= pc) & (C <= po),
        "hammer": (lower > 2 * body) & (upper < body) & (rng > 0),
        "shooting_star": (upper > 2 * body) & (lower < body) & (rng > 0),
        "doji": body <= 0.1 * rng,
        "morning_star": (pc2 < lagged("open", 2)) & (lagged(body) <= 0.3 * lagged(rng)) & green & (C > pc2),
        "three_white_soldiers": green & lagged(green) & lagged(green, 2) & (C > pc) & (pc > pc2),
        "inside_bar": (H < lagged("high")) & (L > lagged("low")),
        "outside_bar_up": (H > lagged("high")) & (L < lagged("low")) & green,
        "gap_up_2pct": gap > 0.02,
        "gap_down_2pct": gap < -0.02,
        "volume_spike_up": (relvol > 2.0) & green,
        "volume_dryup": relvol < 0.5,
        "three_down_days": d3,
        "big_down_day": A / lagged("adj_close") - 1 < -0.03,
        "extreme_below_sma20": A < m20 - 2.0 * s20,
        "oversold_in_uptrend": (rsi < 35) & (A > m200),
    }


EXTRA_RULES: dict[str, Column] = {}
EXTRA_SCORES: dict[str, Column] = {}
GROUPED: dict[str, tuple] = {}


def register_rule(name: str, condition: Column) -> None:
    """Add a rule over the bar columns and the indicators of `_base`."""
    EXTRA_RULES[name] = condition


def register_score(name: str, score: Column) -> None:
    EXTRA_SCORES[name] = score


def register_grouped(name: str, fn, schema: str) -> None:
    """Escape hatch: pandas frame of one symbol -> pandas frame."""
    GROUPED[name] = (fn, schema)


def run_grouped(df: DataFrame, name: str) -> DataFrame:
    fn, schema = GROUPED[name]
    return df.groupBy("symbol").applyInPandas(fn, schema)


def rule_names() -> list[str]:
    return [n for f in FAMILIES.values() for n in f] + list(EXTRA_RULES)


def rule_signals(ix: DataFrame, names=None, keep=("symbol", "dt", "day_index")) -> DataFrame:
    """One 0/1 column per rule; a rule that cannot be decided is 0."""
    rules = {**_rules(), **EXTRA_RULES}
    names = list(names) if names is not None else rule_names()
    return _base(ix).select(
        *keep, *[F.coalesce(rules[n].cast("int"), F.lit(0)).alias(n) for n in names]
    )


def fired(wide: DataFrame, names, keep=("symbol", "dt", "day_index")) -> DataFrame:
    """Long form: one row per rule that fired."""
    hit = F.array_compact(F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in names]))
    return wide.select(*keep, F.explode(hit).alias("signal"))


# ---------------------------------------------------------------------- scores
# fixed values: column names
SCORE_NAMES = (
    "mom_21d", "mom_63d", "mom_126d", "mom_252d_skip", "reversal_5d", "reversal_21d", "dist_sma_50",
    "dist_sma_200", "rsi_14", "low_vol_63d", "rel_volume_20", "low_atr_14", "near_52w_high",
)


def scores(ix: DataFrame, names=None) -> DataFrame:
    """Continuous scores, high = attractive; full windows required.

    mom_252d_skip is plain 252-session momentum: nothing is skipped.
    """
    _, _, _, C, A, V = _px()
    names = list(names) if names is not None else [*SCORE_NAMES, *EXTRA_SCORES]
    mom = lambda n: A / lagged("adj_close", n) - 1.0
    d = ix
    if "dist_sma_200" in names:
        d = trailing_mean(d, 200, "adj_close", "_m200", need=200)
    if "near_52w_high" in names:
        d = trailing(d, 252, {"_top": ("max", "high"), "_top_n": ("count", "high")})
    if "rsi_14" in names:
        d = smoothing.rsi(d, "adj_close", "rsi_14")
    if "low_vol_63d" in names:
        d = d.withColumn("_r", A / lagged("adj_close") - 1.0)
    if "low_atr_14" in names:
        d = d.withColumn("_tr", true_range_col(first_bar_null=False))
    build = {
        "mom_21d": lambda: mom(21),
        "mom_63d": lambda: mom(63),
        "mom_126d": lambda: mom(126),
        "mom_252d_skip": lambda: mom(252),
        "reversal_5d": lambda: -mom(5),
        "reversal_21d": lambda: -mom(21),
        "dist_sma_50": lambda: A / full(F.avg("adj_close"), "adj_close", 50) - 1.0,
        "dist_sma_200": lambda: A / F.col("_m200") - 1.0,
        "rsi_14": lambda: F.col("rsi_14"),
        "low_vol_63d": lambda: -full(F.stddev_samp("_r"), "_r", 63),
        "rel_volume_20": lambda: ratio(V, full(F.avg("volume"), "volume", 20)),
        "low_atr_14": lambda: -(full(F.avg("_tr"), "_tr", 14) / C),
        "near_52w_high": lambda: A / F.when(F.col("_top_n") >= 252, F.col("_top")) - 1.0,
    }
    made = [(EXTRA_SCORES[n] if n in EXTRA_SCORES else build[n]()).alias(n) for n in names]
    return d.select(*[c for c in ix.columns if c not in names], *made)
