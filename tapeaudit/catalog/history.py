"""Queries over a symbol's own history: features, rules, scores and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import full, lagged
from ..operators import features, labels, signals, smoothing
from .base import CTES, query, r, rounded
from .ctes import W, rows
from .joins import FEAT_D

K = "symbol, dt"


def with_adv(ix):
    d = ix.withColumn("_usd", F.col("close") * F.col("volume"))
    return d.withColumn("adv", full(F.avg("_usd"), "_usd", 20)).drop("_usd")


def feat(cols: str, ints: str = "", source: str = "x_feat") -> str:
    extra = "".join(f", {c}" for c in ints.split())
    return f"SELECT {K}, {r(cols)}{extra} FROM {source}"


def pick(df, cols: str, ints: str = ""):
    return rounded(df.select("symbol", "dt", *cols.split(), *ints.split()))


@query("returns_1d", feat("ret_1d gap_pct range_pct"))
def returns_1d(d):
    return pick(features.returns(d.ix), "ret_1d gap_pct range_pct")


@query("sma_20_50_200", feat("sma_20 sma_50 sma_200"))
def sma(d):
    return pick(features.moving_averages(d.ix), "sma_20 sma_50 sma_200")


@query("vol_avg_rel_volume", feat("vol_avg_20 rel_volume"))
def vol_avg(d):
    return pick(features.volume_ratio(d.ix), "vol_avg_20 rel_volume")


@query("extremes_252", feat("high_252 low_252 dist_52w_high dist_52w_low prior_high_20 prior_low_20"))
def extremes(d):
    return pick(features.extremes(d.ix), "high_252 low_252 dist_52w_high dist_52w_low prior_high_20 prior_low_20")


@query("vol_20_annual", feat("vol_20_annual"))
def vol_20(d):
    return pick(features.realised_vol(features.returns(d.ix)), "vol_20_annual")


@query("atr_14", feat("atr_14 atr_pct"))
def atr(d):
    return pick(features.average_true_range(d.ix), "atr_14 atr_pct")


@query("momentum", feat("mom_5d mom_21d mom_63d mom_126d"))
def momentum(d):
    return pick(features.momentum(d.ix), "mom_5d mom_21d mom_63d mom_126d")


@query("trend_flags", feat("dist_sma_20 dist_sma_50 dist_sma_200", "regime_bull above_200 bar_num"))
def trend_flags(d):
    f = features.trend_flags(features.moving_averages(d.ix))
    return pick(f, "dist_sma_20 dist_sma_50 dist_sma_200", "regime_bull above_200 bar_num")


@query("features", f"SELECT symbol, dt, day_index, sector, kind, bar_num, volume, regime_bull, above_200, {r(FEAT_D)} FROM x_feat")
def feature_layer(d):
    return rounded(d.features)


MKT = "mkt_ret_1d mkt_vol_20 mkt_dist_sma_200"


@query("market_state", f"SELECT dt, {r(MKT)}, mkt_regime_bull FROM x_market")
def market_state(d):
    return rounded(features.market_state(d.features))


PANEL = "mom_21d rel_volume vol_20_annual mkt_ret_1d mkt_vol_20 mom_21d_xs_rank rel_volume_xs_rank vol_20_xs_rank"


@query("feature_panel", feat(PANEL, "mkt_regime_bull bar_num", "x_panel"))
def feature_panel(d):
    return pick(d.panel, PANEL, "mkt_regime_bull bar_num")


# --------------------------------------------------------------- smoothing
def fold(col: str, alpha: float, where: str = "") -> str:
    f = f" FILTER (WHERE {where})" if where else ""
    return (
        f"list_reduce(list({col}){f} OVER (PARTITION BY symbol ORDER BY day_index ROWS BETWEEN 450 PRECEDING AND CURRENT ROW), "
        f"lambda s, v: s*(1-{alpha!r})+v*{alpha!r})"
    )


CTES["x_ema"] = f"""
SELECT *, CASE WHEN bn>=12 THEN {fold('adj_close', 2 / 13)} END AS ema_12,
  CASE WHEN bn>=26 THEN {fold('adj_close', 2 / 27)} END AS ema_26 FROM x_ret"""
CTES["x_macd"] = f"""
SELECT *, macd - macd_signal AS macd_hist FROM (
SELECT *, CASE WHEN bn>=34 THEN {fold('macd', 2 / 10, 'macd IS NOT NULL')} END AS macd_signal
FROM (SELECT *, ema_12-ema_26 AS macd FROM x_ema))"""
CTES["x_rsi"] = f"""
SELECT *, CASE WHEN bn>=15 THEN 100-100/(1+eu/NULLIF(ed,0)) END AS rsi14 FROM (
SELECT *, {fold('up', 1 / 14, 'up IS NOT NULL')} AS eu, {fold('dn', 1 / 14, 'dn IS NOT NULL')} AS ed FROM (
SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d,0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d,0) END AS dn FROM (
SELECT *, adj_close-prev_adj AS d FROM x_ret)))"""


@query("ema", feat("ema_12 ema_26", source="x_ema"))
def ema(d):
    e = smoothing.ema(d.ix, "adj_close", "ema_12", smoothing.span_alpha(12), 12)
    return pick(smoothing.ema(e, "adj_close", "ema_26", smoothing.span_alpha(26), 26), "ema_12 ema_26")


@query("rsi", feat("rsi14", source="x_rsi"))
def rsi(d):
    return pick(smoothing.rsi(d.ix, "adj_close", "rsi14"), "rsi14")


@query("macd", feat("macd macd_signal macd_hist", source="x_macd"))
def macd(d):
    return pick(smoothing.macd(d.ix), "macd macd_signal macd_hist")


CTES["x_base"] = f"""
SELECT *, 100*(close-lo14)/NULLIF(hi14-lo14,0) AS stoch, m20-2.0*s20 AS bb_low, m20+2.0*s20 AS bb_up,
  4.0*s20/NULLIF(m20,0) AS bb_width FROM (
SELECT *, CASE WHEN bn>=20 THEN avg(adj_close) OVER {rows(19)} END AS m20, CASE WHEN bn>=50 THEN avg(adj_close) OVER {rows(49)} END AS m50,
  CASE WHEN bn>=100 THEN avg(adj_close) OVER {rows(99)} END AS m100, CASE WHEN bn>=200 THEN avg(adj_close) OVER {rows(199)} END AS m200,
  CASE WHEN bn>=20 THEN stddev_samp(adj_close) OVER {rows(19)} END AS s20,
  CASE WHEN bn>=14 THEN min(low) OVER {rows(13)} END AS lo14, CASE WHEN bn>=14 THEN max(high) OVER {rows(13)} END AS hi14,
  CASE WHEN bn>=20 THEN min(low) OVER {rows(19)} END AS lo20,
  CASE WHEN bn>=21 THEN max(high) OVER {rows(20, '1 PRECEDING')} END AS prior20,
  CASE WHEN bn>=56 THEN max(high) OVER {rows(55, '1 PRECEDING')} END AS prior55,
  CASE WHEN bn>=253 THEN max(high) OVER {rows(252, '1 PRECEDING')} END AS prior252,
  CASE WHEN bn>=20 THEN volume/NULLIF(avg(volume) OVER {rows(19)},0) END AS relvol FROM x_ret)"""


@query("bollinger", f"SELECT {K}, round(m20,6)+0.0 AS bb_mid, {r('bb_up bb_low')} FROM x_base")
def bollinger(d):
    return pick(signals.bollinger(d.ix), "bb_mid bb_up bb_low")


@query(
    "bollinger_squeeze",
    f"""SELECT {K}, round(bb_width,6)+0.0 AS bb_width, CASE WHEN n>=120 AND bb_width<=q THEN 1 ELSE 0 END AS squeeze FROM (
SELECT *, count(bb_width) OVER w AS n, quantile_cont(bb_width,0.10) OVER w AS q FROM x_base WINDOW w AS {rows(119)})""",
)
def bollinger_squeeze(d):
    return pick(signals.bollinger_squeeze(d.ix), "bb_width", "squeeze")


@query("stochastic_k", f"SELECT {K}, round(stoch,6)+0.0 AS stoch_k FROM x_base")
def stochastic_k(d):
    return pick(signals.stochastic_k(d.ix), "stoch_k")


# -------------------------------------------------------------------- rules
CTES["x_sig0"] = f"""
SELECT b.*, e.ema_12, e.ema_26, m.macd, m.macd_signal, m.macd_hist, s.rsi14 AS rsi,
  abs(b.close-b.open) AS body, b.high-greatest(b.open,b.close) AS uw, least(b.open,b.close)-b.low AS lw,
  NULLIF(b.high-b.low,0) AS rng, b.close>b.open AS green, b.adj_close<b.prev_adj AS fall
FROM x_base b JOIN x_ema e USING (symbol, dt) JOIN x_macd m USING (symbol, dt) JOIN x_rsi s USING (symbol, dt)"""
LAGS = (
    "m20 m50 m100 m200 adj_close ema_12 ema_26 rsi macd macd_signal macd_hist stoch bb_up close open high low body rng green fall"
).split()
CTES["x_sig1"] = (
    "SELECT *, "
    + ", ".join(f"lag({c}) OVER w AS p_{c}" for c in LAGS)
    + f", lag(close,2) OVER w AS pp_close, lag(open,2) OVER w AS pp_open, lag(green,2) OVER w AS pp_green, lag(fall,2) OVER w AS pp_fall FROM x_sig0 WINDOW w AS ({W})"
)
RULE_SQL = {
    "golden_cross_50_200": "m50>m200 AND p_m50<=p_m200",
    "golden_cross_20_100": "m20>m100 AND p_m20<=p_m100",
    "death_cross_50_200": "m50<m200 AND p_m50>=p_m200",
    "above_sma_200": "adj_close>m200",
    "above_sma_50": "adj_close>m50",
    "cross_above_sma_50": "adj_close>m50 AND p_adj_close<=p_m50",
    "cross_above_sma_20": "adj_close>m20 AND p_adj_close<=p_m20",
    "ma_ribbon_aligned": "m20>m50 AND m50>m200",
    "ema_cross_12_26": "ema_12>ema_26 AND p_ema_12<=p_ema_26",
    "rsi_oversold_30": "rsi<30 AND p_rsi>=30",
    "rsi_oversold_20": "rsi<20 AND p_rsi>=20",
    "rsi_overbought_70": "rsi>70 AND p_rsi<=70",
    "rsi_cross_50": "rsi>50 AND p_rsi<=50",
    "macd_cross_up": "macd>macd_signal AND p_macd<=p_macd_signal",
    "macd_hist_positive": "macd_hist>0 AND p_macd_hist<=0",
    "stochastic_oversold": "stoch<20 AND p_stoch>=20",
    "bollinger_lower_touch": "adj_close<bb_low",
    "bollinger_upper_break": "adj_close>bb_up AND p_adj_close<=p_bb_up",
    "donchian_break_20": "close>prior20",
    "donchian_break_55": "close>prior55",
    "new_52w_high": "close>prior252",
    "resistance_break_volume": "close>prior20 AND relvol>1.5",
    "support_bounce": "close<=lo20*1.02 AND adj_close>m200",
    "pullback_to_sma50": "low<=m50 AND close>m50 AND m50>m200",
    "bullish_engulfing": "p_close<p_open AND green AND close>=p_open AND open<=p_close",
    "bearish_engulfing": "p_close>p_open AND close<open AND open>=p_close AND close<=p_open",
    "hammer": "lw>2*body AND uw<body AND rng>0",
    "shooting_star": "uw>2*body AND lw<body AND rng>0",
    "doji": "body<=0.1e0*rng",
    "morning_star": "pp_close<pp_open AND p_body<=0.3e0*p_rng AND green AND close>pp_close",
    "three_white_soldiers": "green AND p_green AND pp_green AND close>p_close AND p_close>pp_close",
    "inside_bar": "high<p_high AND low>p_low",
    "outside_bar_up": "high>p_high AND low<p_low AND green",
    "gap_up_2pct": "open/p_close-1>0.02e0",
    "gap_down_2pct": "open/p_close-1<-0.02e0",
    "volume_spike_up": "relvol>2.0 AND green",
    "volume_dryup": "relvol<0.5",
    "three_down_days": "fall AND p_fall AND pp_fall",
    "big_down_day": "adj_close/prev_adj-1<-0.03e0",
    "extreme_below_sma20": "adj_close<m20-2.0*s20",
    "oversold_in_uptrend": "rsi<35 AND adj_close>m200",
}
CTES["x_sig"] = (
    "SELECT symbol, dt, day_index, "
    + ", ".join(f"CASE WHEN {w} THEN 1 ELSE 0 END AS {n}" for n, w in RULE_SQL.items())
    + " FROM x_sig1"
)


def _family(name):
    names = list(signals.FAMILIES[name])

    @query(f"signals_{name}", f"SELECT symbol, dt, {', '.join(names)} FROM x_sig")
    def run(d):
        return signals.rule_signals(d.ix, names, keep=("symbol", "dt"))

    return run


for _name in signals.FAMILIES:
    _family(_name)

ALL_RULES = list(RULE_SQL)


@query(
    "signals_fired",
    "SELECT signal, count(*) AS fired, count(DISTINCT dt) AS dates FROM (UNPIVOT x_sigs ON * EXCLUDE (symbol, dt, day_index) INTO NAME signal VALUE hit) WHERE hit=1 GROUP BY signal",
)
def signals_fired(d):
    long = signals.fired(signals.rule_signals(d.ix), ALL_RULES, keep=("dt",))
    return long.groupBy("signal").agg(F.count(F.lit(1)).alias("fired"), F.countDistinct("dt").alias("dates"))


CTES["x_sigs"] = "SELECT * FROM x_sig"

# -------------------------------------------------------------------- scores
CTES["x_score"] = f"""
SELECT s.symbol, s.dt, s.day_index, s.sector, s.kind, s.adj_close, s.close, s.volume, s.adj_close/lag(s.adj_close,21) OVER w-1.0 AS mom_21d,
 s.adj_close/lag(s.adj_close,63) OVER w-1.0 AS mom_63d, s.adj_close/lag(s.adj_close,126) OVER w-1.0 AS mom_126d,
 s.adj_close/lag(s.adj_close,252) OVER w-1.0 AS mom_252d_skip, -(s.adj_close/lag(s.adj_close,5) OVER w-1.0) AS reversal_5d,
 -(s.adj_close/lag(s.adj_close,21) OVER w-1.0) AS reversal_21d,
 CASE WHEN s.bn>=50 THEN s.adj_close/avg(s.adj_close) OVER {rows(49)}-1.0 END AS dist_sma_50,
 CASE WHEN s.bn>=200 THEN s.adj_close/avg(s.adj_close) OVER {rows(199)}-1.0 END AS dist_sma_200, s.rsi14 AS rsi_14,
 CASE WHEN s.bn>=64 THEN -stddev_samp(s.ret_1d) OVER {rows(62)} END AS low_vol_63d,
 CASE WHEN s.bn>=20 THEN s.volume/NULLIF(avg(s.volume) OVER {rows(19)},0) END AS rel_volume_20,
 CASE WHEN s.bn>=14 THEN -(avg(s.tr) OVER {rows(13)}/s.close) END AS low_atr_14,
 CASE WHEN s.bn>=252 THEN s.adj_close/max(s.high) OVER {rows(251)}-1.0 END AS near_52w_high
FROM (SELECT *, greatest(high-low, abs(high-prev_close), abs(low-prev_close)) AS tr FROM x_rsi) s WINDOW w AS ({W})"""


@query("scores", f"SELECT {K}, {r(' '.join(signals.SCORE_NAMES))} FROM x_score")
def score_layer(d):
    return pick(signals.scores(d.ix), " ".join(signals.SCORE_NAMES))


@query("adv_20", f"SELECT {K}, round(adv,3)+0.0 AS adv FROM x_adv")
def adv_20(d):
    return rounded(with_adv(d.ix).select("symbol", "dt", "adv"), 3)


CTES["x_wret"] = CTES["x_ret"].replace("x_ix", "x_wix")
CTES["x_research"] = f"""
SELECT *, CASE WHEN adv IS NOT NULL THEN ln(greatest(adv,1e5)) END AS size, CASE WHEN adv IS NOT NULL THEN least(greatest(2.0*sqrt(212e6)/sqrt(greatest(adv,1e5)),
   0.5*0.01/greatest(close,1.0)*10000, 1.0),150.0) END AS half_bps FROM (
SELECT s.symbol, s.dt, s.day_index, s.sector, s.kind, s.open, s.high, s.low, s.close, s.adj_close, s.volume, s.ret_1d AS ret, m.ret_1d AS mkt,
 CASE WHEN s.bn>=20 THEN avg(s.close*s.volume) OVER {rows(19)} END AS adv,
 CASE WHEN count(s.ret_1d) OVER {rows(62)}>=40 THEN stddev_samp(s.ret_1d) OVER {rows(62)} END AS vol63,
 CASE WHEN count(CASE WHEN s.ret_1d IS NOT NULL AND m.ret_1d IS NOT NULL THEN 1 END) OVER {rows(251)}>=120
   AND count(m.ret_1d) OVER {rows(251)}>=120 THEN covar_samp(s.ret_1d,m.ret_1d) OVER {rows(251)}/NULLIF(var_samp(m.ret_1d) OVER {rows(251)},0) END AS beta,
 s.adj_close/lag(s.adj_close,126) OVER w-1.0 AS mom126, s.adj_close/lag(s.adj_close,252) OVER w-1.0 AS mom252,
 -(s.adj_close/lag(s.adj_close,5) OVER w-1.0) AS reversal5, lead(s.adj_close,21) OVER w/s.adj_close-1.0 AS fwd_21
FROM x_ret s LEFT JOIN (SELECT dt, ret_1d FROM x_ret WHERE symbol='MKT') m ON m.dt=s.dt
WHERE s.kind='stock' WINDOW w AS (PARTITION BY s.symbol ORDER BY s.day_index))"""
CTES["x_wresearch"] = CTES["x_research"].replace("x_ret", "x_wret")
RES = "ret vol63 beta size mom126 mom252 reversal5 half_bps fwd_21"


@query("research_panel", f"SELECT {K}, round(adv,3)+0.0 AS adv, {r(RES)} FROM x_research")
def research_panel(d):
    p = features.research_panel(d.ix)
    return rounded(p.select("symbol", "dt", "adv", *RES.split()), adv=3)


@query("vol63", f"SELECT {K}, round(vol63,6)+0.0 AS vol63 FROM x_research")
def vol63(d):
    p = d.ix.filter("kind = 'stock'").withColumn("ret", F.col("adj_close") / lagged("adj_close") - 1.0)
    return pick(p.withColumn("vol63", full(F.stddev_samp("ret"), "ret", 63, 40)), "vol63")


@query("beta_252", f"SELECT {K}, round(beta,6)+0.0 AS beta FROM x_research")
def beta_252(d):
    return pick(features.research_panel(d.ix), "beta")


@query("size", f"SELECT {K}, round(size,6)+0.0 AS size FROM x_research")
def size(d):
    p = with_adv(d.ix.filter("kind = 'stock'"))
    return pick(p.withColumn("size", features.size_col()), "size")


@query("half_spread_liquidity", f"SELECT {K}, round(half_bps,6)+0.0 AS half_bps FROM x_research")
def half_spread_liquidity(d):
    p = with_adv(d.ix.filter("kind = 'stock'"))
    return pick(p.withColumn("half_bps", features.half_spread_bps()), "half_bps")


@query("liquidity_filter", f"SELECT {K}, round(adv,3)+0.0 AS adv FROM x_adv WHERE adv>=20000")
def liquidity_filter(d):
    return rounded(with_adv(d.ix).select("symbol", "dt", "adv").filter("adv >= 20000"), 3)


@query(
    "overnight_intraday",
    """
SELECT symbol, n, round(oa,6)+0.0 AS overnight_ann, round(ov,6)+0.0 AS overnight_vol, round(ia,6)+0.0 AS intraday_ann, round(iv,6)+0.0 AS intraday_vol,
 round(oa/ov,6)+0.0 AS overnight_sharpe, round(ia/NULLIF(iv,0),6)+0.0 AS intraday_sharpe, round(oa/(oa+ia),6)+0.0 AS overnight_share, round(ov*ov/(ov*ov+iv*iv),6)+0.0 AS overnight_var_share,
 round(oa/252/2*10000,6)+0.0 AS breakeven_half_bps FROM (
SELECT symbol, count(*) AS n, avg(o)*252 AS oa, stddev_samp(o)*sqrt(252) AS ov, avg(i)*252 AS ia, stddev_samp(i)*sqrt(252) AS iv
FROM (SELECT symbol, open/prev_close-1.0 AS o, close/open-1.0 AS i FROM x_ret WHERE prev_close>0) GROUP BY symbol)""",
)
def overnight_intraday(d):
    return rounded(features.overnight_intraday(d.ix))


@query(
    "market_regimes",
    f"""
SELECT dt, CASE WHEN adj_close>sma THEN 1 ELSE 0 END AS above, CASE WHEN np>=250 AND vol63>hi THEN 1 ELSE 0 END AS vol_hi,
 CASE WHEN np>=250 AND vol63<lo THEN 1 ELSE 0 END AS vol_lo, round(vol63,6)+0.0 AS vol63 FROM (
SELECT *, count(vol63) OVER p AS np, quantile_cont(vol63,0.667) OVER p AS hi, quantile_cont(vol63,0.333) OVER p AS lo FROM (
SELECT *, CASE WHEN bn>=200 THEN avg(adj_close) OVER {rows(199)} END AS sma, CASE WHEN bn>=64 THEN stddev_samp(ret_1d) OVER {rows(62)}*sqrt(252.0) END AS vol63
FROM x_ret WHERE symbol='MKT') WINDOW p AS (ORDER BY day_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
)
def market_regimes(d):
    return rounded(features.market_regimes(d.ix))


@query(
    "drawdown",
    f"""SELECT {K}, round(peak,6)+0.0 AS peak, round((peak-adj_close)/peak,6)+0.0 AS drawdown FROM (
 SELECT symbol, dt, adj_close, max(adj_close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM x_ix)""",
)
def drawdown(d):
    return pick(features.drawdown(d.ix, "symbol", "adj_close", "day_index"), "peak drawdown")


# -------------------------------------------------------------------- labels
LAB = "fwd_ret_1d fwd_ret_5d fwd_ret_21d fwd_ret_5d_net fwd_min_low_5d fwd_max_high_5d fwd_mae_5d fwd_mfe_5d next_open"


@query("labels", f"SELECT symbol, dt, day_index, label_win_5d, {r(LAB)} FROM x_labels")
def label_layer(d):
    return rounded(d.labels)


def _label(name, cols, ints=""):
    @query(name, feat(cols, ints, "x_labels"))
    def run(d):
        return pick(d.labels, cols, ints)

    return run


_label("fwd_ret", "fwd_ret_1d fwd_ret_5d fwd_ret_21d")
_label("fwd_ret_net_label_win", "fwd_ret_5d_net", "label_win_5d")
_label("fwd_extrema", "fwd_min_low_5d fwd_max_high_5d fwd_mae_5d fwd_mfe_5d")
_label("next_open", "next_open")

CTES["x_fx"] = f"""
SELECT s.symbol, s.dt, s.day_index, {', '.join(f"(lead(s.adj_close,{h}) OVER w/s.adj_close-1.0)-(lead(m.adj_close,{h}) OVER w/m.adj_close-1.0) AS fwd_{h}" for h in (21, 63))}
FROM x_ix s LEFT JOIN (SELECT dt, adj_close FROM x_ix WHERE symbol='MKT') m ON m.dt=s.dt WHERE s.symbol<>'MKT'
WINDOW w AS (PARTITION BY s.symbol ORDER BY s.day_index)"""


@query("fwd_excess", feat("fwd_21 fwd_63", source="x_fx"))
def fwd_excess(d):
    return pick(labels.forward_excess(d.ix), "fwd_21 fwd_63")
