"""Queries of the join layer: equi, as-of, session and event-time joins, and the
slow sources that use them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import uniform
from ..operators import alt, asof, calendar, earnings, events, features, fundamentals, labels
from ..sources import panels
from .base import CTES, query, r, rounded

FEAT_D = (
    "open high low close adj_close ret_1d gap_pct range_pct sma_20 sma_50 sma_200 atr_14 vol_20_annual "
    "dist_sma_20 dist_sma_50 dist_sma_200 rel_volume dist_52w_high dist_52w_low atr_pct prior_high_20 "
    "prior_low_20 mom_5d mom_21d mom_63d mom_126d"
)


@query(
    "join_equi",
    f"SELECT f.symbol, f.dt, bar_num, {r('mom_21d fwd_ret_5d_net')} FROM x_feat f JOIN x_labels l ON l.symbol=f.symbol AND l.dt=f.dt",
)
def join_equi(d):
    f = d.features.select("symbol", "dt", "bar_num", "mom_21d")
    return rounded(f.join(d.labels.select("symbol", "dt", "fwd_ret_5d_net"), ["symbol", "dt"]))


@query(
    "join_left_market",
    f"""SELECT f.symbol, f.dt, {r('ret_1d mkt_ret_1d mkt_vol_20 mkt_dist_sma_200')}, mkt_regime_bull
FROM x_feat f LEFT JOIN x_market m ON m.dt=f.dt WHERE f.kind='stock'""",
)
def join_left_market(d):
    f = d.features.filter("kind = 'stock'").select("symbol", "dt", "ret_1d")
    return rounded(f.join(features.market_state(d.features), "dt", "left"))


def _keys(d):
    return d.ix.filter("kind = 'stock'").select("symbol", "dt", "day_index", "close")


CTES["x_keys"] = "SELECT symbol, dt, day_index, close FROM x_ix WHERE kind='stock'"
CTES["x_ev1"] = """
SELECT symbol, tradeable_from, arg_max(surprise_pct, announced_at) AS surprise_pct, max(announced_at) AS announced_at
FROM x_earnings WHERE tradeable_from IS NOT NULL GROUP BY symbol, tradeable_from"""


@query(
    "asof_backward",
    """SELECT k.symbol, k.dt, e.tradeable_from, round(e.surprise_pct,6)+0.0 AS surprise_pct
FROM x_keys k ASOF LEFT JOIN x_ev1 e ON k.symbol=e.symbol AND k.dt>=e.tradeable_from""",
)
def asof_backward(d):
    p = _keys(d).select("symbol", "dt")
    return rounded(
        asof.asof_backward(p, d.earnings, "tradeable_from", ["surprise_pct"], order=F.col("announced_at"))
    )


@query(
    "asof_forward",
    """
SELECT s.award_id, s.action_date, s.amt AS amount_usd, s.ticker,
  (SELECT min(b.dt) FROM x_bars b WHERE b.symbol=s.ticker AND b.dt>=s.action_date) AS event_dt
FROM (SELECT award_id, action_date, round(amount_usd,2)+0.0 AS amt, ticker FROM x_entities WHERE ticker IS NOT NULL) s""",
)
def asof_forward(d):
    from .load import _resolved

    a = _resolved(d).filter("ticker is not null").select("award_id", "action_date", "amount_usd", "ticker")
    s = d.bars.select(F.col("symbol").alias("ticker"), "dt")
    return rounded(calendar.snap_forward(a, s, "action_date", "event_dt", by=["ticker"]), 2)


@query(
    "snap_share_moved",
    """
SELECT count(*) AS events, round(avg(CASE WHEN e<>action_date THEN 1 ELSE 0 END),6)+0.0 AS share_moved FROM (
  SELECT action_date, (SELECT min(dt) FROM x_cal c WHERE c.dt>=action_date) AS e FROM x_actions) WHERE e IS NOT NULL""",
)
def snap_share_moved(d):
    s = calendar.snap_forward(d.actions.select("action_date"), d.calendar.select("dt"), "action_date", "e")
    return rounded(
        s.filter("e is not null").agg(
            F.count(F.lit(1)).alias("events"),
            F.avg((F.col("e") != F.col("action_date")).cast("int")).alias("share_moved"),
        )
    )


@query("resolve_tradeable_from", "SELECT symbol, announced_at, round(surprise_pct,6)+0.0 AS surprise_pct, tradeable_from FROM x_earnings")
def resolve_tradeable_from(d):
    return rounded(d.earnings.select("symbol", "announced_at", "surprise_pct", "tradeable_from"))


CTES["x_short1"] = """
SELECT s.*, c2.dt AS tradeable_from FROM (
  SELECT s.*, (SELECT min(day_index) FROM x_cal c WHERE c.dt >= s.settlement_date) AS di FROM x_short s) s
JOIN x_cal c2 ON c2.day_index = s.di + 10"""


def _short(d):
    return calendar.lag_sessions(panels.short_interest(d.spark, d.dir), d.calendar, "settlement_date", "tradeable_from")


@query(
    "lag_sessions",
    f"SELECT symbol, settlement_date, tradeable_from, {r('short_shares prev_short avg_daily_vol days_to_cover')} FROM x_short1",
)
def lag_sessions(d):
    return rounded(_short(d))


@query(
    "session_age",
    """
SELECT k.symbol, k.dt, e.tradeable_from, CAST(a.day_index - b.day_index AS INTEGER) AS age
FROM x_keys k ASOF LEFT JOIN x_ev1 e ON k.symbol=e.symbol AND k.dt>=e.tradeable_from
JOIN x_cal a ON a.dt=k.dt LEFT JOIN x_cal b ON b.dt=e.tradeable_from""",
)
def session_age(d):
    p = asof.asof_backward(_keys(d).select("symbol", "dt"), d.earnings, "tradeable_from", [], order=F.col("announced_at"))
    return calendar.session_age(p, d.calendar, "tradeable_from", "age").select("symbol", "dt", "tradeable_from", "age")


CTES["x_shares"] = """
SELECT symbol, filed, arg_min(val, ROW(period_end, fact_id)) AS shares FROM x_facts
WHERE concept='CommonStockSharesOutstanding' AND val>0 GROUP BY symbol, filed"""


@query("pit_shares", "SELECT symbol, filed, round(shares,2)+0.0 AS shares FROM x_shares")
def pit_shares(d):
    return rounded(fundamentals.pit_shares(panels.fundamentals(d.spark, d.dir)), 2)


@query(
    "pit_mcap",
    """SELECT k.symbol, k.dt, round(s.shares,2)+0.0 AS shares, round(s.shares*k.close,2)+0.0 AS mcap
FROM x_keys k ASOF LEFT JOIN x_shares s ON k.symbol=s.symbol AND k.dt>=s.filed""",
)
def pit_mcap(d):
    shares = fundamentals.pit_shares(panels.fundamentals(d.spark, d.dir))
    p = fundamentals.pit_mcap(_keys(d).select("symbol", "dt", "close"), shares)
    return rounded(p.select("symbol", "dt", "shares", "mcap"), 2)


CTES["x_valued"] = """
SELECT t.*, b.close AS mkt_price, t.shares*b.close AS usd FROM x_insider t JOIN x_bars b ON b.symbol=t.symbol AND b.dt=t.trans_date
WHERE t.trans_code IN ('P','S') AND t.shares*b.close>0 AND t.shares>0 AND t.filing_date>=t.trans_date"""


@query(
    "value_trades_at_market",
    "SELECT accession, symbol, filing_date, trans_date, trans_code, round(mkt_price,6)+0.0 AS mkt_price, round(usd,4)+0.0 AS usd FROM x_valued",
)
def value_trades_at_market(d):
    v = alt.value_at_market(panels.insider_trades(d.spark, d.dir), d.bars)
    return rounded(
        v.select("accession", "symbol", "filing_date", "trans_date", "trans_code", "mkt_price", "usd"), usd=4
    )


CTES["x_abn"] = """
SELECT s.symbol, s.dt, s.pos, s.n, s.ret - m.ret AS abn FROM (
  SELECT symbol, dt, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n,
         adj_close/lag(adj_close) OVER w - 1.0 AS ret FROM x_ix WHERE symbol<>'MKT'
  WINDOW w AS (PARTITION BY symbol ORDER BY day_index)) s
LEFT JOIN (SELECT dt, adj_close/lag(adj_close) OVER (ORDER BY dt) - 1.0 AS ret FROM x_ix WHERE symbol='MKT') m ON m.dt=s.dt"""
CTES["x_evt"] = """
SELECT award_id, mod, action_date, ticker AS symbol,
  (SELECT min(b.dt) FROM x_bars b WHERE b.symbol=ticker AND b.dt>=action_date) AS event_dt
FROM x_entities WHERE ticker IS NOT NULL"""
CTES["x_anchor"] = """
SELECT e.symbol, a.pos, count(*) AS weight FROM x_evt e JOIN x_abn a ON a.symbol=e.symbol AND a.dt=e.event_dt GROUP BY 1, 2"""


def contract_events(d):
    from .load import _resolved

    a = _resolved(d).filter("ticker is not null").select(
        "award_id", "mod", "action_date", "amount_usd", F.col("ticker").alias("symbol")
    )
    s = d.bars.select("symbol", "dt")
    return calendar.snap_forward(a, s, "action_date", "event_dt", by=["symbol"])


LO, HI = -250, 63


@query(
    "event_time_join",
    """SELECT c.symbol, c.pos AS anchor, a.pos - c.pos AS k, c.weight, round(a.abn,6)+0.0 AS abn
FROM x_anchor c JOIN x_abn a ON a.symbol=c.symbol AND a.pos BETWEEN c.pos-5 AND c.pos+5 WHERE a.abn IS NOT NULL""",
)
def event_time_join(d):
    px = events.abnormal_returns(d.ix)
    t = events.event_time(events.anchors(contract_events(d), px), px, -5, 5)
    return rounded(t.withColumn("anchor", F.col("anchor").cast("bigint")).withColumn("k", F.col("k").cast("bigint")))


CAR = """SELECT CAST(k AS INTEGER) AS k, CAST(n AS BIGINT) AS n, round(m,6)+0.0 AS mean_abn,
  round(sum(m) OVER (ORDER BY k),6)+0.0 AS car FROM (
  SELECT a.pos - c.pos AS k, sum(c.weight) AS n, sum(c.weight*a.abn)/sum(c.weight) AS m
  FROM {anchor} c JOIN x_abn a ON a.symbol=c.symbol AND a.pos BETWEEN c.pos-250 AND c.pos+63
  WHERE a.abn IS NOT NULL GROUP BY 1)"""


@query("event_car", CAR.format(anchor="x_anchor"))
def event_car(d):
    px = events.abnormal_returns(d.ix)
    return rounded(events.car(events.event_time(events.anchors(contract_events(d), px), px, LO, HI)))


CTES["x_placebo"] = """
SELECT symbol, CAST(CASE WHEN n > 250+63+2 THEN 250+floor(u*(n-63-1-250)) ELSE floor(u*n) END AS BIGINT) AS pos, count(*) AS weight
FROM (SELECT e.symbol, ('0x'||substr(md5('placebo-'||award_id||'/'||mod||'/'||action_date),1,8))::BIGINT/4294967296.0 AS u, n.n
      FROM x_evt e JOIN (SELECT symbol, max(n) AS n FROM x_abn GROUP BY 1) n ON n.symbol=e.symbol) GROUP BY 1, 2"""


@query("placebo_car", CAR.format(anchor="x_placebo"))
def placebo_car(d):
    px = events.abnormal_returns(d.ix)
    e = contract_events(d).withColumn("event_id", F.concat_ws("/", "award_id", "mod", "action_date"))
    return rounded(events.car(events.event_time(events.placebo_anchors(e, px, LO, HI), px, LO, HI)))


SIDE_WIN = ", ".join(f"({a},{b})" for a, b in events.WINDOWS)


def index_changes(d):
    """Membership changes per quarter: a brand enters or leaves by a hash of the quarter."""
    q = d.bars.filter("symbol <> 'MKT'").groupBy("symbol", F.trunc("dt", "quarter").alias("q")).agg(
        F.min("dt").alias("event_dt")
    )
    u = uniform("symbol", "q")
    return q.filter(u < 0.3).select(
        "symbol", "event_dt", F.when(u < 0.15, "added").otherwise("removed").alias("side")
    )


CTES["x_changes"] = """
SELECT symbol, event_dt, CASE WHEN u<0.15 THEN 'added' ELSE 'removed' END AS side FROM (
  SELECT symbol, min(dt) AS event_dt,
    ('0x'||substr(md5(symbol||'-'||CAST(CAST(date_trunc('quarter',dt) AS DATE) AS VARCHAR)),1,8))::BIGINT/4294967296.0 AS u
  FROM x_bars WHERE symbol<>'MKT' GROUP BY symbol, date_trunc('quarter',dt)) WHERE u<0.3"""


@query(
    "event_window_table",
    f"""
WITH win(lo,hi) AS (VALUES {SIDE_WIN}),
pe AS (SELECT c.side, c.event_dt, c.symbol, win.lo, win.hi, sum(a.abn) AS abn
  FROM x_changes c JOIN x_abn b ON b.symbol=c.symbol AND b.dt=c.event_dt
  JOIN x_abn a ON a.symbol=c.symbol AND a.pos-b.pos BETWEEN -250 AND 63
  JOIN win ON a.pos-b.pos BETWEEN win.lo AND win.hi WHERE a.abn IS NOT NULL GROUP BY ALL),
pd AS (SELECT side, event_dt, lo, hi, avg(abn) AS abn, count(*) AS m FROM pe GROUP BY ALL)
SELECT side, lo, hi, count(*) AS dates, CAST(sum(m) AS BIGINT) AS events, round(avg(abn),6)+0.0 AS mean_abn,
  round(avg(abn)/(stddev_samp(abn)/sqrt(count(*))),6)+0.0 AS t FROM pd GROUP BY side, lo, hi""",
)
def event_window_table(d):
    px = events.abnormal_returns(d.ix)
    ch = index_changes(d)
    e = ch.join(px.select("symbol", F.col("dt").alias("event_dt"), F.col("pos").alias("anchor")), ["symbol", "event_dt"])
    k = F.explode(F.sequence(F.lit(LO), F.lit(HI))).alias("k")
    e = e.select("symbol", "event_dt", "side", "anchor", k).withColumn("at", F.col("anchor") + F.col("k"))
    p = px.filter("abn is not null").select("symbol", F.col("pos").alias("at"), "abn")
    return rounded(events.window_table(e.join(p, ["symbol", "at"])))


@query(
    "hedged_index_short",
    """
WITH f AS (SELECT symbol, dt, lead(adj_close,10) OVER (PARTITION BY symbol ORDER BY day_index)/adj_close-1.0 AS f FROM x_ix)
SELECT c.symbol, c.event_dt AS dt, round(m.f - s.f - 2*0.0014,6)+0.0 AS ret
FROM x_changes c JOIN f s ON s.symbol=c.symbol AND s.dt=c.event_dt JOIN f m ON m.symbol='MKT' AND m.dt=c.event_dt
WHERE c.side='added' AND s.f IS NOT NULL AND m.f IS NOT NULL""",
)
def hedged_index_short(d):
    return rounded(events.hedged_short(d.ix, index_changes(d).filter("side = 'added'")))


# ------------------------------------------------------------- earnings signals
CTES["x_evf"] = """
SELECT *, CASE WHEN np>=4 THEN (surprise_pct-mu)/NULLIF(sd,0) END AS sue, CAST(least(run,8) AS INTEGER) AS beat_streak FROM (
 SELECT *, sum(pos) OVER (PARTITION BY symbol, island ORDER BY o) AS run FROM (
 SELECT *, CASE WHEN surprise_pct>0 THEN 1 ELSE 0 END AS pos,
   avg(surprise_pct) OVER p AS mu, stddev_samp(surprise_pct) OVER p AS sd, count(surprise_pct) OVER p AS np,
   sum(CASE WHEN surprise_pct>0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY o) AS island
 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY tradeable_from, announced_at) AS o
       FROM x_earnings WHERE tradeable_from IS NOT NULL)
 WINDOW p AS (PARTITION BY symbol ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""
CTES["x_evg"] = "SELECT *, sue - lag(sue) OVER (PARTITION BY symbol ORDER BY o) AS surprise_accel FROM x_evf"
CTES["x_evl"] = """
SELECT symbol, tradeable_from, arg_max(ROW(sue, surprise_pct, beat_streak, surprise_accel), announced_at) AS e
FROM x_evg GROUP BY symbol, tradeable_from"""
CTES["x_earn_panel"] = """
SELECT k.*, struct_extract_at(l.e,1) AS sue0, struct_extract_at(l.e,2) AS sp0, struct_extract_at(l.e,3) AS bs0,
  struct_extract_at(l.e,4) AS sa0, l.tradeable_from, k.day_index - b.day_index AS age
FROM x_keys k ASOF LEFT JOIN x_evl l ON k.symbol=l.symbol AND k.dt>=l.tradeable_from
LEFT JOIN x_cal b ON b.dt=l.tradeable_from"""


@query(
    "expanding_z",
    "SELECT symbol, announced_at, tradeable_from, round(sue,6)+0.0 AS sue, beat_streak, round(surprise_accel,6)+0.0 AS surprise_accel FROM x_evg",
)
def expanding_z(d):
    e = earnings.event_features(d.earnings)
    return rounded(e.select("symbol", "announced_at", "tradeable_from", "sue", "beat_streak", "surprise_accel"))


@query(
    "streak",
    """
SELECT symbol, announced_at, beat_streak FROM x_evf""",
)
def streak(d):
    e = d.earnings.filter("tradeable_from is not null")
    return features.streak(e, F.col("surprise_pct") > 0, "beat_streak", order="announced_at").select(
        "symbol", "announced_at", "beat_streak"
    )


@query(
    "earnings_signals",
    """
SELECT symbol, dt, round(CASE WHEN age>250 THEN NULL ELSE sue0 END,6)+0.0 AS sue,
 round(CASE WHEN age>250 THEN NULL ELSE sp0 END,6)+0.0 AS surprise_pct, CASE WHEN age>250 THEN NULL ELSE bs0 END AS beat_streak,
 round(CASE WHEN age>250 THEN NULL ELSE sa0 END,6)+0.0 AS surprise_accel,
 CASE WHEN age BETWEEN 0 AND 60 THEN 1.0e0 ELSE 0.0e0 END AS drift_window, CAST(-age AS INTEGER) AS days_since FROM x_earn_panel""",
)
def earnings_signals(d):
    return rounded(earnings.attach(_keys(d).select("symbol", "dt"), d.earnings, d.calendar))


CTES["x_evr"] = """
SELECT l.symbol, l.tradeable_from, l.e, x.ret FROM x_evl l LEFT JOIN (
 SELECT symbol, dt, adj_close/lag(adj_close) OVER (PARTITION BY symbol ORDER BY day_index)-1.0 AS ret FROM x_ix) x
ON x.symbol=l.symbol AND x.dt=l.tradeable_from"""


@query(
    "event_reaction_signals",
    """
SELECT symbol, dt, round(s,6)+0.0 AS sue, round(p,6)+0.0 AS surprise_pct, round(x,6)+0.0 AS event_reaction, CAST(age AS INTEGER) AS age,
  round(s*sign(x),6)+0.0 AS sue_x_reaction FROM (
SELECT k.symbol, k.dt, k.day_index-b.day_index AS age,
  CASE WHEN k.day_index-b.day_index BETWEEN 0 AND 60 THEN struct_extract_at(l.e,1) END AS s,
  CASE WHEN k.day_index-b.day_index BETWEEN 0 AND 60 THEN struct_extract_at(l.e,2) END AS p,
  CASE WHEN k.day_index-b.day_index BETWEEN 0 AND 60 THEN l.ret END AS x
FROM x_keys k ASOF LEFT JOIN x_evr l ON k.symbol=l.symbol AND k.dt>=l.tradeable_from LEFT JOIN x_cal b ON b.dt=l.tradeable_from)""",
)
def event_reaction_signals(d):
    return rounded(earnings.attach_reaction(_keys(d).select("symbol", "dt"), d.earnings, d.ix, d.calendar))


@query(
    "event_quality_tests",
    """
WITH px AS (SELECT symbol, dt, adj_close/lag(adj_close) OVER w-1.0 AS move, lead(adj_close,60) OVER w/adj_close-1.0 AS drift
  FROM x_ix WINDOW w AS (PARTITION BY symbol ORDER BY day_index)),
j AS (SELECT px.*, e.surprise_pct AS sp FROM px LEFT JOIN x_ev1 e ON e.symbol=px.symbol AND e.tradeable_from=px.dt WHERE move IS NOT NULL),
q AS (SELECT move, drift, greatest(((rn-1)*5+n-2)//NULLIF(n-1,0),1)-1 AS b, greatest(((n-1)*5+n-2)//NULLIF(n-1,0),1)-1 AS tb FROM (
 SELECT *, row_number() OVER (ORDER BY sp, symbol||'|'||dt) AS rn, count(*) OVER () AS n FROM j WHERE sp IS NOT NULL)),
e AS (SELECT avg(move) FILTER (b=tb)-avg(move) FILTER (b=0) AS ms, avg(drift) FILTER (b=tb)-avg(drift) FILTER (b=0) AS ds FROM q)
SELECT count(sp) AS events, round((SELECT ms FROM e),6)+0.0 AS move_spread, round((SELECT ds FROM e),6)+0.0 AS drift_spread, round(corr(sp,move),6)+0.0 AS surprise_move_corr,
 round((SELECT corr(sp,drift) FROM j WHERE sp IS NOT NULL AND drift IS NOT NULL),6)+0.0 AS surprise_drift_corr,
 round(avg(CASE WHEN sp IS NOT NULL THEN CASE WHEN abs(move)<0.005 THEN 1 ELSE 0 END END),6)+0.0 AS share_near_zero,
 round(stddev_samp(CASE WHEN sp IS NOT NULL THEN move END)/stddev_samp(CASE WHEN sp IS NULL THEN move END),6)+0.0 AS event_vol_ratio
FROM j""",
)
def event_quality_tests(d):
    return rounded(earnings.quality_tests(d.earnings.filter("tradeable_from is not null"), d.ix))


# ---------------------------------------------------------- fundamental signals
CONCEPTS = [
    "NetIncomeLoss", "Assets", "StockholdersEquity", "CommonStockSharesOutstanding",
    "NetCashProvidedByUsedInOperatingActivities", "GrossProfit",
]
FLOWS = "('NetIncomeLoss', 'NetCashProvidedByUsedInOperatingActivities', 'GrossProfit')"
CTES["x_f1"] = """
SELECT symbol, concept, filed, period_end, period_start, arg_max(val, fact_id) AS val, max(fact_id) AS tie,
 period_end - period_start AS days FROM x_facts GROUP BY symbol, concept, filed, period_end, period_start"""
CTES["x_known"] = f"""
WITH asks AS (SELECT DISTINCT symbol, concept, filed FROM x_f1),
st AS (SELECT a.symbol, a.concept, a.filed, arg_max(f.val, ROW(f.period_end, f.filed, f.tie)) AS value
  FROM asks a JOIN x_f1 f ON f.symbol=a.symbol AND f.concept=a.concept AND f.filed<=a.filed
  WHERE a.concept NOT IN {FLOWS} GROUP BY ALL),
pv AS (SELECT a.symbol, a.concept, a.filed, f.period_end, CASE WHEN f.days BETWEEN 330 AND 400 THEN 'y' WHEN f.days BETWEEN 60 AND 120 THEN 'q' END AS c,
   arg_max(f.val, ROW(f.filed, f.tie)) AS val
  FROM asks a JOIN x_f1 f ON f.symbol=a.symbol AND f.concept=a.concept AND f.filed<=a.filed
  WHERE a.concept IN {FLOWS} GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, concept, filed, c ORDER BY period_end DESC) AS rn FROM pv WHERE c IS NOT NULL),
fl AS (SELECT symbol, concept, filed, max(CASE WHEN c='y' THEN period_end END) AS ye, max(CASE WHEN c='q' THEN period_end END) AS qe,
   max(CASE WHEN c='y' AND rn=1 THEN val END) AS yv, count(CASE WHEN c='q' AND rn<=4 THEN 1 END) AS nq,
   sum(CASE WHEN c='q' AND rn<=4 THEN val END) AS qv FROM rk GROUP BY symbol, concept, filed)
SELECT symbol, concept, filed, value FROM st
UNION ALL SELECT symbol, concept, filed, CASE WHEN ye IS NOT NULL AND (qe IS NULL OR ye>=qe) THEN yv ELSE qv END
FROM fl WHERE (ye IS NOT NULL AND (qe IS NULL OR ye>=qe)) OR nq>=4"""


@query("fundamentals_known", "SELECT symbol, concept, filed, round(value,2)+0.0 AS value FROM x_known")
def fundamentals_known(d):
    return rounded(fundamentals.known_values(panels.fundamentals(d.spark, d.dir)), 2)


PIV = ", ".join(f"max(CASE WHEN concept='{c}' THEN value END) AS {c}" for c in CONCEPTS)
FILL = ", ".join(
    f"last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY filed ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}"
    for c in CONCEPTS
)
CTES["x_wide"] = f"SELECT symbol, filed, {FILL} FROM (SELECT symbol, filed, {PIV} FROM x_known GROUP BY symbol, filed)"


@query("ffill", f"SELECT symbol, filed, {r(' '.join(CONCEPTS), 2)} FROM x_wide")
def ffill(d):
    k = fundamentals.known_values(panels.fundamentals(d.spark, d.dir))
    return rounded(fundamentals.wide_facts(k, CONCEPTS), 2)


CTES["x_fund_panel"] = """
SELECT k.symbol, k.dt, k.day_index, k.close, w.*EXCLUDE (symbol, filed),
  lag(w.Assets,252) OVER (PARTITION BY k.symbol ORDER BY k.day_index) AS assets_1y,
  NULLIF(w.CommonStockSharesOutstanding*k.close,0) AS mcap
FROM x_keys k ASOF LEFT JOIN x_wide w ON k.symbol=w.symbol AND k.dt>=w.filed"""
FUND = """round(NetIncomeLoss/mcap,9)+0.0 AS earnings_yield, round(StockholdersEquity/mcap,9)+0.0 AS book_to_price,
 round(NetIncomeLoss/NULLIF(StockholdersEquity,0),6)+0.0 AS roe, round(-((NetIncomeLoss-NetCashProvidedByUsedInOperatingActivities)/NULLIF(Assets,0)),6)+0.0 AS accruals,
 round(-(Assets/NULLIF(assets_1y,0)-1.0),6)+0.0 AS asset_growth, round(GrossProfit/NULLIF(Assets,0),6)+0.0 AS gross_profitability"""


@query("fundamental_signals", f"SELECT symbol, dt, {FUND} FROM x_fund_panel")
def fundamental_signals(d):
    wide = fundamentals.wide_facts(
        fundamentals.known_values(panels.fundamentals(d.spark, d.dir)), CONCEPTS
    )
    p = fundamentals.attach_ratios(_keys(d), wide, CONCEPTS)
    return rounded(p.select("symbol", "dt", *fundamentals.SIGNALS), earnings_yield=9, book_to_price=9)


@query(
    "growth_1y",
    "SELECT symbol, dt, round(Assets,2)+0.0 AS assets, round(Assets/NULLIF(assets_1y,0)-1.0,6)+0.0 AS growth_1y FROM x_fund_panel",
)
def growth_1y(d):
    from ..functions import lagged

    known = fundamentals.known_values(panels.fundamentals(d.spark, d.dir).filter("concept = 'Assets'"))
    p = asof.asof_backward(_keys(d), known, "filed", ["value"])
    return rounded(
        p.select(
            "symbol", "dt", F.col("value").alias("assets"),
            (F.try_divide("value", lagged("value", 252)) - 1.0).alias("growth_1y"),
        ),
        assets=2,
    )


# ------------------------------------------------------------------ alt signals
CTES["x_flow"] = """
SELECT k.symbol, k.dt, k.day_index, coalesce(sum(CASE WHEN v.trans_code='P' THEN v.usd END),0) AS buy_usd,
  coalesce(sum(CASE WHEN v.trans_code='S' THEN v.usd END),0) AS sell_usd, count(CASE WHEN v.trans_code='P' THEN 1 END) AS n_buys
FROM x_keys k LEFT JOIN (SELECT v.symbol, c.day_index AS fi, v.trans_code, sum(v.usd) AS usd, 1 AS one FROM x_valued v
   JOIN x_cal c ON c.dt=v.filing_date GROUP BY v.symbol, c.day_index, v.trans_code, v.accession) v
  ON v.symbol=k.symbol AND v.fi BETWEEN k.day_index-90 AND k.day_index GROUP BY k.symbol, k.dt, k.day_index"""


@query(
    "trailing_event_sum",
    """
SELECT symbol, dt, round(buy_usd,3)+0.0 AS buy_usd, round(sell_usd,3)+0.0 AS sell_usd, n_buys FROM (
 SELECT k.symbol, k.dt, coalesce(sum(v.buy),0) AS buy_usd, coalesce(sum(v.sell),0) AS sell_usd, CAST(coalesce(sum(v.nb),0) AS BIGINT) AS n_buys
 FROM x_keys k LEFT JOIN x_flow_day v ON v.symbol=k.symbol AND v.fi BETWEEN k.day_index-90 AND k.day_index GROUP BY k.symbol, k.dt)""",
)
def trailing_event_sum(d):
    t = alt.value_at_market(panels.insider_trades(d.spark, d.dir), d.bars)
    p = alt.insider_flows(_keys(d).select("symbol", "dt", "day_index"), t, d.calendar)
    return rounded(p.select("symbol", "dt", "buy_usd", "sell_usd", "n_buys"), 3)


CTES["x_flow_day"] = """
SELECT v.symbol, c.day_index AS fi, sum(CASE WHEN trans_code='P' THEN usd ELSE 0 END) AS buy,
  sum(CASE WHEN trans_code='S' THEN usd ELSE 0 END) AS sell, count(CASE WHEN trans_code='P' THEN 1 END) AS nb
FROM x_valued v JOIN x_cal c ON c.dt=v.filing_date GROUP BY 1, 2"""
CTES.pop("x_flow")
CTES["x_adv"] = """
SELECT symbol, dt, day_index, CASE WHEN count(*) OVER w = 20 THEN avg(close*volume) OVER w END AS adv
FROM x_ix WINDOW w AS (PARTITION BY symbol ORDER BY day_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
CTES["x_alt"] = """
SELECT f.*, s.short_shares/(NULLIF(s.avg_daily_vol,0)*21) AS sr, (s.short_shares-s.prev_short)/NULLIF(s.prev_short,0) AS sc, s.days_to_cover AS dc
FROM (SELECT k.symbol, k.dt, k.day_index, a.adv, coalesce(sum(v.buy),0) AS buy_usd, coalesce(sum(v.sell),0) AS sell_usd, coalesce(sum(v.nb),0) AS nb
  FROM x_keys k JOIN x_adv a ON a.symbol=k.symbol AND a.dt=k.dt
  LEFT JOIN x_flow_day v ON v.symbol=k.symbol AND v.fi BETWEEN k.day_index-90 AND k.day_index GROUP BY ALL) f
ASOF LEFT JOIN x_short1 s ON s.symbol=f.symbol AND f.dt>=s.tradeable_from"""


@query(
    "alt_signals",
    """SELECT symbol, dt, round(buy_usd/(adv*90),6)+0.0 AS insider_buy_intensity, round((buy_usd-sell_usd)/(adv*90),6)+0.0 AS insider_net_flow,
 CAST(nb AS DOUBLE) AS insider_buyer_breadth, round(-sr,6)+0.0 AS short_ratio, round(-sc,6)+0.0 AS short_change, round(-dc,6)+0.0 AS days_to_cover FROM x_alt""",
)
def alt_signals(d):
    from .history import with_adv

    p = with_adv(d.ix.filter("kind = 'stock'")).select("symbol", "dt", "day_index", "adv")
    t = alt.value_at_market(panels.insider_trades(d.spark, d.dir), d.bars)
    a = alt.attach(p, t, _short(d), d.calendar)
    return rounded(a.select("symbol", "dt", *alt.SIGNALS))


@query(
    "model_rows",
    f"""SELECT p.symbol, p.dt, p.day_index, p.bar_num, {r('mom_21d mom_126d vol_20_annual rel_volume mkt_ret_1d mom_21d_xs_rank fwd_ret_5d fwd_ret_5d_net fwd_mae_5d next_open')},
 label_win_5d FROM x_panel p JOIN (SELECT * EXCLUDE (day_index) FROM x_labels) l ON l.symbol=p.symbol AND l.dt=p.dt
 WHERE p.bar_num>200 AND vol_20_annual IS NOT NULL AND mom_126d IS NOT NULL AND rel_volume IS NOT NULL AND mkt_ret_1d IS NOT NULL AND label_win_5d IS NOT NULL""",
)
def model_rows(d):
    m = labels.model_rows(d.panel, d.labels)
    return rounded(
        m.select(
            "symbol", "dt", "day_index", "bar_num", "mom_21d", "mom_126d", "vol_20_annual", "rel_volume",
            "mkt_ret_1d", "mom_21d_xs_rank", "fwd_ret_5d", "fwd_ret_5d_net", "fwd_mae_5d", "next_open", "label_win_5d",
        )
    )
