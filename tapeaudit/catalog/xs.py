"""Queries over the cross-section: z-scores, ranks, residuals, books and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import MARKET
from ..functions import cut, dealt, lagged, settle
from ..operators import books, entities, features, inference, labels, perf, quality, ranking, xsection
from ..sources import panels
from .base import CTES, query, r, rounded

SIG = ["mom126", "reversal5", "low_vol63"]
FACTORS = ["beta", "size", "mom126"]
CARRY = ["symbol", "dt", "day_index", "sector", "close", "beta", "size", "mom126", "vol63", "half_bps", "ret", "fwd_21"]
H, Q = 21, 5

CTES["x_w"] = "SELECT *, -vol63 AS low_vol63 FROM x_wresearch WHERE adv IS NOT NULL"
CTES["x_wz"] = "SELECT *, " + ", ".join(
    f"round(({s}-avg({s}) OVER g)/NULLIF(stddev_samp({s}) OVER g,0),9)+0.0 AS z_{s}" for s in SIG
) + " FROM x_w WINDOW g AS (PARTITION BY dt, sector)"
CTES["x_wl"] = " UNION ALL ".join(
    f"SELECT '{s}' AS signal, z_{s} AS score, {', '.join(CARRY)} FROM x_wz" for s in SIG
)


def wide(d):
    p = features.research_panel(d.wix, (H,)).filter("adv is not null")
    return p.withColumn("low_vol63", -F.col("vol63"))


def zscored(d):
    # all windows by date and sector that follow find their rows together
    p = dealt(wide(d), d.wide_rows, "dt", "sector")
    p = xsection.zscore(p, ["dt", "sector"], SIG, width=d.wide_names)
    return p.withColumns({"z_" + s: settle("z_" + s, 9) for s in SIG})


def long_scores(d):
    p = zscored(d)
    carry = [F.col(c) for c in CARRY]
    both = F.explode(
        F.array(*[F.struct(F.lit(s).alias("signal"), F.col("z_" + s).alias("score")) for s in SIG])
    ).alias("s")
    return p.select(*carry, both).select("s.signal", "s.score", *CARRY)


@query("xs_zscore", f"SELECT symbol, dt, sector, {r(' '.join('z_' + s for s in SIG))} FROM x_wz")
def xs_zscore(d):
    return rounded(zscored(d).select("symbol", "dt", "sector", *["z_" + s for s in SIG]))


CTES["x_xsr"] = """
SELECT signal, symbol, dt, score, percent_rank() OVER (PARTITION BY signal, dt ORDER BY score NULLS FIRST) AS pr,
  count(*) OVER (PARTITION BY signal, dt) AS candidates FROM x_wl"""


@query("xs_percent_rank", "SELECT signal, symbol, dt, round(pr,6)+0.0 AS pr, candidates FROM x_xsr")
def xs_percent_rank(d):
    p = long_scores(d).select("signal", "symbol", "dt", "score")
    c = ranking.with_counts(p, ["signal", "dt"], "score", d.wide_names)
    pr = F.when(F.col("n") > 1, F.col("less") / (F.col("n") - 1)).otherwise(0.0)
    return rounded(c.select("signal", "symbol", "dt", pr.alias("pr"), F.col("n").alias("candidates")))


@query("xs_percent_rank_unbounded", "SELECT signal, symbol, dt, round(pr,6)+0.0 AS pr, candidates FROM x_xsr")
def xs_percent_rank_unbounded(d):
    """The same ranks without a bound on the width: no date is gathered in one task."""
    p = long_scores(d).select("signal", "symbol", "dt", "score")
    c = ranking.with_counts(p, ["signal", "dt"], "score", None)
    pr = F.when(F.col("n") > 1, F.col("less") / (F.col("n") - 1)).otherwise(0.0)
    return rounded(c.select("signal", "symbol", "dt", pr.alias("pr"), F.col("n").alias("candidates")))


def bucket_sql(src: str, cell: str, q: str, min_n: int, where: str = "score IS NOT NULL") -> str:
    return f"""
SELECT *, CAST(greatest(((rn-1)*q+n-2)//(n-1),1)-1 AS INTEGER) AS bucket, CAST(greatest(((n-1)*q+n-2)//(n-1),1)-1 AS INTEGER) AS top_bucket
FROM (SELECT *, {q} AS q FROM (SELECT *, row_number() OVER (PARTITION BY {cell} ORDER BY score, symbol) AS rn,
      count(*) OVER (PARTITION BY {cell}) AS n FROM {src} WHERE {where})) WHERE n>={min_n}"""


ADAPT = "least(5,greatest(2,n//5))"
CTES["x_b_dt"] = bucket_sql("x_wl", "signal, dt", "5", 50, "score IS NOT NULL AND fwd_21 IS NOT NULL")
CTES["x_b_sec"] = bucket_sql("x_wl", "signal, dt, sector", ADAPT, 10, "score IS NOT NULL AND fwd_21 IS NOT NULL")


@query("xs_bucket", "SELECT signal, symbol, dt, sector, bucket, top_bucket FROM x_b_sec")
def xs_bucket(d):
    p = long_scores(d).filter("fwd_21 is not null")
    b = xsection.with_bucket(p, ["signal", "dt", "sector"], "score", Q, adaptive=True, min_names=10, width=d.wide_names)
    return b.select("signal", "symbol", "dt", "sector", "bucket", "top_bucket")


@query("xs_bucket_unbounded", "SELECT signal, symbol, dt, bucket, top_bucket FROM x_b_dt")
def xs_bucket_unbounded(d):
    p = long_scores(d).filter("fwd_21 is not null").select("signal", "symbol", "dt", "score")
    b = xsection.with_bucket(p, ["signal", "dt"], "score", Q, min_names=50)
    return b.select("signal", "symbol", "dt", "bucket", "top_bucket")


CTES["x_ic"] = """
SELECT signal, dt, count(*) AS names, corr(a,b) AS ic FROM (
 SELECT signal, dt, rank() OVER (PARTITION BY signal, dt ORDER BY score) + (count(*) OVER (PARTITION BY signal, dt, score)-1)/2 AS a,
  rank() OVER (PARTITION BY signal, dt ORDER BY fwd_21) + (count(*) OVER (PARTITION BY signal, dt, fwd_21)-1)/2 AS b
 FROM x_wl WHERE score IS NOT NULL AND fwd_21 IS NOT NULL) GROUP BY signal, dt HAVING count(*)>=50"""


def ic_of(d, p=None, score="score"):
    p = long_scores(d) if p is None else p
    return xsection.rank_ic(p, score, "fwd_21", ["signal", "dt"], 50, d.wide_names)


@query("rank_ic", "SELECT signal, dt, names, round(ic,6)+0.0 AS ic FROM x_ic")
def rank_ic(d):
    return rounded(ic_of(d))


IC_SUM = """SELECT signal, count(*) AS n_dates, round(avg(ic),6)+0.0 AS ic_mean, round(stddev_samp(ic),6)+0.0 AS ic_std,
 round(avg(ic)/stddev_samp(ic)*sqrt(252/21.0),6)+0.0 AS ic_ir, round(avg(CASE WHEN ic>0 THEN 1 ELSE 0 END),6)+0.0 AS ic_positive,
 count(CASE WHEN k THEN ic END) AS n_nonoverlap,
 round(avg(CASE WHEN k THEN ic END)/(stddev_samp(CASE WHEN k THEN ic END)/sqrt(count(CASE WHEN k THEN ic END))),6)+0.0 AS ic_t
FROM (SELECT *, (row_number() OVER (PARTITION BY signal ORDER BY dt)-1)%21=0 AS k FROM x_ic) GROUP BY signal"""


@query("ic_summary", IC_SUM)
def ic_summary(d):
    return rounded(perf.ic_summary(ic_of(d), H))


CTES["x_qs"] = """
SELECT signal, dt, avg(CASE WHEN bucket=4 THEN fwd_21 END)-avg(CASE WHEN bucket=0 THEN fwd_21 END)-0.0028 AS ret FROM x_b_dt GROUP BY signal, dt"""


@query("quantile_spread", "SELECT signal, dt, round(ret,6)+0.0 AS ret FROM x_qs WHERE ret IS NOT NULL")
def quantile_spread(d):
    return rounded(xsection.quantile_spread(long_scores(d), "score", "fwd_21", Q, ["signal", "dt"], width=d.wide_names))


@query(
    "composite",
    """SELECT symbol, dt, round((coalesce(z_mom126,0)+coalesce(z_reversal5,0)+coalesce(z_low_vol63,0))/NULLIF(
 CASE WHEN z_mom126 IS NULL THEN 0 ELSE 1 END + CASE WHEN z_reversal5 IS NULL THEN 0 ELSE 1 END + CASE WHEN z_low_vol63 IS NULL THEN 0 ELSE 1 END,0),6)+0.0 AS skip_null,
 round((z_mom126+z_reversal5-z_low_vol63)/3,6)+0.0 AS plain FROM x_wz""",
)
def composite(d):
    z = ["z_" + s for s in SIG]
    return rounded(
        zscored(d).select(
            "symbol", "dt", xsection.composite(z).alias("skip_null"),
            xsection.composite(z, {"z_low_vol63": -1}, skip_null=False).alias("plain"),
        )
    )


# ----------------------------------------------------------------------- books
CTES["x_book"] = """
SELECT signal, dt, avg(l-s) - 0.0028 AS ret FROM (
 SELECT signal, dt, sector, avg(CASE WHEN bucket=top_bucket THEN fwd_21 END) AS l, avg(CASE WHEN bucket=0 THEN fwd_21 END) AS s
 FROM x_b_sec GROUP BY signal, dt, sector) GROUP BY signal, dt"""


def sector_book(d, p=None, by=("signal",), score="score"):
    p = long_scores(d) if p is None else p
    return books.book_sector_neutral(p, score, "fwd_21", Q, by, width=d.wide_names)


@query("book_sector_neutral", "SELECT signal, dt, round(ret,6)+0.0 AS ret FROM x_book")
def book_sector_neutral(d):
    return rounded(sector_book(d))


CTES["x_bookc"] = """
SELECT signal, dt, avg(l-s) AS gross, avg(l-s-cl-cs) AS net FROM (
 SELECT signal, dt, sector, avg(CASE WHEN bucket=top_bucket THEN fwd_21 END) AS l, avg(CASE WHEN bucket=0 THEN fwd_21 END) AS s,
  avg(CASE WHEN bucket=top_bucket THEN 2*half_bps/10000 END) AS cl, avg(CASE WHEN bucket=0 THEN 2*half_bps/10000 END) AS cs
 FROM x_b_sec GROUP BY signal, dt, sector) GROUP BY signal, dt"""


@query("book_costed", "SELECT signal, dt, round(gross,6)+0.0 AS gross, round(net,6)+0.0 AS net FROM x_bookc")
def book_costed(d):
    return rounded(books.book_costed(long_scores(d), "score", "fwd_21", q=Q, by=["signal"], width=d.wide_names))


CTES["x_wb2"] = bucket_sql("x_wl", "signal, dt, sector", ADAPT, 2)


def weight_sql(raw: str, src: str) -> str:
    return f"""
SELECT *, coalesce(w1/NULLIF(sum(abs(w1)) OVER (PARTITION BY signal, dt),0),0) AS w FROM (
SELECT *, coalesce(w0/NULLIF(sum(abs(w0)) OVER (PARTITION BY signal, dt, sector),0),0) AS w1 FROM (
SELECT *, coalesce({raw},0) AS w0 FROM {src}))"""


DEV = "(score-avg(score) OVER (PARTITION BY signal, dt, sector))"
CTES["x_wt_quintile"] = weight_sql("CASE WHEN bucket=0 THEN -1.0e0 WHEN bucket=top_bucket THEN 1.0e0 ELSE 0.0e0 END", "x_wb2")
CTES["x_wt_signal"] = weight_sql(DEV, "x_wl")
CTES["x_wt_risk"] = weight_sql(f"{DEV}/NULLIF(vol63,0)", "x_wl")


def _weights(name, method):
    where = " WHERE score IS NOT NULL" if method == "quintile" else ""

    @query(f"weights_{name}", f"SELECT signal, symbol, dt, round(w,6)+0.0 AS w FROM x_wt_{method}{where}")
    def run(d):
        w = books.weights(long_scores(d), "score", method, Q, ["signal"], width=d.wide_names)
        return rounded(w.select("signal", "symbol", "dt", "w"))

    return run


_weights("quintile", "quintile")
_weights("signal", "signal")
_weights("risk", "risk")


@query(
    "book_weighted",
    """SELECT signal, dt, round(sum(w*fwd_21),6)+0.0 AS gross, round(sum(w*fwd_21-abs(w)*2*half_bps/10000),6)+0.0 AS net
FROM x_wt_risk GROUP BY signal, dt""",
)
def book_weighted(d):
    w = books.weights(long_scores(d), "score", "risk", Q, ["signal"], width=d.wide_names)
    return rounded(books.book_weighted(w, "fwd_21", by=["signal"]))


# ------------------------------------------------------------------- residuals
CTES["x_cc"] = """
SELECT signal, symbol, dt, day_index, sector, score, half_bps, vol63, fwd_21, close, ret, score-avg(score) OVER g AS y, beta-avg(beta) OVER g AS x1,
 size-avg(size) OVER g AS x2, mom126-avg(mom126) OVER g AS x3, count(*) OVER (PARTITION BY signal, dt) AS nn
FROM x_wl WHERE score IS NOT NULL AND beta IS NOT NULL AND size IS NOT NULL AND mom126 IS NOT NULL
WINDOW g AS (PARTITION BY signal, dt, sector)"""
CTES["x_gs2"] = "SELECT *, x2 - x1*(sum(x2*x1) OVER d/NULLIF(sum(x1*x1) OVER d,0)) AS e2 FROM x_cc WHERE nn>=40 WINDOW d AS (PARTITION BY signal, dt)"
CTES["x_gs3"] = """SELECT *, x3 - x1*(sum(x3*x1) OVER d/NULLIF(sum(x1*x1) OVER d,0)) - e2*(sum(x3*e2) OVER d/NULLIF(sum(e2*e2) OVER d,0)) AS e3
FROM x_gs2 WINDOW d AS (PARTITION BY signal, dt)"""
CTES["x_resid"] = """SELECT *, round(y - x1*(sum(y*x1) OVER d/NULLIF(sum(x1*x1) OVER d,0)) - e2*(sum(y*e2) OVER d/NULLIF(sum(e2*e2) OVER d,0))
 - e3*(sum(y*e3) OVER d/NULLIF(sum(e3*e3) OVER d,0)),8)+0.0 AS resid FROM x_gs3 WINDOW d AS (PARTITION BY signal, dt)"""


def residuals(d, p=None):
    p = long_scores(d).select("signal", "symbol", "dt", "sector", "score", "half_bps", "fwd_21", *FACTORS) if p is None else p
    e = xsection.residualize(p, "score", FACTORS, ["signal", "dt"], sector="sector", min_names=40, width=d.wide_names)
    return e.withColumn("resid", settle("resid", 8))


@query(
    "residualize",
    "SELECT signal, symbol, dt, round(resid,6)+0.0 AS resid FROM x_resid",
)
def residualize(d):
    return rounded(residuals(d).filter("resid is not null").select("signal", "symbol", "dt", "resid"))


@query(
    "resid_r2",
    """SELECT signal, round(var_pop(score),6)+0.0 AS var_before, round(var_pop(resid),6)+0.0 AS var_after,
 round(1-var_pop(resid)/var_pop(score),6)+0.0 AS r2_removed, round(sqrt(var_pop(resid)),6)+0.0 AS resid_std
FROM x_resid GROUP BY signal""",
)
def resid_r2(d):
    return rounded(xsection.resid_r2(residuals(d), "score"))


CTES["x_auto"] = """
SELECT signal, score, lag(score,21) OVER (PARTITION BY signal, symbol ORDER BY day_index) AS l FROM x_wl"""


@query(
    "score_autocorr",
    "SELECT signal, count(*) AS pairs, round(CASE WHEN count(*)>=1000 THEN corr(score,l) END,6)+0.0 AS rho FROM x_auto WHERE score IS NOT NULL AND l IS NOT NULL GROUP BY signal",
)
def score_autocorr(d):
    return rounded(xsection.score_autocorr(long_scores(d), "score", H, ["signal"]))


# --------------------------------------------------------------------- spreads
CTES["x_cs"] = """
SELECT symbol, dt, CASE WHEN s<0 THEN 0 ELSE s END AS spread FROM (
SELECT *, 2*(exp(alpha)-1)/(1+exp(alpha)) AS s FROM (
SELECT *, (sqrt(2*b)-sqrt(b))/(3-2*sqrt(2.0e0)) - sqrt(g/(3-2*sqrt(2.0e0))) AS alpha FROM (
SELECT *, hl+lag(hl) OVER w AS b, CASE WHEN lag(ha) OVER w IS NOT NULL THEN pow(ln(greatest(ha,lag(ha) OVER w)/least(la,lag(la) OVER w)),2) END AS g FROM (
SELECT *, pow(ln(ha/la),2) AS hl FROM (
SELECT symbol, dt, day_index, CASE WHEN prev_close IS NOT NULL THEN greatest(high,prev_close) END AS ha,
 CASE WHEN prev_close IS NOT NULL THEN least(low,prev_close) END AS la FROM x_ret)) WINDOW w AS (PARTITION BY symbol ORDER BY day_index))))"""
CTES["x_csm"] = """
SELECT symbol, strftime(dt,'%Y-%m') AS month, least(greatest(median(spread)*10000,1.0),1000.0) AS spread_bps
FROM x_cs WHERE spread IS NOT NULL GROUP BY 1, 2"""


@query("corwin_schultz", "SELECT symbol, dt, round(spread,6)+0.0 AS spread FROM x_cs")
def corwin_schultz(d):
    return rounded(books.corwin_schultz(d.ix).select("symbol", "dt", "spread"))


@query("spread_monthly", "SELECT symbol, month, round(spread_bps,6)+0.0 AS spread_bps FROM x_csm")
def spread_monthly(d):
    return rounded(books.spread_monthly(d.ix).filter("spread_bps is not null"))


@query(
    "spread_calibrated",
    """
SELECT m.symbol, m.month, round(m.spread_bps,6)+0.0 AS spread_bps, round(least(greatest(2.0*m.spread_bps/NULLIF(a.anchor,0),1.0),150.0),6)+0.0 AS half_spread_bps
FROM x_csm m LEFT JOIN (SELECT month, median(spread_bps) AS anchor FROM x_csm WHERE symbol IN
 (SELECT symbol FROM x_symbols WHERE inclusion_reason='S&P 500') GROUP BY month) a ON a.month=m.month""",
)
def spread_calibrated(d):
    large = d.symbols.filter("inclusion_reason = 'S&P 500'")
    return rounded(books.spread_calibrated(books.spread_monthly(d.ix).filter("spread_bps is not null"), large))


# ------------------------------------------------------------------ live books
CTES["x_live"] = """
SELECT *, avg(z) OVER () AS mz, avg(beta) OVER () AS mb, avg(size) OVER () AS ms FROM (
SELECT *, (mom126-avg(mom126) OVER (PARTITION BY sector))/NULLIF(stddev_samp(mom126) OVER (PARTITION BY sector),0) AS z
FROM x_w WHERE dt=(SELECT max(dt) FROM (SELECT dt FROM x_w WHERE mom126 IS NOT NULL AND beta IS NOT NULL AND size IS NOT NULL GROUP BY dt HAVING count(*)>=50))
 AND mom126 IS NOT NULL AND beta IS NOT NULL AND size IS NOT NULL) WHERE z IS NOT NULL"""
CTES["x_live2"] = """
SELECT symbol, dt, sector, close, y - x1*(sum(y*x1) OVER ()/sum(x1*x1) OVER ()) - e2*(sum(y*e2) OVER ()/sum(e2*e2) OVER ()) AS score FROM (
SELECT *, x2 - x1*(sum(x2*x1) OVER ()/sum(x1*x1) OVER ()) AS e2 FROM (SELECT *, z-mz AS y, beta-mb AS x1, size-ms AS x2 FROM x_live))"""
CTES["x_live3"] = bucket_sql("x_live2", "sector", ADAPT, 2)


@query(
    "live_book",
    """SELECT symbol, dt, sector, round(score,6)+0.0 AS res, round(close,6)+0.0 AS close, CAST(side AS INTEGER) AS side,
 round(side*100000.0e0/count(*) OVER (),4)+0.0 AS usd, CAST(side*round_even(100000.0e0/count(*) OVER ()/close,0) AS BIGINT) AS shares
FROM (SELECT *, CASE WHEN bucket=0 THEN -1 WHEN bucket=top_bucket THEN 1 END AS side FROM x_live3) WHERE side IS NOT NULL""",
)
def live_book(d):
    b = books.live_book(wide(d), "mom126", ["beta", "size"], 100_000, min_names=50, width=d.wide_names)
    return rounded(b, usd=4)


@query(
    "live_capacity",
    """SELECT count(*) AS names, CAST(coalesce(sum(CASE WHEN shares=0 THEN 1 ELSE 0 END),0) AS BIGINT) AS zero_shares, round(median(close),6)+0.0 AS median_price,
 round(median(close)*10*count(*),6)+0.0 AS min_gross_usd, CAST(coalesce(sum(CASE WHEN shares=0 THEN 1 ELSE 0 END),0)>count(*)*0.05 AS INTEGER) AS too_small FROM (
SELECT close, side*round_even(100000.0e0/count(*) OVER ()/close,0) AS shares
FROM (SELECT *, CASE WHEN bucket=0 THEN -1 WHEN bucket=top_bucket THEN 1 END AS side FROM x_live3) WHERE side IS NOT NULL)""",
)
def live_capacity(d):
    """An empty book has no names, no price and is not too small."""
    return rounded(books.capacity(books.live_book(wide(d), "mom126", ["beta", "size"], 100_000, min_names=50, width=d.wide_names)))


@query(
    "index_event_book",
    """
WITH a AS (SELECT symbol FROM x_snap WHERE snapshot='now' EXCEPT SELECT symbol FROM x_snap WHERE snapshot='before'),
l AS (SELECT symbol, arg_max(close, dt) AS close FROM x_bars GROUP BY symbol),
s AS (SELECT a.symbol, 'short' AS side, -10000.0e0/(2*(SELECT count(*) FROM a)) AS usd, close,
  CAST(round_even(10000.0e0/(2*(SELECT count(*) FROM a))/close,0) AS BIGINT) AS shares FROM a JOIN l ON l.symbol=a.symbol)
SELECT symbol, side, round(usd,6)+0.0 AS usd, round(close,6)+0.0 AS close, shares FROM s
UNION ALL SELECT 'MKT','long', round(-sum(usd),6)+0.0, NULL, NULL FROM s HAVING count(*)>0""",
)
def index_event_book(d):
    ch = quality.snapshot_diff(panels.snapshots(d.bars))
    return rounded(books.index_event_book(ch, quality.latest_row(d.bars), 10_000, MARKET))


# ------------------------------------------------------------------ statistics
STATS = """
SELECT {k}, count(*) AS dates, round(avg(ret)*12.0,6)+0.0 AS ret_ann, count(rr) AS n, round(CASE WHEN count(rr)>=3 THEN stddev_samp(rr)*sqrt(12.0e0) END,6)+0.0 AS vol,
 round(CASE WHEN count(rr)>=3 THEN avg(rr)/stddev_samp(rr)*sqrt(12.0e0) END,6)+0.0 AS sharpe,
 round(CASE WHEN count(rr)>=3 THEN avg(rr)/(stddev_samp(rr)/sqrt(count(rr))) END,6)+0.0 AS t,
 round(max((pk-eq)/NULLIF(pk,0)),6)+0.0 AS max_dd FROM (
 SELECT *, CASE WHEN kk THEN max(CASE WHEN kk THEN eq END) OVER (PARTITION BY {k} ORDER BY dt ROWS UNBOUNDED PRECEDING) END AS pk FROM (
 SELECT *, CASE WHEN kk THEN ret END AS rr, CASE WHEN kk THEN product(CASE WHEN kk THEN 1+ret ELSE 1 END) OVER (PARTITION BY {k} ORDER BY dt ROWS UNBOUNDED PRECEDING) END AS eq
 FROM (SELECT *, (row_number() OVER (PARTITION BY {k} ORDER BY dt)-1)%21=0 AS kk FROM {src} WHERE ret IS NOT NULL))) GROUP BY {k}"""


@query("nonoverlap", "SELECT signal, dt, round(ret,6)+0.0 AS ret FROM (SELECT *, (row_number() OVER (PARTITION BY signal ORDER BY dt)-1)%21=0 AS k FROM x_book) WHERE k")
def nonoverlap(d):
    return rounded(perf.nonoverlap(sector_book(d), H, ["signal"]).select("signal", "dt", "ret"))


@query("perf_stats", STATS.format(k="signal", src="x_book"))
def perf_stats(d):
    return rounded(perf.perf_stats(sector_book(d), H, ["signal"]))


@query(
    "yearly_sharpe",
    """SELECT signal, CAST(year AS INTEGER) AS year, count(rr) AS n, round(CASE WHEN count(rr)>=3 THEN avg(rr)/stddev_samp(rr)*sqrt(12.0e0) END,6)+0.0 AS sharpe FROM (
SELECT signal, year(dt) AS year, CASE WHEN (row_number() OVER (PARTITION BY signal, year(dt) ORDER BY dt)-1)%21=0 THEN ret END AS rr FROM x_book WHERE ret IS NOT NULL) GROUP BY 1, 2""",
)
def yearly_sharpe(d):
    return rounded(perf.yearly_sharpe(sector_book(d), H, ["signal"]))


CTES["x_regflag"] = """
SELECT dt, adj_close>sma AS above, coalesce(np>=25 AND vol63>hi, false) AS vol_hi, coalesce(np>=25 AND vol63<lo, false) AS vol_lo FROM (
SELECT *, count(vol63) OVER p AS np, quantile_cont(vol63,0.667) OVER p AS hi, quantile_cont(vol63,0.333) OVER p AS lo FROM (
SELECT *, CASE WHEN bn>=200 THEN avg(adj_close) OVER (ORDER BY day_index ROWS 199 PRECEDING) END AS sma,
 CASE WHEN bn>=64 THEN stddev_samp(ret_1d) OVER (ORDER BY day_index ROWS 62 PRECEDING)*sqrt(252.0) END AS vol63
FROM x_wret WHERE symbol='MKT') WINDOW p AS (ORDER BY day_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
CTES["x_regcell"] = """
SELECT signal || '|' || regime AS k, b.signal, regime, b.dt, b.ret FROM x_book b LEFT JOIN x_regflag f ON f.dt=b.dt
JOIN (VALUES ('all'),('above_200d'),('below_200d'),('high_vol'),('low_vol')) v(regime) ON
 CASE regime WHEN 'all' THEN true WHEN 'above_200d' THEN coalesce(f.above,false) WHEN 'below_200d' THEN NOT coalesce(f.above,false)
  WHEN 'high_vol' THEN coalesce(f.vol_hi,false) ELSE coalesce(f.vol_lo,false) END"""


@query(
    "by_regime",
    "SELECT split_part(k,'|',1) AS signal, split_part(k,'|',2) AS regime, dates, ret_ann, n, sharpe, t FROM ("
    + STATS.format(k="k", src="x_regcell") + ") WHERE dates>=63",
)
def by_regime(d):
    flags = features.market_regimes(d.wix, min_obs=25).drop("vol63")
    return rounded(perf.by_regime(sector_book(d), flags, H, ["signal"]))


CTES["x_iv"] = """
SELECT signal, dt, ret, CASE WHEN np>=63 THEN 1/NULLIF(sd,0) END AS i FROM (
SELECT *, count(ret) OVER p AS np, stddev_samp(ret) OVER p AS sd FROM x_book WINDOW p AS (PARTITION BY signal ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("invvol_weights", "SELECT signal, dt, round(ret,6)+0.0 AS ret, round(i/sum(i) OVER (PARTITION BY dt),6)+0.0 AS weight FROM x_iv")
def invvol_weights(d):
    return rounded(perf.invvol_weights(sector_book(d), H, "signal").select("signal", "dt", "ret", "weight"))


CTES["x_icm"] = "SELECT signal, avg(ic) AS ic FROM x_ic GROUP BY signal"
CTES["x_stat"] = STATS.format(k="signal", src="x_book")


@query(
    "breadth_realised",
    """
SELECT s.signal, round(i.ic,6)+0.0 AS ic, s.sharpe, round(CASE WHEN abs(i.ic)>1e-6 THEN pow(s.sh/i.ic,2) END,2)+0.0 AS breadth, round(i.ic*sqrt(e.n_eff*252/21.0e0),6)+0.0 AS ir_predicted,
 round(e.n_eff*greatest(252/21.0e0*(1-c)/(1+c),0.1),4)+0.0 AS breadth_adj
FROM (SELECT signal, sharpe, sh FROM (SELECT signal, round(sh,6)+0.0 AS sharpe, sh FROM x_sh)) s JOIN x_icm i USING (signal)
JOIN (SELECT signal, greatest(least(corr(score,l),0.99),-0.99) AS c FROM x_auto WHERE score IS NOT NULL AND l IS NOT NULL GROUP BY signal) a USING (signal)
CROSS JOIN (SELECT pow(count(DISTINCT symbol),2)/(SELECT sum(rho*rho) FROM (SELECT a.symbol, b.symbol, corr(a.neutral, b.neutral) AS rho FROM x_pr1 a JOIN x_pr1 b ON a.dt=b.dt GROUP BY a.symbol, b.symbol)) AS n_eff FROM x_pr1) e""",
)
def breadth_realised(d):
    p = cut(long_scores(d).select("signal", "symbol", "dt", "day_index", "sector", "score", "fwd_21"))
    st = perf.perf_stats(sector_book(d, p), H, ["signal"]).select("signal", "sharpe")
    ic = ic_of(d, p).groupBy("signal").agg(F.avg("ic").alias("ic"))
    rho = xsection.score_autocorr(p, "score", H, ["signal"], min_pairs=1)
    measured = independent_bets(d).filter("kind = 'neutral'").select(F.lit(1).alias("_j"), "n_eff")
    j = st.join(ic, "signal").join(rho, "signal").withColumn("_j", F.lit(1)).join(measured, "_j", "left")
    n_eff = F.col("n_eff")
    return rounded(
        j.select(
            "signal", "ic", "sharpe",
            perf.breadth_realised(F.col("sharpe"), F.col("ic")).alias("breadth"),
            perf.ir_predicted(F.col("ic"), n_eff * 252 / H).alias("ir_predicted"),
            perf.breadth_adjusted(n_eff, F.col("rho"), H).alias("breadth_adj"),
        ),
        breadth=2, breadth_adj=4,
    )


CTES["x_sh"] = """SELECT signal, avg(rr)/stddev_samp(rr)*sqrt(12.0e0) AS sh FROM (SELECT signal, CASE WHEN (row_number() OVER (PARTITION BY signal ORDER BY dt)-1)%21=0 THEN ret END AS rr
 FROM x_book WHERE ret IS NOT NULL) GROUP BY signal"""


# --------------------------------------------------------------- whole studies
CTES["x_vl"] = """
SELECT signal || '|raw' AS signal, symbol, dt, sector, score, half_bps, fwd_21 FROM x_wl
UNION ALL SELECT signal || '|resid', symbol, dt, sector, resid, half_bps, fwd_21 FROM x_resid WHERE resid IS NOT NULL"""
CTES["x_vb"] = bucket_sql("x_vl", "signal, dt, sector", ADAPT, 10, "score IS NOT NULL AND fwd_21 IS NOT NULL AND half_bps IS NOT NULL")
CTES["x_vbook"] = """
SELECT signal AS k, dt, avg(l-s-cl-cs) AS ret FROM (
 SELECT signal, dt, sector, avg(CASE WHEN bucket=top_bucket THEN fwd_21 END) AS l, avg(CASE WHEN bucket=0 THEN fwd_21 END) AS s,
  avg(CASE WHEN bucket=top_bucket THEN 2*half_bps/10000 END) AS cl, avg(CASE WHEN bucket=0 THEN 2*half_bps/10000 END) AS cs
 FROM x_vb GROUP BY signal, dt, sector) GROUP BY signal, dt"""
CTES["x_vstat"] = STATS.format(k="k", src="x_vbook")
CTES["x_vfirst"] = "SELECT k, min(dt) AS first_dt FROM x_vbook GROUP BY k"


@query(
    "factor_attribution",
    """
SELECT split_part(a.k,'|',1) AS signal, a.n AS n_obs, a.sharpe AS raw_sharpe, a.t AS raw_t, b.sharpe AS res_sharpe, b.t AS res_t, f.first_dt,
 CASE WHEN b.sharpe>0.2 AND abs(b.t)>1.5 THEN 1 ELSE 0 END AS survives
FROM x_vstat a JOIN x_vstat b ON split_part(b.k,'|',1)=split_part(a.k,'|',1) JOIN x_vfirst f ON f.k=a.k
WHERE a.k LIKE '%|raw' AND b.k LIKE '%|resid'""",
)
def factor_attribution(d):
    from ..plans import studies

    return rounded(studies.factor_attribution(residuals(d), H, Q, d.wide_names))


CTES["x_capl"] = """
SELECT bucket || '|' || 'x' AS signal, bucket, symbol, dt, sector, half_bps, fwd_21,
 round((mom126-avg(mom126) OVER g)/NULLIF(stddev_samp(mom126) OVER g,0),9)+0.0 AS score
FROM (SELECT w.*, b.bucket FROM x_w w JOIN (
  SELECT symbol, CASE WHEN inclusion_reason='smallcap600' THEN 'small' WHEN inclusion_reason='midcap400' THEN 'mid' ELSE 'large' END AS bucket FROM x_wsymbols
  UNION ALL SELECT symbol, 'all' FROM x_wsymbols) b ON b.symbol=w.symbol WHERE fwd_21 IS NOT NULL) WINDOW g AS (PARTITION BY bucket, dt, sector)"""
CTES["x_caplegs"] = """
SELECT bucket AS k, dt, avg(l-s) AS gross, avg(l-s-cl-cs) AS net FROM (
 SELECT bucket0 AS bucket, dt, sector, avg(CASE WHEN bucket=top_bucket THEN fwd_21 END) AS l, avg(CASE WHEN bucket=0 THEN fwd_21 END) AS s,
  avg(CASE WHEN bucket=top_bucket THEN 2*half_bps/10000 END) AS cl, avg(CASE WHEN bucket=0 THEN 2*half_bps/10000 END) AS cs
 FROM (SELECT * RENAME (bucket_1 AS bucket, bucket AS bucket0) FROM x_capb1) GROUP BY 1, 2, 3) GROUP BY 1, 2"""
CTES["x_capb1"] = """
SELECT signal, symbol, dt, sector, half_bps, fwd_21, bucket, top_bucket, CAST(greatest(((rn-1)*q+n-2)//(n-1),1)-1 AS INTEGER) AS bucket_1
FROM (SELECT *, CAST(greatest(((n-1)*q+n-2)//(n-1),1)-1 AS INTEGER) AS top_bucket FROM (SELECT *, least(5,greatest(2,n//5)) AS q FROM (
 SELECT *, row_number() OVER (PARTITION BY signal, dt, sector ORDER BY score, symbol) AS rn, count(*) OVER (PARTITION BY signal, dt, sector) AS n
 FROM x_capl WHERE score IS NOT NULL AND half_bps IS NOT NULL))) WHERE n>=4"""
CTES["x_capg"] = "SELECT k || '|g' AS k, dt, gross AS ret FROM x_caplegs UNION ALL SELECT k || '|n', dt, net FROM x_caplegs"
CTES["x_capstat"] = STATS.format(k="k", src="x_capg")


@query(
    "cap_spectrum",
    """
SELECT split_part(g.k,'|',1) AS bucket, m.names, m.med_half_bps, g.ret_ann AS gross_ret, g.sharpe AS gross_sharpe, n.ret_ann AS net_ret, n.sharpe AS net_sharpe, n.t AS net_t, n.n AS n_obs
FROM x_capstat g JOIN x_capstat n ON split_part(g.k,'|',1)=split_part(n.k,'|',1)
JOIN (SELECT bucket, count(DISTINCT symbol) AS names, round(median(half_bps),6)+0.0 AS med_half_bps FROM x_capl GROUP BY bucket) m ON m.bucket=split_part(g.k,'|',1)
WHERE g.k LIKE '%|g' AND n.k LIKE '%|n'""",
)
def cap_spectrum(d):
    from ..plans import studies

    p = wide(d).join(d.wsymbols.select("symbol", entities.cap_bucket().alias("bucket")), "symbol")
    return rounded(studies.cap_spectrum(p.filter("fwd_21 is not null"), "mom126", "fwd_21", H, Q, 4, d.wide_names))


CTES["x_comp"] = """
SELECT symbol, dt, sector, fwd_21, round((coalesce(z_mom126,0)+coalesce(z_low_vol63,0))/NULLIF(CASE WHEN z_mom126 IS NULL THEN 0 ELSE 1 END+CASE WHEN z_low_vol63 IS NULL THEN 0 ELSE 1 END,0),9)+0.0 AS slow,
 z_reversal5 AS fast FROM x_wz"""
CTES["x_compl"] = """
SELECT 'slow' AS signal, symbol, dt, sector, fwd_21, slow AS score FROM x_comp UNION ALL SELECT 'fast', symbol, dt, sector, fwd_21, fast FROM x_comp
UNION ALL SELECT 'both', symbol, dt, sector, fwd_21, round((coalesce(slow,0)+coalesce(fast,0))/NULLIF(CASE WHEN slow IS NULL THEN 0 ELSE 1 END+CASE WHEN fast IS NULL THEN 0 ELSE 1 END,0),9)+0.0 FROM x_comp"""
CTES["x_compb"] = bucket_sql("x_compl", "signal, dt, sector", ADAPT, 10, "score IS NOT NULL AND fwd_21 IS NOT NULL")
CTES["x_compbook"] = CTES["x_book"].replace("x_b_sec", "x_compb")
CTES["x_cball"] = """
SELECT signal AS k, dt, ret FROM x_compbook
UNION ALL SELECT 'equal', dt, avg(ret) FROM x_compbook WHERE signal IN ('slow','fast') GROUP BY dt HAVING count(*)=2
UNION ALL SELECT 'invvol', dt, sum(ret*i)/sum(i) FROM (SELECT signal, dt, ret, CASE WHEN np>=63 THEN 1/NULLIF(sd,0) END AS i FROM (
 SELECT *, count(ret) OVER p AS np, stddev_samp(ret) OVER p AS sd FROM (SELECT * FROM x_compbook WHERE signal IN ('slow','fast') AND dt IN (
   SELECT dt FROM x_compbook WHERE signal IN ('slow','fast') GROUP BY dt HAVING count(*)=2))
 WINDOW p AS (PARTITION BY signal ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
 GROUP BY dt HAVING count(i)=2"""


@query("sleeve_compare", "SELECT k AS book, dates, ret_ann, n, vol, sharpe, t, max_dd FROM (" + STATS.format(k="k", src="x_cball") + ") WHERE dates>=60")
def sleeve_compare(d):
    from ..plans import studies

    return rounded(studies.sleeve_compare(zscored(d), {"slow": ["z_mom126", "z_low_vol63"], "fast": ["z_reversal5"]}, "fwd_21", H, Q, d.wide_names))


# one composite score, built in four ways; the residual leaves out a factor that at most half of a date's names have
CTES["x_pm"] = """
SELECT symbol, dt, sector, fwd_21, half_bps, vol63, score, beta, size, mom126, 2*count(beta) OVER d>count(*) OVER d AS u1, 2*count(size) OVER d>count(*) OVER d AS u2,
 2*count(mom126) OVER d>count(*) OVER d AS u3 FROM (
SELECT *, (coalesce(z_reversal5,0)+coalesce(z_low_vol63,0))/NULLIF(CAST(z_reversal5 IS NOT NULL AS INTEGER)+CAST(z_low_vol63 IS NOT NULL AS INTEGER),0) AS score FROM x_wz)
WHERE score IS NOT NULL AND fwd_21 IS NOT NULL AND half_bps IS NOT NULL WINDOW d AS (PARTITION BY dt)"""
CTES["x_pm1"] = """
SELECT symbol, dt, sector, fwd_21, half_bps, vol63, score-avg(score) OVER d AS y, CASE WHEN u1 THEN beta-avg(beta) OVER d ELSE 0 END AS x1,
 CASE WHEN u2 THEN size-avg(size) OVER d ELSE 0 END AS x2, CASE WHEN u3 THEN mom126-avg(mom126) OVER d ELSE 0 END AS x3, count(*) OVER d AS nn FROM x_pm
WHERE (u1 OR u2 OR u3) AND (NOT u1 OR beta IS NOT NULL) AND (NOT u2 OR size IS NOT NULL) AND (NOT u3 OR mom126 IS NOT NULL) WINDOW d AS (PARTITION BY dt)"""


def off(v: str, *axes: str) -> str:
    """v without its projections, within the date, on orthogonal axes."""
    return v + "".join(f" - {x}*coalesce(sum({v}*{x}) OVER d/NULLIF(sum({x}*{x}) OVER d,0),0)" for x in axes)


CTES["x_pm2"] = f"SELECT *, {off('x2', 'x1')} AS e2 FROM x_pm1 WHERE nn>=30 WINDOW d AS (PARTITION BY dt)"
CTES["x_pm3"] = f"SELECT *, {off('x3', 'x1', 'e2')} AS e3 FROM x_pm2 WINDOW d AS (PARTITION BY dt)"
PM = "symbol, dt, sector, fwd_21, half_bps, vol63"
CTES["x_pms"] = " UNION ALL ".join(f"SELECT '{m}' AS signal, {PM}, score FROM x_pm" for m in ("A quintile", "B signal", "C risk")) + f"""
UNION ALL SELECT 'D neutral', {PM}, {off('y', 'x1', 'e2', 'e3')} FROM x_pm3 WINDOW d AS (PARTITION BY dt)"""
CTES["x_pmq"] = bucket_sql("x_pms", "signal, dt, sector", ADAPT, 2, "signal='A quintile'")
CTES["x_pmw"] = " UNION ALL ".join(
    f"SELECT signal, {PM}, w FROM ({weight_sql(raw, src)})" for raw, src in (
        ("CASE WHEN bucket=0 THEN -1.0e0 WHEN bucket=top_bucket THEN 1.0e0 ELSE 0.0e0 END", "x_pmq"),
        (DEV, "(SELECT * FROM x_pms WHERE signal='B signal')"), (f"{DEV}/NULLIF(vol63,0)", "(SELECT * FROM x_pms WHERE signal IN ('C risk','D neutral'))"),
    )
)
CTES["x_pmb"] = "SELECT signal AS method, dt, sum(w*fwd_21-abs(w)*2*half_bps/10000) AS ret FROM x_pmw GROUP BY 1, 2"


@query("weights_neutral", "SELECT symbol, dt, round(w,6)+0.0 AS w FROM x_pmw WHERE signal='D neutral'")
def weights_neutral(d):
    p = zscored(d).withColumn("score", xsection.composite(["z_reversal5", "z_low_vol63"]))
    p = p.filter("score is not null and fwd_21 is not null and half_bps is not null")
    p = p.select("symbol", "dt", "sector", "vol63", "score", *FACTORS)
    p = xsection.residualize(p, "score", FACTORS, out="neutral", min_names=30, need_share=0.5, width=d.wide_names)
    w = books.weights(p.filter("neutral is not null"), "neutral", "neutral", Q, width=d.wide_names)
    return rounded(w.select("symbol", "dt", "w"))


@query("portfolio_methods", STATS.format(k="method", src="x_pmb"))
def portfolio_methods(d):
    from ..plans import studies

    p = zscored(d).withColumn("score", xsection.composite(["z_reversal5", "z_low_vol63"]))
    return rounded(studies.portfolio_methods(p, "score", FACTORS, "fwd_21", H, Q, d.wide_names))


CTES["x_mat"] = """
SELECT s.symbol, s.month, s.usd/ (h.shares*b.close) AS score, f.fwd_21, b.dt FROM (
 SELECT ticker AS symbol, strftime(action_date,'%Y-%m') AS month, sum(amount_usd) AS usd FROM x_entities WHERE ticker IS NOT NULL GROUP BY 1, 2) s
JOIN (SELECT symbol, strftime(dt,'%Y-%m') AS month, max(dt) AS dt FROM x_bars GROUP BY 1, 2) e ON e.symbol=s.symbol AND e.month=s.month
JOIN x_bars b ON b.symbol=e.symbol AND b.dt=e.dt ASOF JOIN x_shares h ON h.symbol=b.symbol AND b.dt>=h.filed
JOIN x_fx f ON f.symbol=b.symbol AND f.dt=b.dt"""
CTES["x_matb"] = """
SELECT *, CAST(greatest(((rn-1)*5+n-2)//(n-1),1)-1 AS INTEGER) AS bucket FROM (
SELECT *, row_number() OVER (ORDER BY score, symbol || month) AS rn, count(*) OVER () AS n FROM x_mat WHERE score IS NOT NULL AND fwd_21 IS NOT NULL)"""


@query(
    "materiality",
    """SELECT bucket, count(*) AS n, round(min(score),6)+0.0 AS lo, round(median(score),6)+0.0 AS median, round(max(score),6)+0.0 AS hi, round(avg(fwd_21),6)+0.0 AS mean_fwd,
 round((SELECT avg(fwd_21) FROM x_matb WHERE bucket=(SELECT max(bucket) FROM x_matb))-(SELECT avg(fwd_21) FROM x_matb WHERE bucket=0),6)+0.0 AS spread,
 round(avg(fwd_21)/(stddev_samp(fwd_21)/sqrt(count(*))),6)+0.0 AS t FROM x_matb GROUP BY bucket""",
)
def materiality(d):
    from ..plans import studies
    from .load import _resolved

    m = studies.materiality(_resolved(d), d.bars, panels.fundamentals(d.spark, d.dir), labels.forward_excess(d.ix))
    return rounded(studies.materiality_table(m))


@query(
    "materiality_corr",
    """SELECT count(*) AS n, round(corr(a,b),6)+0.0 AS spearman FROM (
SELECT rank() OVER (ORDER BY score)+(count(*) OVER (PARTITION BY score)-1)/2 AS a, rank() OVER (ORDER BY fwd_21)+(count(*) OVER (PARTITION BY fwd_21)-1)/2 AS b FROM x_matb)""",
)
def materiality_corr(d):
    from ..plans import studies
    from .load import _resolved

    m = studies.materiality(_resolved(d), d.bars, panels.fundamentals(d.spark, d.dir), labels.forward_excess(d.ix))
    return rounded(studies.materiality_corr(m))


# ------------------------------------------------------------------- breadth
CTES["x_pr0"] = """
SELECT symbol, dt, ret, ret-avg(ret) OVER (PARTITION BY dt, sector) AS neutral FROM (
 SELECT w.symbol, w.dt, s.sector, adj/lag(adj) OVER (PARTITION BY w.symbol ORDER BY w.dt)-1.0 AS ret FROM (
  SELECT symbol, CAST(date_trunc('week', dt) AS DATE) AS dt, arg_max(adj_close, dt) AS adj FROM x_bars WHERE symbol<>'MKT' GROUP BY 1, 2) w
 JOIN x_symbols s ON s.symbol=w.symbol) WHERE ret IS NOT NULL"""
CTES["x_pr1"] = """
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS c, (SELECT count(DISTINCT dt) FROM x_pr0) AS t FROM x_pr0) WHERE c=t"""


def weekly_returns(d):
    """Weekly returns of the brands, which have a bar in nearly every week."""
    week = d.bars.filter(F.col("symbol") != MARKET).groupBy("symbol", F.trunc("dt", "week").alias("dt")).agg(
        F.max_by("adj_close", F.col("dt")).alias("adj")
    )
    week = week.withColumn("ret", F.col("adj") / lagged("adj", order="dt") - 1.0).filter("ret is not null")
    return week.join(d.symbols.select("symbol", "sector"), "symbol").select("symbol", "dt", "sector", "ret")


def pr_sql(col):
    return f"""(SELECT sum(rho*rho) FROM (SELECT a.symbol, b.symbol, corr(a.{col}, b.{col}) AS rho FROM x_pr1 a JOIN x_pr1 b ON a.dt=b.dt GROUP BY a.symbol, b.symbol))"""


@query(
    "participation_ratio",
    f"""SELECT 'raw' AS kind, count(DISTINCT symbol) AS n_names, CAST(max(t) AS INTEGER) AS n_dates, round({pr_sql('ret')},4)+0.0 AS sum_sq_corr,
 round(pow(count(DISTINCT symbol),2)/{pr_sql('ret')},6)+0.0 AS n_eff FROM x_pr1 HAVING count(*)>0
UNION ALL SELECT 'neutral', count(DISTINCT symbol), CAST(max(t) AS INTEGER), round({pr_sql('neutral')},4)+0.0, round(pow(count(DISTINCT symbol),2)/{pr_sql('neutral')},6)+0.0 FROM x_pr1 HAVING count(*)>0""",
)
def participation_ratio(d):
    return rounded(independent_bets(d), sum_sq_corr=4)


def independent_bets(d):
    """Effective number of names, raw and after removing the sector mean of the week."""
    p = weekly_returns(d)
    p = ranking.group_join(p, ["dt", "sector"], d.names, _m=F.avg("ret"))
    both = F.explode(
        F.array(F.struct(F.lit("raw").alias("kind"), F.col("ret").alias("v")), F.struct(F.lit("neutral").alias("kind"), (F.col("ret") - F.col("_m")).alias("v")))
    ).alias("k")
    p = p.select("symbol", "dt", both).select("symbol", "dt", "k.kind", F.col("k.v").alias("ret"))
    return inference.participation_ratio(p, ["kind"])


CURVE = (2, 5, 10, 20, 50, 100, 200, 400, 800)
CTES["x_pick"] = """
SELECT symbol, row_number() OVER (ORDER BY u, symbol) AS pos, count(*) OVER () AS k FROM (
 SELECT DISTINCT symbol, ('0x'||substr(md5('pick-'||symbol),1,8))::BIGINT/4294967296.0e0 AS u FROM x_pr1)"""
CTES["x_rho"] = """
SELECT a.symbol AS a, b.symbol AS b, corr(a.ret,b.ret) AS raw, corr(a.neutral,b.neutral) AS neutral, max(a.t) AS t FROM x_pr1 a JOIN x_pr1 b ON a.dt=b.dt GROUP BY 1, 2"""


@query(
    "breadth_curve",
    f"""WITH sizes AS (SELECT DISTINCT least(s,k) AS n FROM (SELECT any_value(k) AS k FROM x_pick), unnest([{', '.join(map(str, CURVE))}, 1000000000]) AS u(s) WHERE k IS NOT NULL),
pairs AS (SELECT kind, t, greatest(p.pos,q.pos) AS upto, rho FROM (SELECT a, b, t, 'raw' AS kind, raw AS rho FROM x_rho UNION ALL SELECT a, b, t, 'neutral', neutral FROM x_rho) r
 JOIN x_pick p ON p.symbol=r.a JOIN x_pick q ON q.symbol=r.b)
SELECT CAST(n AS BIGINT) AS n, kind, CAST(n AS BIGINT) AS n_names, CAST(max(t) AS INTEGER) AS n_dates, round(sum(rho*rho),4)+0.0 AS sum_sq_corr, round(n*n/sum(rho*rho),6)+0.0 AS n_eff
FROM sizes JOIN pairs ON upto<=n GROUP BY n, kind""",
)
def breadth_curve(d):
    return rounded(inference.breadth_curve(weekly_returns(d), CURVE, width=d.names), sum_sq_corr=4)


@query(
    "avg_cross_corr",
    """
SELECT ga, gb, count(rho) AS pairs, round(avg(rho),6)+0.0 AS mean_corr, round(max(abs(rho)),6)+0.0 AS max_abs_corr FROM (
SELECT CASE WHEN a.signal='reversal5' THEN 'fast' ELSE 'slow' END AS ga, CASE WHEN b.signal='reversal5' THEN 'fast' ELSE 'slow' END AS gb, a.signal AS x, b.signal AS y, corr(a.ret,b.ret) AS rho
FROM x_book a JOIN x_book b ON a.dt=b.dt GROUP BY ALL) WHERE ga<gb GROUP BY ga, gb""",
)
def avg_cross_corr(d):
    b = sector_book(d).withColumnRenamed("signal", "strategy")
    g = d.spark.range(1).select(
        F.explode(F.create_map(*[x for s in SIG for x in (F.lit(s), F.lit("fast" if s == "reversal5" else "slow"))])).alias("strategy", "grp")
    )
    return rounded(inference.avg_cross_corr(b, g))


#: Books by the source of their signal.
SOURCES = {
    "momentum": [s for s in SIG if s.startswith("mom")],
    "price": [s for s in SIG if s.startswith(("mom", "reversal"))],
    "risk": [s for s in SIG if not s.startswith(("mom", "reversal"))],
    "all": list(SIG),
}
CTES["x_src"] = " UNION ALL ".join(f"SELECT '{k}' AS s, '{n}' AS signal" for k, v in SOURCES.items() for n in v)
CTES["x_srcb"] = """
SELECT * FROM (SELECT s, signal, dt, ret, count(*) OVER (PARTITION BY s, dt) AS k, (SELECT count(*) FROM x_src y WHERE y.s=x.s AND y.signal IN (SELECT signal FROM x_book GROUP BY 1 HAVING count(ret)>=60)) AS nominal
 FROM x_book JOIN x_src x USING (signal) WHERE ret IS NOT NULL AND signal IN (SELECT signal FROM x_book GROUP BY 1 HAVING count(ret)>=60)) WHERE k=nominal"""


@query(
    "source_breadth",
    """
WITH rho AS (SELECT a.s, a.signal AS a, b.signal AS b, any_value(a.nominal) AS nominal, count(*) AS n, corr(a.ret,b.ret) AS rho FROM x_srcb a JOIN x_srcb b ON a.s=b.s AND a.dt=b.dt GROUP BY 1, 2, 3)
SELECT s AS "set", any_value(nominal) AS nominal, CAST(max(n) AS INTEGER) AS n_dates, round(CASE WHEN any_value(nominal)>1 THEN pow(any_value(nominal),2)/sum(rho*rho) END,6)+0.0 AS n_eff,
 round(CASE WHEN any_value(nominal)>1 THEN avg(rho) FILTER (a<>b) END,6)+0.0 AS mean_corr FROM rho GROUP BY s""",
)
def source_breadth(d):
    b = sector_book(d).withColumnRenamed("signal", "strategy")
    return rounded(inference.effective_books(b, SOURCES))
