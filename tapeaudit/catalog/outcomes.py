"""Queries on strategies, trades, folds and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RiskLimits
from ..functions import cut, uniform
from ..operators import calendar, features, folds, labels, models, perf, ranking, trades
from ..sources import panels
from .base import CTES, query, r, rounded
from .xs import STATS  # noqa: F401

ROWCOLS = ["symbol", "dt", "day_index", "mom_21d", "above_200", "atr_14", *["fwd_ret_5d", "fwd_ret_5d_net", "label_win_5d", "next_open"]]

CTES["x_mrows"] = """
SELECT p.*, l.fwd_ret_1d, l.fwd_ret_5d, l.fwd_ret_5d_net, l.fwd_ret_21d, l.label_win_5d, l.next_open
FROM x_panel p JOIN x_labels l ON l.symbol=p.symbol AND l.dt=p.dt
WHERE p.bar_num>200 AND vol_20_annual IS NOT NULL AND mom_126d IS NOT NULL AND rel_volume IS NOT NULL AND mkt_ret_1d IS NOT NULL AND label_win_5d IS NOT NULL"""
CTES["x_pred"] = """
SELECT model_name, fold_id, symbol, dt, day_index, atr_14, next_open, fwd_ret_5d, fwd_ret_5d_net,
 CAST(label_win_5d AS DOUBLE) AS y_true, y_prob, CAST(CASE WHEN y_prob>=0.5 THEN 1 ELSE 0 END AS INTEGER) AS y_pred FROM (
 SELECT m.*, f.fold_id, v.model_name, CASE v.model_name WHEN 'always_long' THEN 0.51e0
   WHEN 'momentum_rule' THEN CASE WHEN mom_21d>0 AND above_200=1 THEN 0.6e0 ELSE 0.4e0 END
   ELSE ('0x'||substr(md5(v.model_name||'-'||symbol||'-'||dt),1,8))::BIGINT/4294967296.0e0 END AS y_prob
 FROM x_mrows m JOIN x_folds f ON m.dt BETWEEN f.test_start AND f.test_end, (VALUES ('gbm'),('logistic'),('always_long'),('momentum_rule')) v(model_name))"""


def model_rows(d):
    return labels.model_rows(d.panel, d.labels)


def test_rows(d, cols=None):
    """The test rows of every fold, with fold_id; `cols` are the columns to keep."""
    m = model_rows(d)
    return folds.split_folds(m.select(*cols) if cols else m, fold_table(d)).filter("part = 'test'").drop("part")


def predictions(d, shared=False):
    """Scores of the two rule models, and hash scores that stand in for two fitted ones."""
    m = test_rows(d, ROWCOLS)
    name = F.explode(F.array(*[F.lit(n) for n in ("gbm", "logistic", "always_long", "momentum_rule")])).alias("model_name")
    p = m.select("*", name)
    rule = F.when((F.col("mom_21d") > 0) & (F.col("above_200") == 1), 0.6).otherwise(0.4)
    prob = (
        F.when(F.col("model_name") == "always_long", 0.51)
        .when(F.col("model_name") == "momentum_rule", rule)
        .otherwise(uniform("model_name", "symbol", "dt"))
    )
    p = p.withColumn("y_prob", prob).withColumn("y_true", F.col("label_win_5d").cast("double"))
    p = p.withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int")).drop("label_win_5d", "mom_21d", "above_200")
    return cut(p) if shared else p


@query(
    "flagship_momentum_decile",
    """
SELECT dt, count(*) AS n_selected, round(avg(net),6)+0.0 AS ret_net, round(avg(gross),6)+0.0 AS ret_gross, round(avg(CASE WHEN net>0 THEN 1 ELSE 0 END),6)+0.0 AS hit_rate FROM (
 SELECT f.dt, l.fwd_ret_5d_net AS net, l.fwd_ret_5d AS gross, percent_rank() OVER (PARTITION BY f.dt ORDER BY f.mom_21d) AS pr
 FROM x_feat f JOIN x_labels l ON l.symbol=f.symbol AND l.dt=f.dt WHERE f.kind='stock' AND f.mom_21d IS NOT NULL) WHERE pr>=0.9 AND net IS NOT NULL GROUP BY dt""",
)
def flagship_momentum_decile(d):
    """Top decile of 21-session momentum each day, net return over the next five sessions."""
    f = features.momentum(d.ix, (21,))
    net = labels.forward_return(5)
    f = f.withColumn("gross", net).filter("kind = 'stock' and mom_21d is not null").select("symbol", "dt", "mom_21d", "gross")
    p = ranking.percent_rank(f, ["dt"], "mom_21d", "pr", d.names).filter("pr >= 0.9 and gross is not null")
    n = F.col("gross") - 0.0014
    return rounded(
        p.groupBy("dt").agg(
            F.count(F.lit(1)).alias("n_selected"), F.avg(n).alias("ret_net"), F.avg("gross").alias("ret_gross"),
            F.avg((n > 0).cast("int")).alias("hit_rate"),
        )
    )


PK = "SELECT model_name, fold_id, symbol, dt, y_true, round(y_prob,6)+0.0 AS y_prob, y_pred FROM x_pred WHERE model_name='{}'"


@query("baseline_always_long", PK.format("always_long"))
def baseline_always_long(d):
    return rounded(models.as_predictions(models.baseline_always_long(test_rows(d))))


@query("baseline_momentum_rule", PK.format("momentum_rule"))
def baseline_momentum_rule(d):
    return rounded(models.as_predictions(models.baseline_momentum_rule(test_rows(d))))


CTES["x_ranked"] = """
SELECT *, percent_rank() OVER (PARTITION BY model_name, dt ORDER BY y_prob) AS pr, count(*) OVER (PARTITION BY model_name, dt) AS cand FROM x_pred"""
CTES["x_sd"] = """
SELECT model_name, dt, count(*) AS n_selected, avg(fwd_ret_5d_net) AS ret_net, avg(fwd_ret_5d) AS ret_gross, avg(y_true) AS hit_rate, avg(y_prob) AS mean_prob
FROM x_ranked WHERE pr>=0.9 GROUP BY model_name, dt"""
CTES["x_bd"] = """
SELECT model_name, dt, count(*) AS n_selected, avg(fwd_ret_5d_net) AS ret_net, avg(fwd_ret_5d) AS ret_gross, avg(y_true) AS hit_rate
FROM x_pred WHERE model_name IN ('always_long','momentum_rule') AND y_pred=1 GROUP BY model_name, dt"""
CTES["x_all"] = """
SELECT model_name, dt, n_selected, ret_net, ret_gross, 'top_decile' AS selection FROM x_sd WHERE model_name IN ('logistic','gbm')
UNION ALL SELECT model_name, dt, n_selected, ret_net, ret_gross, 'rule_signal' FROM x_bd"""


def ranked(d):
    return models.rank_predictions(predictions(d), d.names)


def series(d):
    """One net return per strategy and date: (strategy, dt, ret)."""
    return daily_series(predictions(d, shared=True), d.names)


def daily_series(p, width):
    u = models.union_strategies(models.strategy_daily(models.rank_predictions(p, width)), models.baseline_daily(p))
    return cut(u.select(F.col("model_name").alias("strategy"), "dt", F.col("ret_net").alias("ret")))


@query("strategy_daily", f"SELECT model_name, dt, n_selected, {r('ret_net ret_gross hit_rate mean_prob')} FROM x_sd")
def strategy_daily(d):
    return rounded(models.strategy_daily(ranked(d)))


@query("baseline_daily", f"SELECT model_name, dt, n_selected, {r('ret_net ret_gross hit_rate')} FROM x_bd")
def baseline_daily(d):
    return rounded(models.baseline_daily(predictions(d)))


@query(
    "benchmark_daily",
    "SELECT dt, round(fwd_ret_5d_net,6)+0.0 AS ret_net, round(fwd_ret_5d,6)+0.0 AS ret_gross FROM x_labels WHERE symbol='MKT'",
)
def benchmark_daily(d):
    m = calendar.market_only(d.labels)
    return rounded(m.select("dt", F.col("fwd_ret_5d_net").alias("ret_net"), F.col("fwd_ret_5d").alias("ret_gross")))


@query("union_strategies", f"SELECT model_name, dt, n_selected, selection, {r('ret_net ret_gross')} FROM x_all")
def union_strategies(d):
    p = predictions(d, shared=True)
    return rounded(
        models.union_strategies(models.strategy_daily(models.rank_predictions(p, d.names)), models.baseline_daily(p))
    )


@query(
    "align_common_dates",
    "SELECT model_name AS strategy, dt, round(ret_net,6)+0.0 AS ret FROM x_all WHERE dt IN (SELECT dt FROM x_all WHERE ret_net IS NOT NULL GROUP BY dt HAVING count(*)=4)",
)
def align_common_dates(d):
    return rounded(perf.align_common_dates(series(d)).select("strategy", "dt", "ret"))


# ----------------------------------------------------------------------- folds
CTES["x_folds"] = """
SELECT CAST(row_number() OVER (ORDER BY y) AS INTEGER) AS fold_id, make_date(y,1,1) AS train_start, te AS train_end, make_date(y+2,1,1) AS test_start, make_date(y+2,12,31) AS test_end
FROM (SELECT y, (SELECT dt FROM x_cal WHERE day_index = greatest(0,(SELECT count(*) FROM x_cal WHERE dt < make_date(y+2,1,1))-6)) AS te
 FROM (SELECT unnest(range((SELECT min(year) FROM (SELECT year, count(*) AS n FROM x_cal GROUP BY year) WHERE n>200), (SELECT max(year) FROM x_cal)-1)) AS y))"""


def fold_table(d):
    return folds.build_folds(d.calendar, train_years=2)


@query("build_folds", "SELECT fold_id, train_start, train_end, test_start, test_end, 5 AS purge_days, 0 AS embargo_days FROM x_folds")
def build_folds(d):
    return fold_table(d)


@query(
    "split_fold",
    """SELECT f.fold_id, CASE WHEN c.dt<=f.train_end THEN 'train' ELSE 'test' END AS part, count(*) AS rows, min(c.dt) AS first_dt, max(c.dt) AS last_dt
FROM x_ix c JOIN x_folds f ON c.dt BETWEEN f.train_start AND f.train_end OR c.dt BETWEEN f.test_start AND f.test_end GROUP BY 1, 2""",
)
def split_fold(d):
    s = folds.split_folds(d.ix.select("dt"), fold_table(d))
    return s.groupBy("fold_id", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


@query(
    "join_fold_by_date",
    "SELECT c.dt, f.fold_id FROM x_cal c JOIN x_folds f ON c.dt BETWEEN f.test_start AND f.test_end",
)
def join_fold_by_date(d):
    return folds.split_folds(d.calendar.select("dt"), fold_table(d)).filter("part = 'test'").select("dt", "fold_id")


@query(
    "fold_violations",
    """SELECT f.fold_id, f.train_end + 30 AS last_train, 'label reaches the test window' AS problem FROM x_folds f WHERE false
UNION ALL SELECT fold_id, last_train, 'label reaches the test window' FROM (
 SELECT f.fold_id, f.test_start, (SELECT max(dt) FROM x_cal c WHERE c.dt<f.test_start) AS last_train FROM x_folds f)""",
)
def fold_violations(d):
    """Folds built without a purge gap must be caught."""
    f = folds.build_folds(d.calendar, train_years=2, purge=0)
    return folds.fold_violations(d.calendar.select("dt"), f, 5).select("fold_id", "last_train", "problem")


@query(
    "fold_summary",
    """SELECT r.model_name, r.fold_id, f.test_start, f.test_end, count(DISTINCT r.dt) AS trading_dates, count(*) AS selections, round(avg(fwd_ret_5d_net),6)+0.0 AS mean_ret_net, round(avg(y_true),6)+0.0 AS hit_rate
FROM x_ranked r JOIN x_folds f ON f.fold_id=r.fold_id WHERE pr>=0.9 GROUP BY ALL""",
)
def fold_summary(d):
    return rounded(models.fold_summary(ranked(d), fold_table(d)))


@query(
    "fold_excess",
    """SELECT s.model_name, s.fold_id, s.test_start, round((s.m-b.m)*100,6)+0.0 AS excess_pct FROM (
SELECT r.model_name, r.fold_id, f.test_start, avg(fwd_ret_5d_net) AS m FROM x_ranked r JOIN x_folds f ON f.fold_id=r.fold_id WHERE pr>=0.9 GROUP BY ALL) s
LEFT JOIN (SELECT fold_id, avg(fwd_ret_5d_net) AS m FROM x_pred WHERE model_name='always_long' GROUP BY fold_id) b ON b.fold_id=s.fold_id""",
)
def fold_excess(d):
    p = predictions(d, shared=True)
    return rounded(models.fold_excess(models.fold_summary(models.rank_predictions(p, d.names), fold_table(d)), p))


# --------------------------------------------------------------- model evaluation
CTES["x_auc"] = """
SELECT model_name, fold_id, (sum(CASE WHEN y_true=1 THEN ar END)-sum(y_true)*(sum(y_true)+1)/2)/NULLIF(sum(y_true)*(count(*)-sum(y_true)),0) AS auc FROM (
 SELECT *, rank() OVER (PARTITION BY model_name, fold_id ORDER BY y_prob)+(count(*) OVER (PARTITION BY model_name, fold_id, y_prob)-1)/2 AS ar FROM x_pred) GROUP BY 1, 2"""
CTES["x_top"] = """
SELECT *, (row_number() OVER (PARTITION BY model_name, fold_id ORDER BY dt)-1)%5=0 AS k, row_number() OVER (PARTITION BY model_name, fold_id ORDER BY size DESC, dt) AS b FROM (
SELECT model_name, fold_id, dt, avg(fwd_ret_5d_net) AS ret, count(*) AS size FROM x_topr GROUP BY ALL)"""
CTES["x_topr"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name, fold_id ORDER BY y_prob DESC, dt, symbol) AS rn, count(*) OVER (PARTITION BY model_name, fold_id) AS n FROM x_pred)
WHERE rn <= greatest(1, floor(n*0.10e0))"""
CTES["x_eval"] = """
SELECT b.*, t.top_dates, t.conc_top10, t.top_mean_net_ret, t.pct_dates_positive, t.n_nonoverlap, t.sharpe_nonoverlap, t.t_stat, t.max_picks, t.median_picks,
  q.top_n, q.top_mean_naive, q.top_precision, q.sharpe_naive, a.auc FROM (
 SELECT model_name, fold_id, count(*) AS n, avg(y_true) AS base_rate, avg(CASE WHEN y_pred=y_true THEN 1 ELSE 0 END) AS accuracy, avg(pow(y_prob-y_true,2)) AS brier,
  avg(fwd_ret_5d_net) AS all_mean, count(DISTINCT dt) AS dates_available FROM x_pred GROUP BY 1, 2) b
JOIN (SELECT model_name, fold_id, count(*) AS top_dates, sum(CASE WHEN b<=10 THEN size END)/sum(size) AS conc_top10, avg(ret) AS top_mean_net_ret, max(size) AS max_picks, median(size) AS median_picks,
  avg(CASE WHEN ret>0 THEN 1 ELSE 0 END) AS pct_dates_positive, count(CASE WHEN k THEN ret END) AS n_nonoverlap,
  avg(CASE WHEN k THEN ret END)/stddev_samp(CASE WHEN k THEN ret END)*sqrt(252/5.0e0) AS sharpe_nonoverlap,
  avg(CASE WHEN k THEN ret END)/(stddev_samp(CASE WHEN k THEN ret END)/sqrt(count(CASE WHEN k THEN ret END))) AS t_stat FROM x_top GROUP BY 1, 2) t USING (model_name, fold_id)
JOIN (SELECT model_name, fold_id, count(*) AS top_n, avg(fwd_ret_5d_net) AS top_mean_naive, avg(y_true) AS top_precision,
  avg(fwd_ret_5d_net)/stddev_samp(fwd_ret_5d_net)*sqrt(252/5.0e0) AS sharpe_naive FROM x_topr GROUP BY 1, 2) q USING (model_name, fold_id)
JOIN x_auc a USING (model_name, fold_id)"""


def evaluated(d):
    return models.model_eval(predictions(d, shared=True).withColumn("ret", F.col("fwd_ret_5d_net")))


@query(
    "model_eval",
    f"""SELECT model_name, fold_id, n, dates_available, top_n, top_dates, n_nonoverlap, max_picks, {r('base_rate accuracy brier auc top_precision top_mean_net_ret top_mean_naive conc_top10 pct_dates_positive sharpe_nonoverlap t_stat sharpe_naive median_picks')},
 round(accuracy-greatest(base_rate,1-base_rate),6)+0.0 AS accuracy_lift, round((top_mean_net_ret-all_mean)*10000,3)+0.0 AS edge_bps, round(top_dates/5.0e0,6)+0.0 AS n_effective FROM x_eval""",
)
def model_eval(d):
    e = evaluated(d).drop("all_mean_net_ret")
    return rounded(e, edge_bps=3)


@query("auc", "SELECT model_name, fold_id, round(auc,6)+0.0 AS auc FROM x_auc")
def auc(d):
    return rounded(models.auc(predictions(d), ["model_name", "fold_id"]))


@query(
    "pool_folds",
    """SELECT model_name, count(*) AS folds, round(avg(auc),6)+0.0 AS auc, round(stddev_samp(auc),6)+0.0 AS auc_sd, round(avg(accuracy-greatest(base_rate,1-base_rate)),6)+0.0 AS lift,
 round(avg(top_mean_net_ret),6)+0.0 AS top_ret, round(avg(sharpe_nonoverlap),6)+0.0 AS sharpe, round(avg(sharpe_naive),6)+0.0 AS sharpe_naive, round(sum(top_dates/5.0e0),6)+0.0 AS n_eff,
 CAST(sum(CASE WHEN top_mean_net_ret>0 THEN 1 ELSE 0 END) AS BIGINT) AS folds_positive FROM x_eval GROUP BY model_name""",
)
def pool_folds(d):
    return rounded(models.pool_folds(evaluated(d)))


def _split(d):
    """The model rows, and each of them in every fold and role, stored once for all fits."""
    m = cut(model_rows(d))
    return m, cut(folds.split_folds(m, fold_table(d)))


def fitted_predictions(d):
    """Stored walk-forward predictions of all models over all folds, in the columns that the evaluation reads."""
    m, s = _split(d)
    p = models.walk_forward(m, s, ("logistic", "gbm", "always_long", "momentum_rule"))
    keep = ["symbol", "dt", "day_index", "atr_14", "next_open", "fwd_ret_5d", "fwd_ret_5d_net"]
    return cut(models.as_predictions(p, keep))


@query("model_eval_fitted")
def model_eval_fitted(d):
    """Evaluation of fitted models, fold by fold."""
    p = fitted_predictions(d).withColumn("ret", F.col("fwd_ret_5d_net"))
    return rounded(models.model_eval(p).drop("all_mean_net_ret"), edge_bps=3)


@query("fit_logistic")
def fit_logistic(d):
    m, s = _split(d)
    return rounded(models.as_predictions(models.walk_forward(m, s, ("logistic",))))


@query("fit_gbt")
def fit_gbt(d):
    m, s = _split(d)
    return rounded(models.as_predictions(models.walk_forward(m, s, ("gbm",))))


@query("permutation_importance")
def permutation_importance(d):
    m, s = _split(d)
    last = s.agg(F.max("fold_id").alias("fold_id"))
    one = s.join(last, "fold_id", "left_semi")
    model = models.fit("logistic", one.filter("part = 'train'"))
    few = ["mom_21d", "vol_20_annual", "mkt_vol_20", "rel_volume"]
    rest = [f for f in models.FEATURES if f not in few]
    test = one.filter("part = 'test'")
    return rounded(models.permutation_importance(model, test, few + rest, 3))


@query(
    "score_frozen",
    """SELECT stage, count(*) AS rows, min(dt) AS first_dt, max(dt) AS last_dt FROM (
 SELECT dt, CASE WHEN dt >= DATE '2001-06-01' THEN 'live' ELSE 'holdout' END AS stage FROM x_mrows WHERE dt > DATE '2000-12-31') GROUP BY stage""",
)
def score_frozen(d):
    """Fit before the cutoff, save, load, score after it; stages by first forward run."""
    import tempfile

    m = cut(model_rows(d))
    where = d.spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-frozen-")
    path = f"{where}/frozen_logistic"
    models.fit("logistic", m.filter("dt <= date'2000-12-31'")).write().overwrite().save(path)
    s = models.score_frozen(path, m, F.lit("2000-12-31").cast("date"), F.lit("2001-06-01").cast("date"))
    s = s.filter("y_prob is not null")
    return s.groupBy("stage").agg(F.count(F.lit(1)).alias("rows"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


# ---------------------------------------------------------------------- trades
@query(
    "topk_per_date",
    """SELECT model_name, symbol, dt, round(y_prob,6)+0.0 AS y_prob, CAST(rn AS INTEGER) AS rk FROM (
SELECT *, row_number() OVER (PARTITION BY model_name, dt ORDER BY y_prob DESC, symbol) AS rn FROM x_pred WHERE y_prob>=0.55) WHERE rn<=3""",
)
def topk_per_date(d):
    t = trades.topk_per_date(predictions(d), 3, 0.55, by=("model_name", "dt"), rank="rk")
    return rounded(t.select("model_name", "symbol", "dt", "y_prob", "rk"))


@query(
    "topk_global",
    "SELECT dt, model_name, n_selected, round(ret_net,6)+0.0 AS ret_net FROM (SELECT *, row_number() OVER (ORDER BY n_selected DESC, ret_net DESC, dt, model_name) AS rn FROM x_sd) WHERE rn<=15",
)
def topk_global(d):
    s = models.strategy_daily(ranked(d)).select("dt", "model_name", "n_selected", "ret_net")
    return rounded(s.orderBy(F.desc("n_selected"), F.desc("ret_net"), "dt", "model_name").limit(15))


def grid_trades(where_sig: str, thr: str, top: str, stop: str) -> str:
    return f"""
SELECT *, (exit_raw-entry_raw)*shares AS gross_pnl, 2*greatest(1.0e0,0.005e0*shares)+(entry_raw+exit_raw)*0.0007e0*shares AS costs,
 (exit_raw-entry_raw)*shares-(2*greatest(1.0e0,0.005e0*shares)+(entry_raw+exit_raw)*0.0007e0*shares) AS net_pnl FROM (
SELECT e.*, CASE WHEN hit.k IS NOT NULL THEN 'stop' ELSE 'horizon' END AS exit_reason, CASE WHEN hit.k IS NOT NULL THEN e.stop ELSE h5.open END AS exit_raw,
  coalesce(hit.dt, h5.dt) AS exit_dt, coalesce(hit.day_index, h5.day_index)-e.day_index AS sessions_held FROM (
 SELECT *, CAST(least(floor(100000.0e0/risk_ps), floor(5000000.0e0/top_n/entry_px)) AS BIGINT) AS shares FROM (
 SELECT *, entry_px-stop AS risk_ps FROM (
 SELECT *, entry_px-stop_atr*atr_14 AS stop FROM (
 SELECT s.model_name, s.symbol, s.dt, s.day_index, s.y_prob, s.atr_14, s.next_open AS entry_raw, s.next_open*(1+0.0007e0) AS entry_px, g.threshold, g.top_n, g.stop_atr, p.pos
 FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY y_prob DESC, symbol) AS rk FROM x_pred WHERE {where_sig} AND y_prob>=0.5) s
 JOIN (SELECT * FROM (VALUES {thr}) a(threshold), (VALUES {top}) b(top_n), (VALUES {stop}) c(stop_atr)) g ON s.y_prob>=g.threshold AND s.rk<=g.top_n
 JOIN x_pos p ON p.symbol=s.symbol AND p.dt=s.dt WHERE s.next_open IS NOT NULL AND s.atr_14>0)) WHERE entry_px-stop>0)) e
LEFT JOIN LATERAL (SELECT q.pos-e.pos AS k, q.dt, q.day_index FROM x_pos q WHERE q.symbol=e.symbol AND q.pos BETWEEN e.pos+1 AND e.pos+5 AND q.low<=e.stop ORDER BY q.pos LIMIT 1) hit ON true
LEFT JOIN x_pos h5 ON h5.symbol=e.symbol AND h5.pos=e.pos+5 WHERE e.shares>=1 AND (hit.k IS NOT NULL OR h5.pos IS NOT NULL))"""


CTES["x_pos"] = "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day_index) AS pos FROM x_ix"
CTES["x_trades"] = grid_trades("model_name='gbm'", "(0.55e0)", "(3)", "(1.5e0)")
CTES["x_sweep"] = grid_trades("model_name='gbm'", "(0.5e0),(0.55e0),(0.6e0)", "(1),(3),(5)", "(1.0e0),(1.5e0),(2.0e0),(2.5e0),(3.0e0)")
TK = "symbol, dt, shares"


# prices here are unit prices with very wide ranges; the account is sized to them
DESK = RiskLimits(account=1e7)


def entries(d):
    s = trades.topk_per_date(predictions(d).filter("model_name = 'gbm'"), 3, 0.55)
    return trades.trade_entries(s.withColumn("top_n", F.lit(3)).withColumn("stop_atr", F.lit(1.5)), risk=DESK)


def traded(d):
    return trades.trade_costs(trades.trade_exits(entries(d), trades.with_paths(d.ix, 5), 5))


@query(
    "trade_entries",
    f"""SELECT symbol, dt, CAST(least(floor(100000.0e0/(entry_px-(entry_px-1.5e0*atr_14))), floor(5000000.0e0/3/entry_px)) AS BIGINT) AS shares, {r('entry_raw entry_px', 4)}, round(entry_px-1.5e0*atr_14,4)+0.0 AS stop FROM (
 SELECT *, next_open AS entry_raw, next_open*(1+0.0007e0) AS entry_px, row_number() OVER (PARTITION BY dt ORDER BY y_prob DESC, symbol) AS rk FROM x_pred
 WHERE model_name='gbm' AND y_prob>=0.55) WHERE rk<=3 AND next_open IS NOT NULL AND atr_14>0 AND least(floor(100000.0e0/(entry_px-(entry_px-1.5e0*atr_14))), floor(5000000.0e0/3/entry_px))>=1""",
)
def trade_entries(d):
    return rounded(entries(d).select("symbol", "dt", "shares", "entry_raw", "entry_px", "stop"), 4)


@query("trade_exits", f"SELECT {TK}, exit_dt, exit_reason, CAST(sessions_held AS INTEGER) AS sessions_held, {r('exit_raw', 4)} FROM x_trades")
def trade_exits(d):
    t = traded(d).select("symbol", "dt", "shares", "exit_dt", "exit_reason", "sessions_held", "exit_raw")
    return rounded(t, 4)


@query("trade_costs", f"SELECT {TK}, {r('gross_pnl costs net_pnl', 4)} FROM x_trades")
def trade_costs(d):
    return rounded(traded(d).select("symbol", "dt", "shares", "gross_pnl", "costs", "net_pnl"), 4)


@query("trade_cost_identity", "SELECT count(*) AS trades, CAST(0 AS BIGINT) AS violations FROM x_trades")
def trade_cost_identity(d):
    bad = F.abs(F.col("net_pnl") - (F.col("gross_pnl") - F.col("costs"))) > 1e-6
    return traded(d).agg(F.count(F.lit(1)).alias("trades"), F.count(F.when(bad, 1)).alias("violations"))


CTES["x_eq"] = """
SELECT *, greatest(max(equity) OVER (ORDER BY dt), 10000000) AS peak FROM (
SELECT dt, net_pnl, trades, 10000000+sum(net_pnl) OVER (ORDER BY dt) AS equity FROM (SELECT exit_dt AS dt, sum(net_pnl) AS net_pnl, count(*) AS trades FROM x_trades GROUP BY exit_dt))"""


@query("equity_from_trades", f"SELECT dt, trades, {r('net_pnl equity peak', 2)}, round((peak-equity)/peak,6)+0.0 AS drawdown FROM x_eq")
def equity_from_trades(d):
    return rounded(trades.equity_from_trades(traded(d), account=DESK.account), 2, drawdown=6)


METRICS = """count(*) AS trades, round(sum(gross_pnl),3)+0.0 AS gross_pnl, round(sum(costs),3)+0.0 AS total_costs, round(sum(net_pnl),3)+0.0 AS net_pnl,
 round(avg(CASE WHEN net_pnl>0 THEN 1 ELSE 0 END),6)+0.0 AS win_rate, round(coalesce(avg(CASE WHEN net_pnl>0 THEN net_pnl END),0),4)+0.0 AS avg_win, round(coalesce(avg(CASE WHEN net_pnl<0 THEN net_pnl END),0),4)+0.0 AS avg_loss,
 round(sum(CASE WHEN net_pnl>0 THEN net_pnl END)/abs(sum(CASE WHEN net_pnl<0 THEN net_pnl END)),6)+0.0 AS profit_factor, round(avg(net_pnl/(risk_ps*shares)),6)+0.0 AS avg_r,
 count(CASE WHEN exit_reason='stop' THEN 1 END) AS stops_hit, count(CASE WHEN exit_reason='horizon' THEN 1 END) AS horizon_exits"""


@query("trade_metrics", f"SELECT {METRICS} FROM x_trades")
def trade_metrics(d):
    return rounded(trades.trade_metrics(traded(d)), gross_pnl=3, total_costs=3, net_pnl=3, avg_win=4, avg_loss=4)


@query(
    "cost_waterfall",
    """SELECT 'gross' AS step, round(sum(gross_pnl),3)+0.0 AS value FROM x_trades UNION ALL SELECT 'costs', round(-sum(costs),3)+0.0 FROM x_trades UNION ALL SELECT 'net', round(sum(net_pnl),3)+0.0 FROM x_trades""",
)
def cost_waterfall(d):
    return rounded(trades.cost_waterfall(traded(d)), 3)


@query(
    "growth_of_1",
    """
SELECT 'strategy' AS series, dt, round(equity/first_value(equity) OVER (ORDER BY dt),6)+0.0 AS growth FROM x_eq
UNION ALL SELECT 'benchmark', dt, round(adj_close/first_value(adj_close) OVER (ORDER BY dt),6)+0.0 FROM x_ix WHERE symbol='MKT' AND dt IN (SELECT dt FROM x_eq)""",
)
def growth_of_1(d):
    e = cut(trades.equity_from_trades(traded(d), account=DESK.account).select("dt", F.col("equity").alias("value")))
    m = calendar.market_only(d.ix).select("dt", F.col("adj_close").alias("value")).join(e.select("dt"), "dt", "left_semi")
    c = e.withColumn("series", F.lit("strategy")).unionByName(m.withColumn("series", F.lit("benchmark")))
    return rounded(perf.growth_of_one(c).select("series", "dt", "growth"))


@query(
    "flag_ordering_ambiguity",
    """
WITH f AS (SELECT e.symbol, e.dt, e.stop, e.entry_px+2.0e0*e.risk_ps AS target, q.pos-e.pos AS k, q.low<=e.stop AS s, q.high>=e.entry_px+2.0e0*e.risk_ps AS t
 FROM x_ent e JOIN x_pos q ON q.symbol=e.symbol AND q.pos BETWEEN e.pos+1 AND e.pos+5),
a AS (SELECT symbol, dt, CAST(count(CASE WHEN s AND t THEN 1 END) AS INTEGER) AS both, min(CASE WHEN s OR t THEN k END) AS k1 FROM f GROUP BY 1, 2)
SELECT a.symbol, a.dt, a.both AS sessions_touching_both, CASE WHEN f.s AND f.t THEN 1 ELSE 0 END AS ambiguous, CASE WHEN f.s THEN 'stop' WHEN f.t THEN 'target' ELSE 'none' END AS outcome
FROM a LEFT JOIN f ON f.symbol=a.symbol AND f.dt=a.dt AND f.k=a.k1""",
)
def flag_ordering_ambiguity(d):
    t = trades.ordering_ambiguity(entries(d), trades.with_paths(d.ix, 5).filter(F.size("path") > 0))
    return t.select("symbol", "dt", "sessions_touching_both", "ambiguous", "outcome")


CTES["x_ent"] = """
SELECT s.symbol, s.dt, p.pos, s.entry_px, s.entry_px-1.5e0*s.atr_14 AS stop, s.entry_px-(s.entry_px-1.5e0*s.atr_14) AS risk_ps FROM (
 SELECT *, next_open*(1+0.0007e0) AS entry_px, row_number() OVER (PARTITION BY dt ORDER BY y_prob DESC, symbol) AS rk FROM x_pred WHERE model_name='gbm' AND y_prob>=0.55) s
JOIN x_pos p ON p.symbol=s.symbol AND p.dt=s.dt WHERE s.rk<=3 AND s.next_open IS NOT NULL AND s.atr_14>0
 AND least(floor(100000.0e0/(s.entry_px-(s.entry_px-1.5e0*s.atr_14))), floor(5000000.0e0/3/s.entry_px))>=1"""

SWEEP = ((0.50, 0.55, 0.60), (1, 3, 5), (1.0, 1.5, 2.0, 2.5, 3.0))


def swept(d):
    s = predictions(d).filter("model_name = 'gbm'")
    return trades.param_sweep(s, trades.with_paths(d.ix, 5), *SWEEP, risk=DESK)


CTES["x_sw"] = "SELECT threshold, top_n, stop_atr, count(*) AS trades, sum(net_pnl)/10000000*100 AS return_pct FROM x_sweep GROUP BY 1, 2, 3"


@query("param_sweep", "SELECT threshold, top_n, stop_atr, trades, round(return_pct,5)+0.0 AS return_pct FROM x_sw")
def param_sweep(d):
    return rounded(trades.sweep_returns(swept(d), DESK.account), 5, threshold=6, stop_atr=6)


SENS = """count(*) AS variants, round(max(return_pct),5)+0.0 AS best, round(min(return_pct),5)+0.0 AS worst, round(median(return_pct),5)+0.0 AS median,
 round(avg(CASE WHEN return_pct<0 THEN 1 ELSE 0 END),5)+0.0 AS share_losing, round(max(return_pct)-min(return_pct),5)+0.0 AS spread FROM x_sw"""


@query(
    "sensitivity_summary",
    f"SELECT 'all' AS parameter, '' AS setting, {SENS}"
    + "".join(
        f" UNION ALL SELECT '{p}', printf('%.2f', CAST({p} AS DOUBLE)), {SENS} GROUP BY {p}" for p in ("threshold", "top_n", "stop_atr")
    ),
)
def sensitivity_summary(d):
    return rounded(trades.sensitivity_summary(trades.sweep_returns(swept(d), DESK.account)), 5)


# --------------------------------------------------------------------- journal
CTES["x_jp"] = """
SELECT *, abs(entry-stop) AS risk_per_share, abs(entry-stop)*shares AS dollar_risk, abs(target-entry)/abs(entry-stop) AS planned_rr,
 CASE WHEN direction='long' THEN exit-entry ELSE entry-exit END*shares AS gross_pnl, CASE WHEN direction='long' THEN exit-entry ELSE entry-exit END/abs(entry-stop) AS r_multiple,
 CASE WHEN exit IS NULL THEN 'open' ELSE 'closed' END AS state FROM x_journal"""
JP = "risk_per_share dollar_risk planned_rr gross_pnl r_multiple"


@query("journal_performance", f"SELECT row_id, state, {r(JP, 5)} FROM x_jp")
def journal_performance(d):
    p = trades.journal_performance(panels.journal(d.spark, d.dir))
    return rounded(p.select("row_id", "state", *JP.split()), 5)


@query(
    "journal_stats",
    """
WITH c AS (SELECT * FROM x_jp WHERE state='closed' AND closed_at IS NOT NULL AND gross_pnl IS NOT NULL),
e AS (SELECT closed_at, sum(sum(gross_pnl)) OVER (ORDER BY closed_at) AS eq FROM c GROUP BY closed_at)
SELECT count(*) AS trades, round(100*count(CASE WHEN gross_pnl>0 THEN 1 END)/count(*),4)+0.0 AS win_rate_pct, round(coalesce(avg(CASE WHEN gross_pnl>0 THEN gross_pnl END),0),4)+0.0 AS average_win,
 round(coalesce(avg(CASE WHEN gross_pnl<0 THEN gross_pnl END),0),4)+0.0 AS average_loss, round(sum(CASE WHEN gross_pnl>0 THEN gross_pnl END)/-sum(CASE WHEN gross_pnl<0 THEN gross_pnl END),6)+0.0 AS profit_factor,
 round(sum(gross_pnl),3)+0.0 AS net_pnl, round(avg(r_multiple),6)+0.0 AS average_r,
 round((SELECT max(greatest(pk,0)-eq) FROM (SELECT eq, max(eq) OVER (ORDER BY closed_at) AS pk FROM e)),3)+0.0 AS max_drawdown,
 round(100*count(CASE WHEN followed_plan>0 THEN 1 END)/count(followed_plan),4)+0.0 AS plan_adherence_pct FROM c""",
)
def journal_stats(d):
    p = trades.journal_performance(panels.journal(d.spark, d.dir))
    return rounded(trades.journal_stats(p), 4, net_pnl=3, max_drawdown=3, profit_factor=6, average_r=6)


@query(
    "risk_check",
    """
WITH bk AS (SELECT count(CASE WHEN state='open' THEN 1 END) AS open_positions, coalesce(sum(CASE WHEN state='open' THEN shares*entry END),0) AS open_notional,
  coalesce(sum(CASE WHEN state='closed' AND closed_at=DATE '2000-06-15' THEN gross_pnl END),0) AS realized_today FROM x_jp WHERE opened_at <= DATE '2000-06-15'),
p AS (SELECT *, (direction='long' AND stop>=entry) OR (direction='short' AND stop<=entry) OR coalesce(direction='long' AND target<=entry,false) OR coalesce(direction='short' AND target>=entry,false) AS bad,
  CAST(coalesce(floor(100.0e0/NULLIF(abs(entry-stop),0)),0) AS BIGINT) AS plan_shares, abs(entry-stop) AS rps FROM x_journal, bk)
SELECT row_id, plan_shares, open_positions, round(plan_shares*rps,4)+0.0 AS dollar_risk, round((open_notional+plan_shares*entry)/10000*100,1)+0.0 AS total_exposure_pct,
 concat_ws('; ', CASE WHEN bad THEN 'stop or target on the wrong side' END, CASE WHEN plan_shares<1 THEN 'size rounds to zero' END, CASE WHEN abs(target-entry)/rps<2.0 THEN 'risk-reward below minimum' END,
  CASE WHEN open_positions>=3 THEN 'max open positions' END, CASE WHEN (open_notional+plan_shares*entry)/10000*100>50 THEN 'exposure over the cap' END,
  CASE WHEN realized_today<=-300 THEN 'daily loss limit hit' END, CASE WHEN realized_today>-300 AND plan_shares*rps>300+realized_today THEN 'risk exceeds daily headroom' END) AS breaches FROM p""",
)
def risk_check(d):
    j = panels.journal(d.spark, d.dir)
    today = F.lit("2000-06-15").cast("date")
    open_book = trades.journal_performance(j).filter(F.col("opened_at") <= today)
    c = trades.risk_check(j, open_book, today)
    # exposure adds up thousands of positions: one decimal of a percentage is what two engines agree on
    return rounded(c.select("row_id", "plan_shares", "open_positions", "dollar_risk", "total_exposure_pct", "breaches"), 4, total_exposure_pct=1)
