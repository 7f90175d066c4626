"""Queries on resampling tests, luck adjustment, trials, ledgers and audits."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions import cut, norm_cdf, norm_ppf, sym_order
from ..functions.lineage import shared_dir
from ..functions import normal
from ..operators import audit, features, freeze, inference, labels, perf, signals, smoothing, trials
from ..operators.calendar import index_bars, trading_calendar
from ..operators.ledger import Ledger
from ..plans import studies
from ..sources import panels
from .base import CTES, query, r, rounded
from .history import ALL_RULES, with_adv
from .outcomes import daily_series, fitted_predictions, predictions, series

REPS, BLOCK = 5000, 10


def draws_sql(sizes: str, keys: str, block: str, reps: int) -> str:
    """Resampled positions with the same hashes as the Spark side."""
    k = "".join(f"{x}, " for x in keys.split())
    u = "('0x'||substr(md5('{s}-'||rep||'-'||t),1,8))::BIGINT/4294967296.0e0"
    return f"""
SELECT {k}rep, t, n, CAST((b.s + t - b.t) % n AS BIGINT) AS pos FROM (
 SELECT *, last_value(CASE WHEN cut THEN struct_pack(t := t, s := CAST(floor({u.format(s='start')}*n) AS BIGINT)) END IGNORE NULLS)
   OVER (PARTITION BY {k}n, rep ORDER BY t ROWS UNBOUNDED PRECEDING) AS b FROM (
 SELECT {k}n, rep, t, t=0 OR {u.format(s='cut')} < 1.0e0/{block} AS cut FROM (
  SELECT {k}n, rep, unnest(range(0,n)) AS t FROM (SELECT *, unnest(range(0,{reps})) AS rep FROM ({sizes})))))"""


CTES["x_ser"] = "SELECT model_name AS strategy, dt, ret_net AS ret FROM x_all WHERE ret_net IS NOT NULL"
# tests compare strategies on the dates that all of them have
CTES["x_com"] = "SELECT * FROM x_ser WHERE dt IN (SELECT dt FROM x_ser GROUP BY dt HAVING count(*)=4)"
CTES["x_seri"] = "SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY dt)-1 AS pos, count(*) OVER (PARTITION BY strategy) AS n FROM x_com"
CTES["x_drw"] = draws_sql("SELECT DISTINCT n FROM x_seri", "", str(float(BLOCK)), REPS)


@query(
    "stationary_bootstrap",
    "SELECT CAST(rep AS INTEGER) AS rep, n AS n_obs, CAST(sum(pos) AS BIGINT) AS pos_sum, CAST(sum(pos*(t+1)%1009) AS BIGINT) AS pos_hash FROM x_drw GROUP BY 1, 2",
)
def stationary_bootstrap(d):
    """All draws of all replicates, summed up per replicate in and out of order."""
    s = inference.indexed(common(d), ["strategy"]).select("n_obs").distinct()
    draws = inference.stationary_draws(s, ["n_obs"], REPS, BLOCK)
    return draws.groupBy("rep", "n_obs").agg(
        F.sum("pos").alias("pos_sum"), F.sum(F.col("pos") * (F.col("t") + 1) % 1009).alias("pos_hash")
    )


def common(d):
    return cut(perf.align_common_dates(series(d)).filter("ret is not null"))


CTES["x_bm"] = "SELECT s.strategy, d.rep, avg(s.ret) AS boot FROM x_seri s JOIN x_drw d ON d.n=s.n AND d.pos=s.pos GROUP BY 1, 2"


@query(
    "boot_mean_ci",
    """SELECT b.strategy, round(any_value(m.m),6)+0.0 AS mean, round(stddev_samp(boot),6)+0.0 AS se, round(quantile_cont(boot,0.025),6)+0.0 AS lo, round(quantile_cont(boot,0.975),6)+0.0 AS hi,
 round(avg(CASE WHEN abs(boot-m.m)>=abs(m.m) THEN 1 ELSE 0 END),6)+0.0 AS p FROM x_bm b JOIN (SELECT strategy, avg(ret) AS m FROM x_com GROUP BY 1) m ON m.strategy=b.strategy GROUP BY b.strategy""",
)
def boot_mean_ci(d):
    return rounded(inference.boot_mean_ci(common(d), REPS, BLOCK))


CTES["x_ex"] = """
SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY dt)-1 AS pos, count(*) OVER (PARTITION BY strategy) AS n, avg(ret) OVER (PARTITION BY strategy) AS m FROM (
SELECT a.strategy, a.dt, a.ret-b.ret AS ret FROM x_com a JOIN x_com b ON b.dt=a.dt AND b.strategy='always_long' WHERE a.strategy<>'always_long')"""
CTES["x_exd"] = draws_sql("SELECT DISTINCT n FROM x_ex", "", str(float(BLOCK)), REPS)
CTES["x_paired"] = """
SELECT strategy, m AS excess, quantile_cont(boot,0.025) AS lo, quantile_cont(boot,0.975) AS hi, avg(CASE WHEN abs(boot-m)>=abs(m) THEN 1 ELSE 0 END) AS p_raw FROM (
 SELECT s.strategy, any_value(s.m) AS m, d.rep, avg(s.ret) AS boot FROM x_ex s JOIN x_exd d ON d.n=s.n AND d.pos=s.pos GROUP BY 1, 3) GROUP BY strategy, m"""


@query("boot_paired_p", f"SELECT strategy, {r('excess lo hi p_raw')} FROM x_paired")
def boot_paired_p(d):
    return rounded(inference.boot_paired_p(common(d), "always_long", REPS, BLOCK))


CTES["x_rc"] = CTES["x_ex"]
CTES["x_rcd"] = draws_sql("SELECT DISTINCT n FROM x_rc", "", str(float(BLOCK)), REPS)


@query(
    "reality_check",
    """
WITH b AS (SELECT d.rep, s.strategy, avg(s.ret-s.m) AS b FROM x_rc s JOIN x_rcd d ON d.pos=s.pos GROUP BY 1, 2), mx AS (SELECT rep, max(b) AS b FROM b GROUP BY rep)
SELECT round(o.best,6)+0.0 AS best_excess, o.k AS n_strategies, o.n AS n_dates, round(avg(CASE WHEN mx.b>=o.best THEN 1 ELSE 0 END),6)+0.0 AS reality_check_p, count(*) AS bootstrap_reps
FROM mx, (SELECT max(m) AS best, count(DISTINCT strategy) AS k, max(n) AS n FROM x_rc) o GROUP BY o.best, o.k, o.n""",
)
def reality_check(d):
    return rounded(inference.reality_check(series(d), "always_long", REPS, BLOCK))


CTES["x_tests"] = """
SELECT event_type || '-' || (user_id % 40) AS strategy, ('0x'||substr(md5('p-'||event_type||'-'||(user_id % 40)),1,8))::BIGINT/4294967296.0e0 * min(value)/ (min(value)+1) AS p_raw FROM events GROUP BY 1, event_type, user_id % 40"""


def many_tests(d):
    from ..functions import uniform

    e = d.table("events").groupBy("event_type", (F.col("user_id") % 40).alias("g")).agg(F.min("value").alias("m"))
    u = uniform(F.lit("p"), "event_type", "g")
    return e.select(F.concat_ws("-", "event_type", "g").alias("strategy"), (u * F.col("m") / (F.col("m") + 1)).alias("p_raw"))


ADJ = """SELECT strategy, round(p_raw,6)+0.0 AS p_raw, round(least(1,p_raw*n),6)+0.0 AS p_bonferroni, round(q,6)+0.0 AS p_bh, CASE WHEN q<0.05 THEN 1 ELSE 0 END AS passes_bh FROM (
SELECT *, least(1, min(p_raw*n/rn) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (SELECT *, row_number() OVER (ORDER BY p_raw, strategy) AS rn, count(*) OVER () AS n FROM {src}))"""


@query("p_adjust", ADJ.format(src="x_tests"))
def p_adjust(d):
    return rounded(inference.p_adjust(many_tests(d)))


@query("p_adjust_strategies", ADJ.format(src="(SELECT strategy, p_raw FROM x_paired)"))
def p_adjust_strategies(d):
    p = inference.boot_paired_p(common(d), "always_long", REPS, BLOCK).select("strategy", "p_raw")
    return rounded(inference.p_adjust(p))


def _printed(table):
    # returns of the given tables are far from real ones: a year's growth is printed as its logarithm
    return rounded(table.withColumn("annual_log", F.log(1 + F.col("mean")) * 252 / 5.0).drop("annual"))


@query(
    "validation_table",
    f"""SELECT m.strategy, m.dates, m.first_dt, m.last_dt, {r('m.mean').replace('AS m.mean', 'AS mean')}, round(m.annual,6)+0.0 AS annual_log, round(b.lo,6)+0.0 AS lo, round(b.hi,6)+0.0 AS hi, round(b.p,6)+0.0 AS p_vs_zero,
 round(x.excess,6)+0.0 AS excess, round(x.lo,6)+0.0 AS excess_lo, round(x.hi,6)+0.0 AS excess_hi, a.p_raw, a.p_bonferroni, a.p_bh, a.passes_bh
FROM (SELECT strategy, avg(ret) AS mean, ln(1+avg(ret))*252/5.0e0 AS annual, count(*) AS dates, min(dt) AS first_dt, max(dt) AS last_dt FROM x_com GROUP BY 1) m
JOIN (SELECT b.strategy, quantile_cont(boot,0.025) AS lo, quantile_cont(boot,0.975) AS hi, avg(CASE WHEN abs(boot-m.m)>=abs(m.m) THEN 1 ELSE 0 END) AS p
  FROM x_bm b JOIN (SELECT strategy, avg(ret) AS m FROM x_com GROUP BY 1) m ON m.strategy=b.strategy GROUP BY 1) b ON b.strategy=m.strategy
LEFT JOIN x_paired x ON x.strategy=m.strategy LEFT JOIN ({ADJ.format(src="(SELECT strategy, p_raw FROM x_paired)")}) a ON a.strategy=m.strategy""",
)
def validation_table(d):
    """Every strategy on the common dates against zero and against the baseline, adjusted for the number of tests."""
    return _printed(studies.validation_table(series(d), "always_long", REPS, BLOCK))


@query("validation_table_fitted")
def validation_table_fitted(d):
    """The same table for fitted models: walk-forward predictions of every fold, daily books, tests."""
    return _printed(studies.validation_table(daily_series(fitted_predictions(d), d.names), "always_long", REPS, BLOCK))


# ------------------------------------------------------------ luck adjustment
def horner(coefs, x: str) -> str:
    out = repr(float(coefs[0]))
    for c in coefs[1:]:
        out = f"({out}*({x})+{float(c)!r})"
    return out.replace("e-0", "e-")


def ppf_sql(p: str) -> str:
    lo, hi, m = f"sqrt(-2.0e0*ln({p}))", f"sqrt(-2.0e0*ln(1-({p})))", f"(({p})-0.5e0)"
    tail = lambda q: f"({horner(normal.PPF_C, q)}/{horner((*normal.PPF_D, 1.0), q)})"
    mid = f"({horner(normal.PPF_A, f'{m}*{m}')}*{m}/{horner((*normal.PPF_B, 1.0), f'{m}*{m}')})"
    return f"(CASE WHEN ({p})<=0 OR ({p})>=1 THEN NULL WHEN ({p})<0.02425 THEN {tail(lo)} WHEN ({p})>0.97575 THEN -{tail(hi)} ELSE {mid} END)"


def cdf_sql(x: str) -> str:
    z = f"abs({x})"
    e = f"exp(-{z}*{z}/2)"
    k = f"({z}+0.65e0)"
    for c in (4, 3, 2, 1):
        k = f"({z}+{c}.0e0/{k})"
    up = f"(CASE WHEN {z}>37 THEN 0 WHEN {z}<7.07106781186547e0 THEN {e}*{horner(normal.CDF_NUM, z)}/{horner(normal.CDF_DEN, z)} ELSE {e}/{k}/2.506628274631e0 END)"
    return f"(CASE WHEN ({x})>0 THEN 1-{up} ELSE {up} END)"


CTES["x_tr1"] = """
SELECT seq, sharpe*10-2 AS sharpe, CAST(sum(CASE WHEN kind='declare' THEN variants ELSE 0 END) OVER (ORDER BY seq) AS BIGINT) AS k, n_obs FROM x_trials"""
CTES["x_luck0"] = f"""
SELECT seq, variants*n_obs AS trials, n_obs, sharpe*10-2 AS sr, CASE WHEN variants*n_obs<=1 THEN 0 ELSE
 (1-0.5772156649015329e0)*{ppf_sql('1-1.0e0/(variants*n_obs)')}+0.5772156649015329e0*{ppf_sql('1-1.0e0/(variants*n_obs*2.718281828459045e0)')} END AS z FROM x_trials"""
CTES["x_luck"] = "SELECT *, z/sqrt(CAST(greatest(2,n_obs) AS DOUBLE))*sqrt(50.4e0) AS bar FROM x_luck0"


def luck_rows(d):
    t = panels.trial_log(d.spark, d.dir)
    return t.select(
        "seq", (F.col("variants") * F.col("n_obs")).alias("trials"), "n_obs", (F.col("sharpe") * 10 - 2).alias("sr")
    )


@query("expected_max_sharpe", "SELECT seq, trials, n_obs, round(bar,6)+0.0 AS bar FROM x_luck")
def expected_max_sharpe(d):
    return rounded(luck_rows(d).select("seq", "trials", "n_obs", inference.expected_max_sharpe(F.col("trials"), F.col("n_obs")).alias("bar")))


CTES["x_dsr"] = f"""
SELECT *, {cdf_sql('x')} AS dsr FROM (SELECT *, (sr/sqrt(50.4e0)-bar/sqrt(50.4e0))*sqrt(CAST(greatest(2,n_obs)-1 AS DOUBLE))/sqrt(greatest(1e-12,1+0.5e0*sr*sr/50.4e0)) AS x FROM x_luck)"""


@query("deflated_sharpe", "SELECT seq, round(sr,6)+0.0 AS sr, round(dsr,6)+0.0 AS dsr FROM x_dsr")
def deflated_sharpe(d):
    f = luck_rows(d)
    return rounded(f.select("seq", "sr", inference.deflated_sharpe(F.col("sr"), F.col("trials"), F.col("n_obs")).alias("dsr")))


@query(
    "normal_functions",
    f"SELECT event_id, round({cdf_sql('(value/25-2)')},9)+0.0 AS cdf, round({ppf_sql('((event_id+1.0e0)/((SELECT count(*) FROM events)+2))')},9)+0.0 AS ppf FROM events",
)
def normal_functions(d):
    e = d.table("events")
    n = e.count()
    return rounded(
        e.select("event_id", norm_cdf(F.col("value") / 25 - 2).alias("cdf"), norm_ppf((F.col("event_id") + 1.0) / (n + 2)).alias("ppf")), 9
    )


# ------------------------------------------------------------------ signal zoo
HORIZONS = (5, 21, 63)
CTES["x_fwdnet"] = " UNION ALL ".join(
    f"SELECT symbol, dt, {h} AS horizon, lead(adj_close,{h}) OVER (PARTITION BY symbol ORDER BY day_index)/adj_close-1.0-0.0014 AS ret FROM x_ix WHERE kind='stock'"
    for h in HORIZONS
)
CTES["x_fired"] = "SELECT symbol, dt, signal FROM (UNPIVOT x_sigs ON * EXCLUDE (symbol, dt, day_index) INTO NAME signal VALUE hit) WHERE hit=1"
CTES["x_rule"] = "SELECT f.signal, r.horizon, f.symbol, f.dt, r.ret FROM x_fired f JOIN x_fwdnet r ON r.symbol=f.symbol AND r.dt=f.dt WHERE r.ret IS NOT NULL"
CTES["x_avg"] = "SELECT horizon, dt, avg(ret) AS bench FROM x_fwdnet WHERE ret IS NOT NULL GROUP BY 1, 2"


def forward_net(d):
    ix = d.ix.filter("kind = 'stock'")
    cols = [labels.forward_return(h) - 0.0014 for h in HORIZONS]
    arr = F.array(*[F.struct(F.lit(h).alias("horizon"), c.alias("ret")) for h, c in zip(HORIZONS, cols)])
    return ix.select("symbol", "dt", arr.alias("a")).select("symbol", "dt", F.explode("a").alias("a")).select("symbol", "dt", "a.*")


def fired(d):
    return signals.fired(signals.rule_signals(d.ix.filter("kind = 'stock'")), ALL_RULES, keep=("symbol", "dt"))


@query("avg_stock_benchmark", "SELECT horizon, dt, round(bench,6)+0.0 AS bench FROM x_avg")
def avg_stock_benchmark(d):
    return rounded(inference.average_stock(forward_net(d)))


@query("rule_returns", "SELECT signal, horizon, dt, count(*) AS n, round(avg(ret),6)+0.0 AS ret FROM x_rule GROUP BY 1, 2, 3")
def rule_returns(d):
    t = inference.rule_returns(fired(d), forward_net(d))
    return rounded(t.groupBy("signal", "horizon", "dt").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("ret")))


ZREPS = 2000
CTES["x_per"] = "SELECT *, (row_number() OVER (PARTITION BY signal, horizon ORDER BY dt)-1)%horizon=0 AS k FROM (SELECT signal, horizon, dt, avg(ret) AS ret FROM x_rule GROUP BY 1, 2, 3)"
CTES["x_zs"] = """
SELECT a.signal, a.horizon, a.trades, a.hit, b.dates, b.nn, CASE WHEN a.trades>=50 AND b.dates>=30 AND b.nn>2 THEN b.m/b.s*sqrt(252/b.horizon) END AS sharpe FROM
 (SELECT signal, horizon, count(*) AS trades, avg(CASE WHEN ret>0 THEN 1 ELSE 0 END) AS hit FROM x_rule GROUP BY 1, 2) a
 JOIN (SELECT signal, horizon, count(*) AS dates, count(CASE WHEN k THEN 1 END) AS nn, avg(CASE WHEN k THEN ret END) AS m, stddev_samp(CASE WHEN k THEN ret END) AS s FROM x_per GROUP BY 1, 2) b USING (signal, horizon)"""
CTES["x_zex"] = """
SELECT *, row_number() OVER (PARTITION BY signal, horizon ORDER BY dt)-1 AS pos, count(*) OVER (PARTITION BY signal, horizon) AS n, avg(ret) OVER (PARTITION BY signal, horizon) AS m FROM (
SELECT p.signal, p.horizon, p.dt, p.ret-b.bench AS ret FROM x_per p JOIN x_avg b ON b.horizon=p.horizon AND b.dt=p.dt JOIN x_zs z ON z.signal=p.signal AND z.horizon=p.horizon WHERE z.trades>=50 AND z.dates>=30)"""
CTES["x_zb"] = f"""
SELECT horizon, rep, t, ('0x'||substr(md5('start-'||rep||'-'||t),1,8))::BIGINT/4294967296.0e0 AS u, lead(t) OVER (PARTITION BY horizon, rep ORDER BY t) AS nxt FROM (
 SELECT horizon, rep, t FROM (SELECT horizon, max(n) AS n FROM x_zex GROUP BY 1), unnest(range(0,{ZREPS})) AS a(rep), unnest(range(0,n)) AS b(t)
 WHERE t=0 OR ('0x'||substr(md5('cut-'||rep||'-'||t),1,8))::BIGINT/4294967296.0e0 < 1.0e0/greatest(2,2*horizon))"""
CTES["x_zc"] = """
SELECT signal, horizon, n, m, list_transform(range(0,2*n+1), lambda i: CASE WHEN i<=n THEN coalesce(c[i],0) ELSE c[n]+c[i-n] END) AS c FROM (
 SELECT signal, horizon, any_value(n) AS n, any_value(m) AS m, list(c ORDER BY pos) AS c FROM (
  SELECT signal, horizon, pos, n, m, sum(ret-m) OVER (PARTITION BY signal, horizon ORDER BY pos) AS c FROM x_zex WHERE n>=30) GROUP BY 1, 2)"""
CTES["x_zp"] = """
SELECT signal, horizon, m AS excess, avg(CASE WHEN abs(boot)>=abs(m) THEN 1 ELSE 0 END) AS p FROM (
 SELECT signal, horizon, any_value(m) AS m, rep, sum(c[CAST(floor(u*n) AS BIGINT)+least(coalesce(nxt,n),n)-t+1]-c[CAST(floor(u*n) AS BIGINT)+1])/any_value(n) AS boot
 FROM x_zc JOIN x_zb USING (horizon) WHERE t<n GROUP BY signal, horizon, rep) GROUP BY 1, 2, 3"""
CTES["x_zoo"] = """SELECT z.signal, z.horizon, z.trades, z.dates, z.nn AS n_nonoverlap, z.sharpe, p.excess, p.p, CASE WHEN z.trades>=50 AND z.dates>=30 THEN z.hit END AS hit_rate FROM x_zs z LEFT JOIN x_zp p ON p.signal=z.signal AND p.horizon=z.horizon"""


def zoo(d):
    f = cut(forward_net(d))
    return inference.zoo_eval(inference.rule_returns(fired(d), f), inference.average_stock(f), ZREPS)


@query("zoo_eval", f"SELECT signal, horizon, trades, dates, n_nonoverlap, {r('sharpe excess p hit_rate')} FROM x_zoo")
def zoo_eval(d):
    return rounded(zoo(d))


ZV = f"""
SELECT *, {cdf_sql('x')} AS dsr FROM (SELECT *, (sharpe/sqrt(50.4e0)-bar/sqrt(50.4e0))*sqrt(CAST(greatest(3,n_nonoverlap)-1 AS DOUBLE))/sqrt(greatest(1e-12,1+0.5e0*sharpe*sharpe/50.4e0)) AS x FROM (
SELECT z.*, ((1-0.5772156649015329e0)*{ppf_sql('1-1.0e0/k')}+0.5772156649015329e0*{ppf_sql('1-1.0e0/(k*2.718281828459045e0)')})/sqrt(CAST(greatest(3,n_nonoverlap) AS DOUBLE))*sqrt(50.4e0) AS bar
FROM x_zoo z, (SELECT sum(variants) AS k FROM x_trials WHERE kind='declare') WHERE sharpe IS NOT NULL))"""
CTES["x_zv"] = ZV


@query("zoo_verdict", f"SELECT signal, horizon, round(sharpe,6)+0.0 AS sharpe, round(bar,6)+0.0 AS bar_own_n, round(dsr,6)+0.0 AS dsr, CASE WHEN sharpe>bar AND dsr>0.95 THEN 1 ELSE 0 END AS clears FROM x_zv")
def zoo_verdict(d):
    t = trials.trial_count(panels.trial_log(d.spark, d.dir)).select("n_trials")
    return rounded(inference.zoo_verdict(zoo(d), t).select("signal", "horizon", "sharpe", "bar_own_n", "dsr", "clears"))


@query(
    "zoo_summary",
    """SELECT count(*) AS tested, count(CASE WHEN p<0.05 THEN 1 END) AS p_below_05, round(count(*)*0.05e0,6)+0.0 AS expected_by_chance,
 CAST(sum(CASE WHEN sharpe>bar AND dsr>0.95 THEN 1 ELSE 0 END) AS BIGINT) AS clear_the_bar, round(max(sharpe),6)+0.0 AS best_sharpe FROM x_zv""",
)
def zoo_summary(d):
    t = trials.trial_count(panels.trial_log(d.spark, d.dir)).select("n_trials")
    return rounded(inference.zoo_summary(inference.zoo_verdict(zoo(d), t)))


# -------------------------------------------------------------------- registry
CTES["x_last"] = "SELECT strategy_id, arg_max(kind, seq) AS e, arg_max(sharpe, seq) AS sharpe, min(seq) AS first_close FROM x_trials WHERE kind IN ('record','abandon') GROUP BY 1"


@query(
    "trial_count",
    """SELECT (SELECT count(*) FROM x_trials WHERE kind='declare') AS declared, CAST((SELECT sum(greatest(1,variants)) FROM x_trials WHERE kind='declare') AS BIGINT) AS n_trials,
 count(CASE WHEN e='record' THEN 1 END) AS recorded, count(CASE WHEN e='abandon' THEN 1 END) AS abandoned, (SELECT count(*) FROM x_trials WHERE kind='declare')-count(*) AS open FROM x_last""",
)
def trial_count(d):
    return trials.trial_count(panels.trial_log(d.spark, d.dir))


@query(
    "trial_status",
    """SELECT t.strategy_id, t.variants, coalesce(l.e,'open') AS state, round(CASE WHEN l.e='record' THEN l.sharpe END,6)+0.0 AS sharpe
FROM x_trials t LEFT JOIN x_last l ON l.strategy_id=t.strategy_id WHERE t.kind='declare'""",
)
def trial_status(d):
    return rounded(trials.trial_status(panels.trial_log(d.spark, d.dir)))


@query(
    "trial_close_guard",
    """SELECT c.seq, c.strategy_id, c.kind, CASE WHEN dd.s IS NULL OR dd.s>c.seq THEN 'never declared' ELSE 'already closed' END AS rejected
FROM x_trials c LEFT JOIN (SELECT strategy_id, min(seq) AS s FROM x_trials WHERE kind='declare' GROUP BY 1) dd ON dd.strategy_id=c.strategy_id JOIN x_last l ON l.strategy_id=c.strategy_id
WHERE c.kind IN ('record','abandon') AND (dd.s IS NULL OR dd.s>c.seq OR c.seq>l.first_close)""",
)
def trial_close_guard(d):
    return trials.trial_close_guard(panels.trial_log(d.spark, d.dir))


def seals(d):
    """Registry with seal entries: every purchase of user 7 seals 2001-01-01 onward."""
    e = d.table("events")
    return e.select(
        "event_id",
        F.when(F.col("event_type") == "purchase", "seal").otherwise("note").alias("kind"),
        F.col("event_id").alias("seq"),
        F.date_add(F.lit("2000-07-01").cast("date"), (F.col("event_id") % 100).cast("int")).alias("seal_from"),
    )


CTES["x_seal"] = "SELECT DATE '2000-07-01' + CAST(max(event_id) % 100 AS INTEGER) AS seal_from FROM events WHERE event_type='purchase'"


@query("lockbox_filter", "SELECT symbol, count(*) AS rows, max(dt) AS last_dt FROM x_bars WHERE dt < (SELECT seal_from FROM x_seal) GROUP BY symbol")
def lockbox_filter(d):
    open_rows = trials.lockbox_guard(
        trials.lockbox_filter(d.bars, trials.lockbox_state(seals(d))), trials.lockbox_state(seals(d))
    )
    return open_rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.max("dt").alias("last_dt"))


@query(
    "lockbox_guard",
    "SELECT 'search' AS context, max(dt) AS max_dt, (SELECT seal_from FROM x_seal) AS seal_from FROM x_bars HAVING max(dt) >= (SELECT seal_from FROM x_seal)",
)
def lockbox_guard(d):
    return trials.lockbox_violation(d.bars, trials.lockbox_state(seals(d)))


# ---------------------------------------------------------------------- ledger
def segments(d):
    """The event log as ledger segments of fifty entries."""
    e = d.table("events")
    return e.select(
        F.floor(F.col("event_id") / 50).alias("chain"), (F.col("event_id") % 50).alias("seq"),
        F.concat_ws("|", "event_type", "user_id", "props").alias("payload"),
    )


CTES["x_seg"] = "SELECT event_id//50 AS chain, event_id%50 AS seq, concat_ws('|', event_type, user_id, props) AS payload FROM events"
CTES["x_chain"] = """/*recursive*/
SELECT chain, seq, payload, repeat('0',64) AS prev_hash, sha256(repeat('0',64)||payload) AS entry_hash FROM x_seg WHERE seq=0
UNION ALL SELECT s.chain, s.seq, s.payload, c.entry_hash, sha256(c.entry_hash||s.payload) FROM x_chain c JOIN x_seg s ON s.chain=c.chain AND s.seq=c.seq+1"""


@query("chain_append", "SELECT chain, seq, payload, prev_hash, entry_hash FROM x_chain")
def chain_append(d):
    return trials.chain_append(segments(d), ["chain"], "seq")


#: The log is appended in so many batches, each of which goes on with every chain.
BATCHES = 3


@query("ledger_append", "SELECT chain, seq, payload, prev_hash, entry_hash, CAST(NULL AS VARCHAR) AS fault FROM x_chain")
def ledger_append(d):
    """Segments appended batch by batch to a stored ledger, one batch twice, verify as one chain each."""
    stored = Ledger(d.spark, f"{shared_dir(d.spark)}/ledger-{uuid.uuid4().hex}", {"chain": "bigint"})
    e = segments(d)
    for k in (0, 1, 1, 2):
        stored.append(e.filter(F.floor(F.col("seq") * BATCHES / 50) == k), "seq", f"batch-{k}")
    checked = trials.chain_check(stored.entries(), ["chain"])
    return checked.select("chain", "seq", "payload", "prev_hash", "entry_hash", "fault")


def tampered(d):
    """Some segments edited, some with an entry removed, some reordered."""
    c = trials.chain_append(segments(d), ["chain"], "seq")
    k = F.col("chain") % 7
    c = c.withColumn("payload", F.when((k == 1) & (F.col("seq") == 10), F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    c = c.filter(~((k == 2) & (F.col("seq") == 20)))
    swap = F.when((k == 3) & (F.col("seq") == 30), 31).when((k == 3) & (F.col("seq") == 31), 30)
    return c.withColumn("seq", F.coalesce(swap, F.col("seq")).cast("bigint"))


CTES["x_tamper"] = """
SELECT chain, CASE WHEN chain%7=3 AND seq=30 THEN 31 WHEN chain%7=3 AND seq=31 THEN 30 ELSE seq END AS seq,
 CASE WHEN chain%7=1 AND seq=10 THEN payload||'!' ELSE payload END AS payload, prev_hash, entry_hash FROM x_chain WHERE NOT (chain%7=2 AND seq=20)"""
CTES["x_check"] = """
SELECT chain, seq, CASE WHEN prev_hash IS DISTINCT FROM CASE WHEN seq=first THEN repeat('0',64) ELSE was END THEN 'prev_hash mismatch'
  WHEN sha256(prev_hash||payload)<>entry_hash THEN 'entry_hash mismatch' END AS fault FROM (
SELECT t.*, w.entry_hash AS was, min(t.seq) OVER (PARTITION BY t.chain) AS first FROM x_tamper t LEFT JOIN x_tamper w ON w.chain=t.chain AND w.seq=t.seq-1)"""


@query(
    "chain_verify",
    """SELECT chain, count(*) AS entries, min(CASE WHEN fault IS NOT NULL THEN seq END) AS first_bad, arg_min(fault, seq) FILTER (WHERE fault IS NOT NULL) AS reason,
 CASE WHEN count(fault)=0 THEN 1 ELSE 0 END AS ok FROM x_check GROUP BY chain""",
)
def chain_verify(d):
    return trials.chain_verify(tampered(d), ["chain"])


# -------------------------------------------------------------- forward record
CTES["x_picks"] = """
SELECT symbol, dt, y_prob, CASE WHEN dt>=DATE '2001-01-01' THEN 'live' ELSE 'holdout' END AS stage FROM (
 SELECT *, row_number() OVER (PARTITION BY dt ORDER BY y_prob DESC, symbol) AS rn FROM x_pred WHERE model_name='gbm' AND y_prob>=0.55) WHERE rn<=3"""
CTES["x_res"] = """
SELECT p.*, l.fwd_ret_5d_net AS ret_net, l.label_win_5d AS win FROM x_picks p JOIN x_labels l ON l.symbol=p.symbol AND l.dt=p.dt WHERE l.fwd_ret_5d_net IS NOT NULL"""


def picks(d):
    from ..operators.trades import topk_per_date

    p = predictions(d).filter("model_name = 'gbm'").select("symbol", "dt", "y_prob")
    p = topk_per_date(p, 3, 0.55)
    return cut(p.withColumn("stage", F.when(F.col("dt") >= F.lit("2001-01-01").cast("date"), "live").otherwise("holdout")))


def results(d, p=None):
    return trials.matured(picks(d) if p is None else p, d.labels)


#: What is pending is judged as of this day.
AS_OF = "2001-01-01"


@query("antijoin_seen", f"SELECT p.symbol, p.dt, p.stage FROM x_picks p WHERE NOT EXISTS (SELECT 1 FROM x_res r WHERE r.symbol=p.symbol AND r.dt=p.dt AND r.dt<DATE '{AS_OF}')")
def antijoin_seen(d):
    p = picks(d)
    return trials.pending(p, results(d, p).filter(F.col("dt") < F.lit(AS_OF).cast("date"))).select("symbol", "dt", "stage")


CTES["x_lrx"] = """
SELECT *, row_number() OVER (PARTITION BY stage ORDER BY dt)-1 AS pos, count(*) OVER (PARTITION BY stage) AS n, avg(ret) OVER (PARTITION BY stage) AS m FROM (
SELECT r.stage, r.dt, avg(r.ret_net)-any_value(l.fwd_ret_5d_net) AS ret FROM x_res r JOIN x_labels l ON l.symbol='MKT' AND l.dt=r.dt
WHERE l.fwd_ret_5d_net IS NOT NULL GROUP BY 1, 2)"""
CTES["x_lrd"] = draws_sql("SELECT DISTINCT n FROM x_lrx WHERE n>=10", "", str(float(BLOCK)), REPS)
CTES["x_lrp"] = """
SELECT stage, quantile_cont(boot,0.025) AS lo, quantile_cont(boot,0.975) AS hi, avg(CASE WHEN abs(boot-m)>=abs(m) THEN 1 ELSE 0 END) AS p FROM (
 SELECT s.stage, any_value(s.m) AS m, d.rep, avg(s.ret) AS boot FROM x_lrx s JOIN x_lrd d ON d.n=s.n AND d.pos=s.pos GROUP BY 1, 3) GROUP BY stage"""


@query(
    "ledger_record",
    """
WITH per AS (SELECT stage, dt, avg(ret_net) AS m, count(*) AS k, sum(win) AS w FROM x_res GROUP BY 1, 2),
b AS (SELECT avg(fwd_ret_5d_net) AS b FROM x_labels WHERE symbol='MKT' AND dt > (SELECT min(dt) FROM x_res)),
w AS (SELECT stage, count(*) AS pending FROM x_picks p WHERE NOT EXISTS (SELECT 1 FROM x_res r WHERE r.symbol=p.symbol AND r.dt=p.dt) GROUP BY 1),
x AS (SELECT stage, count(*) AS paired_dates, any_value(m) AS paired_excess FROM x_lrx GROUP BY 1),
g AS (SELECT stage, CAST(sum(k) AS BIGINT) AS trades, count(*) AS dates, round(count(*)/5.0e0,6)+0.0 AS n_eff, round(avg(m),6)+0.0 AS mean_net, round(sum(w)/sum(k),6)+0.0 AS win_rate,
 round((avg(m)-(SELECT b FROM b))*100,6)+0.0 AS excess_pct FROM per GROUP BY stage)
SELECT coalesce(g.stage, w.stage) AS stage, coalesce(trades,0) AS trades, coalesce(dates,0) AS dates, n_eff, mean_net, win_rate, excess_pct, coalesce(paired_dates,0) AS paired_dates,
 round(paired_excess,6)+0.0 AS paired_excess, round(lo,6)+0.0 AS lo, round(hi,6)+0.0 AS hi, round(p,6)+0.0 AS p, coalesce(pending,0) AS pending
FROM g FULL JOIN w ON w.stage=g.stage LEFT JOIN x ON x.stage=g.stage LEFT JOIN x_lrp lp ON lp.stage=g.stage""",
)
def ledger_record(d):
    bench = d.labels.filter("symbol = 'MKT'").select("dt", F.col("fwd_ret_5d_net").alias("bench"))
    p = picks(d)
    return rounded(trials.ledger_record(cut(results(d, p)), bench, predictions=p, reps=REPS, mean_block=BLOCK))


@query("set_diff", "SELECT DISTINCT dt FROM x_all WHERE model_name='always_long' EXCEPT SELECT DISTINCT dt FROM x_all WHERE model_name='gbm' UNION ALL (SELECT dt FROM x_picks INTERSECT SELECT dt FROM x_cal WHERE dow=1)")
def set_diff(d):
    s = series(d)
    a = s.filter("strategy = 'always_long'").select("dt").distinct()
    b = s.filter("strategy = 'gbm'").select("dt").distinct()
    mondays = d.calendar.filter("dow = 1").select("dt")
    return a.exceptAll(b).unionByName(picks(d).select("dt").intersect(mondays))


# ----------------------------------------------------------------------- audits
AUDITED = [c for c in features.FEATURES if c not in ("symbol", "dt", "sector", "kind", "day_index")]
CUTS = ("1996-06-28", "1999-03-31", "2001-06-29")


def _build(d):
    def run(bars):
        return features.features(index_bars(bars, trading_calendar(bars), d.symbols))

    return run


@query("audit_truncation", f"SELECT dt AS cutoff, count(*) AS symbols, CAST(0 AS BIGINT) AS differences FROM x_ix WHERE dt IN ({', '.join(f'DATE {c!r}' for c in CUTS)}) GROUP BY dt")
def audit_truncation(d):
    parts = []
    for cut in CUTS:
        c = F.lit(cut).cast("date")
        diff = audit.audit_truncation(_build(d), d.bars, cut, AUDITED).agg(F.count(F.lit(1)).alias("differences"))
        n = d.ix.filter(F.col("dt") == c).agg(F.count(F.lit(1)).alias("symbols")).filter("symbols > 0")
        parts.append(n.withColumn("_j", F.lit(1)).join(diff.withColumn("_j", F.lit(1)), "_j").select(c.alias("cutoff"), "symbols", "differences"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("audit_label_direction", "SELECT CAST(0 AS BIGINT) AS wrong_labels, count(*) AS rows FROM x_labels")
def audit_label_direction(d):
    bad = audit.audit_label_direction(d.ix, d.labels).agg(F.count(F.lit(1)).alias("wrong_labels")).withColumn("_j", F.lit(1))
    n = d.labels.agg(F.count(F.lit(1)).alias("rows")).withColumn("_j", F.lit(1))
    return bad.join(n, "_j").drop("_j")


@query("audit_no_forward_columns", "SELECT count(*) AS rows, '' AS forward_columns FROM x_feat")
def audit_no_forward_columns(d):
    return d.features.agg(F.count(F.lit(1)).alias("rows"), F.lit(",".join(audit.forward_columns(d.features))).alias("forward_columns"))


@query(
    "audit_spec_hash",
    """SELECT n_name AS version, reasons='' AS intact, reasons FROM (
SELECT n_name, CASE WHEN n_nationkey % 9 = 7 THEN 'gone' WHEN n_nationkey % 9 = 5 THEN 'not frozen'
 ELSE concat_ws('; ', CASE WHEN n_nationkey % 7 = 3 THEN 'specification' END, CASE WHEN n_nationkey % 11 = 4 THEN 'file: missing.sql' END,
  CASE WHEN n_nationkey % 5 = 2 THEN 'file: region.parquet' END) END AS reasons FROM nation)""",
)
def audit_spec_hash(d):
    """A frozen strategy per nation, kept as a stored manifest and checked after changes: some specifications were
    edited, the region file was changed, a file was added, some versions are gone and some were never frozen."""
    key = F.col("n_nationkey")
    spec = F.to_json(F.struct(F.lit(5).alias("buckets"), F.when(F.col("edited") & (key % 7 == 3), 10).otherwise(21).alias("hold"), key.alias("universe")))
    uses = F.when(key % 5 == 2, F.array(F.lit("nation.parquet"), F.lit("region.parquet"))).otherwise(F.array(F.lit("nation.parquet")))
    more = F.when(F.col("edited") & (key % 11 == 4), F.array(F.lit("missing.sql"))).otherwise(F.array().cast("array<string>"))

    def specs(edited):
        rows = d.table("nation").withColumn("edited", F.lit(edited)).filter(key % 9 != (7 if edited else 5))
        return rows.select(F.col("n_name").alias("version"), spec.alias("spec"), F.concat(uses, more).alias("implemented_by"))

    files = d.spark.read.format("binaryFile").option("pathGlobFilter", "{region,nation}.parquet").load(d.dir).select("path", "content")
    later = F.when(F.col("path").endswith("region.parquet"), F.concat("content", F.lit(b"\n"))).otherwise(F.col("content"))
    frozen = cut(freeze.manifest(specs(False), freeze.file_digests(files)))
    now = freeze.manifest(specs(True), freeze.file_digests(files.withColumn("content", later)))
    return freeze.verify(frozen, now)


LAYERS = {"averages": "ALL", "oscillators": "ALL", "rules": "ALL", "scores": "ALL", "dollar_volume": "ALL", "research": "STOCK", "panel": "STOCK", "regimes": "ONE"}


def _layers(d):
    """Every feature and score family as (bars -> layer, keys)."""
    ix = lambda bars: index_bars(bars, trading_calendar(bars), d.symbols)
    both = ("symbol", "dt")

    def averages(bars):
        return smoothing.macd(signals.bollinger_squeeze(ix(bars)))

    def oscillators(bars):
        return smoothing.rsi(signals.stochastic_k(ix(bars)), "adj_close", "rsi14")

    def research(bars):
        return features.research_panel(ix(bars)).drop("fwd_21")

    def panel(bars):
        f = features.features(ix(bars))
        return features.feature_panel(f, features.market_state(f), d.names)

    return {
        "averages": (averages, both), "oscillators": (oscillators, both), "rules": (lambda b: signals.rule_signals(ix(b)), both),
        "scores": (lambda b: signals.scores(ix(b)), both), "dollar_volume": (lambda b: with_adv(ix(b)), both), "research": (research, both),
        "panel": (panel, both), "regimes": (lambda b: features.market_regimes(ix(b)), ("dt",)),
    }


def _layer_sql(names: dict, cutoff: str) -> str:
    size = {"ALL": "count(*)", "STOCK": "count(CASE WHEN symbol<>'MKT' THEN 1 END)", "ONE": "count(CASE WHEN symbol='MKT' THEN 1 END)"}
    return " UNION ALL ".join(
        f"SELECT '{n}' AS layer, DATE '{cutoff}' AS cutoff, {size[k]} AS rows, CAST(0 AS BIGINT) AS differences FROM x_ix WHERE dt=DATE '{cutoff}'"
        for n, k in names.items()
    )


@query(
    "audit_layers",
    _layer_sql(LAYERS, CUTS[1]) + f""" UNION ALL SELECT 'planted leak', dt, count(*), count(later) FROM (
SELECT dt, lead(close) OVER (PARTITION BY symbol ORDER BY dt) AS later FROM x_bars) WHERE dt=DATE '{CUTS[1]}' GROUP BY dt""",
)
def audit_layers(d):
    """No value of any feature or score family changes when later bars are taken away; a planted leak is caught."""
    leak = lambda b: b.select("symbol", "dt", F.lead("close").over(sym_order(order="dt")).alias("tomorrow"))
    return audit.audit_layers(_layers(d) | {"planted leak": (leak, ("symbol", "dt"))}, d.bars, CUTS[1:2]).drop("columns")


@query(
    "audit_labels_absent",
    " UNION ALL ".join(
        f"SELECT DATE '{c}' AS cutoff, count(*) AS symbols, CAST(0 AS BIGINT) AS labelled FROM x_ix WHERE dt=DATE '{c}' HAVING count(*)>0" for c in CUTS
    ),
)
def audit_labels_absent(d):
    """On the last session of cut-off data no label exists yet."""
    build = lambda b: labels.labels(index_bars(b, trading_calendar(b), d.symbols))
    names = audit.forward_columns(d.labels)
    parts = []
    for c in CUTS:
        day = F.lit(c).cast("date")
        bad = audit.audit_labels_absent(build, d.bars, c, names).agg(F.count(F.lit(1)).alias("labelled")).withColumn("_j", F.lit(1))
        n = d.bars.filter(F.col("dt") == day).agg(F.count(F.lit(1)).alias("symbols")).filter("symbols > 0").withColumn("_j", F.lit(1))
        parts.append(n.join(bad, "_j").select(day.alias("cutoff"), "symbols", "labelled"))
    return reduce(lambda a, b: a.unionByName(b), parts)
