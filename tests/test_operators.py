"""Operators on small hand-made tables, against pandas, numpy or literal values."""

from __future__ import annotations

import datetime as dt
import gzip

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeaudit.functions import norm_cdf, norm_ppf
from tapeaudit.operators import (
    asof, audit, books, calendar, entities, features, fundamentals, inference, perf, quality, ranking, signals,
    smoothing, trades, trials, xsection,
)
from tapeaudit.operators.folds import build_folds, fold_violations
from tapeaudit.sources import readers

D = dt.date


def panel(n_sym=3, n=500, seed=1):
    g = np.random.default_rng(seed)
    rows = []
    for s in range(n_sym):
        px = 100 * np.exp(np.cumsum(g.normal(0, 0.02, n)))
        for i in range(n):
            rows.append((f"S{s}", D(2020, 1, 1) + dt.timedelta(days=i), i, float(px[i]), int(g.integers(1, 100))))
    return pd.DataFrame(rows, columns=["symbol", "dt", "day_index", "adj_close", "volume"])


def test_split_ranks_equal_plain_ranks_with_heavy_ties(spark):
    g = np.random.default_rng(0)
    v = np.where(g.random(3000) < 0.4, 0.5, g.normal(size=3000))  # one value holds 40 % of the rows
    pdf = pd.DataFrame({"g": g.integers(0, 2, 3000), "v": v, "id": [f"x{i:05d}" for i in range(3000)]})
    pdf.loc[::97, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    for fn, extra in ((ranking.percent_rank, ("r",)), (ranking.average_rank, ("r",)), (ranking.row_numbers, ("id", "r"))):
        a = fn(df, ["g"], "v", *extra, width=10).select("id", "r").toPandas().set_index("id").r.sort_index()
        b = fn(df, ["g"], "v", *extra, width=None).select("id", "r").toPandas().set_index("id").r.sort_index()
        assert np.allclose(a, b), fn.__name__


def test_asof_backward_equals_merge_asof(spark):
    g = np.random.default_rng(2)
    p = panel(2, 60)[["symbol", "dt"]]
    ev = pd.DataFrame(
        {"symbol": g.choice(["S0", "S1"], 40), "known": [D(2019, 12, 20) + dt.timedelta(days=int(x)) for x in g.integers(0, 80, 40)]}
    )
    ev["val"] = range(40)
    ev = ev.drop_duplicates(["symbol", "known"], keep="last")
    got = asof.asof_backward(spark.createDataFrame(p), spark.createDataFrame(ev), "known", ["val"]).toPandas()
    a, b = p.assign(k=pd.to_datetime(p.dt)), ev.assign(k=pd.to_datetime(ev.known))
    want = pd.merge_asof(a.sort_values("k"), b.sort_values("k")[["symbol", "k", "val"]], on="k", by="symbol")
    m = got.merge(want, on=["symbol", "dt"], suffixes=("", "_w"))
    assert len(m) == len(p) and np.allclose(m.val, m.val_w, equal_nan=True)


@pytest.mark.parametrize("alpha,n", [(2 / 27, 26), (1 / 14, 14), (2 / 10, 9)])
def test_ema_equals_pandas(spark, alpha, n):
    df = spark.createDataFrame(panel(2, 1500))
    a = smoothing.ema(df, "adj_close", "e", alpha, n).toPandas()
    b = smoothing.ema_grouped(df, "adj_close", "e", alpha, n).toPandas()
    m = a.merge(b, on=["symbol", "dt"])
    assert np.allclose(m.e_x, m.e_y, rtol=1e-11, equal_nan=True)


def test_rsi_equals_pandas(spark):
    p = panel(1, 300)
    got = smoothing.rsi(spark.createDataFrame(p), "adj_close", "r").toPandas().sort_values("day_index").r
    d = p.adj_close.diff()
    up = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    dn = (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    assert np.allclose(got.to_numpy(), (100 - 100 / (1 + up / dn)).to_numpy(), equal_nan=True)


@pytest.mark.parametrize("width", [None, 1000])
def test_residual_equals_least_squares(spark, width):
    g = np.random.default_rng(3)
    n = 160
    pdf = pd.DataFrame({"dt": np.repeat([1, 2], n // 2), "sec": g.choice(list("ab"), n), "symbol": range(n)})
    for c in ("f1", "f2", "f3"):
        pdf[c] = g.normal(size=n)
    pdf.loc[pdf.dt == 2, "f3"] = np.nan  # absent on one date: left out there
    pdf["y"] = pdf.f1 * 2 - pdf.f2 + g.normal(size=n)
    df = spark.createDataFrame(pdf).withColumn("f3", F.nanvl("f3", F.lit(None).cast("double")))
    got = xsection.residualize(df, "y", ["f1", "f2", "f3"], need_share=0.5, width=width).toPandas().set_index("symbol").resid
    for day, cols in ((1, ["f1", "f2", "f3"]), (2, ["f1", "f2"])):
        s = pdf[pdf.dt == day]
        x = np.column_stack([np.ones(len(s)), s[cols]])
        b, *_ = np.linalg.lstsq(x, s.y, rcond=None)
        assert np.allclose(got[s.symbol].to_numpy(), (s.y - x @ b).to_numpy(), atol=1e-9)
    full = xsection.residualize(df.filter("dt = 1"), "y", ["f1", "f2"], sector="sec", width=width).toPandas().set_index("symbol").resid
    s = pdf[pdf.dt == 1]
    x = np.column_stack([np.ones(len(s)), s[["f1", "f2"]], (s.sec == "b").astype(float)])
    b, *_ = np.linalg.lstsq(x, s.y, rcond=None)
    assert np.allclose(full[s.symbol].to_numpy(), (s.y - x @ b).to_numpy(), atol=1e-9)


def test_planted_factor_copy_loses_its_variance(spark):
    g = np.random.default_rng(4)
    pdf = pd.DataFrame({"signal": "s", "dt": 1, "symbol": range(200), "f": g.normal(size=200)})
    pdf["score"] = 3 * pdf.f + 0.01 * g.normal(size=200)
    d = xsection.residualize(spark.createDataFrame(pdf), "score", ["f"], ["signal", "dt"])
    assert xsection.resid_r2(d, "score").first().r2_removed > 0.99


@pytest.mark.parametrize("n,q", [(10, 5), (11, 5), (23, 4), (50, 10), (7, 2)])
def test_bucket_cuts(spark, n, q):
    df = spark.createDataFrame([(1, f"s{i:03d}", float(i)) for i in range(n)], "g int, symbol string, score double")
    got = [r.bucket for r in xsection.with_bucket(df, ["g"], "score", q, width=100).orderBy("score").collect()]
    want = [max(-(-((r - 1) * q) // (n - 1)), 1) - 1 for r in range(1, n + 1)]
    assert got == want


def test_participation_ratio_equals_eigenvalues(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(60, 12)) + g.normal(size=(60, 1))
    pdf = pd.DataFrame([(f"s{j}", i, x[i, j]) for i in range(60) for j in range(12)], columns=["symbol", "dt", "ret"])
    got = inference.participation_ratio(spark.createDataFrame(pdf)).first()
    lam = np.linalg.eigvalsh(np.corrcoef(x, rowvar=False))
    assert got.n_names == 12 and abs(got.n_eff - lam.sum() ** 2 / (lam**2).sum()) < 1e-8


def test_normal_functions(spark):
    r = spark.range(1).select(
        norm_cdf(F.lit(1.959963984540054)).alias("a"), norm_ppf(F.lit(0.975)).alias("b"), norm_cdf(F.lit(-8.0)).alias("c")
    ).first()
    assert abs(r.a - 0.975) < 1e-14 and abs(r.b - 1.959963984540054) < 1e-8 and abs(r.c - 6.22096057427e-16) < 1e-22


def test_search_controls(spark):
    df = spark.createDataFrame([(1, 348), (10, 348), (100, 348), (202, 348)], "k int, n int")
    bars = [round(r.b, 3) for r in df.select(inference.expected_max_sharpe(F.col("k"), F.col("n")).alias("b"), "k").orderBy("k").collect()]
    assert bars == [0.0, 0.599, 0.963, 1.054]
    d = spark.createDataFrame([(0.8, 50, 200), (0.8, 50, 800), (0.8, 500, 800), (3.0, 50, 800)], "s double, k int, n int")
    v = [r.v for r in d.select(inference.deflated_sharpe(F.col("s"), F.col("k"), F.col("n")).alias("v")).collect()]
    assert v[1] > v[0] and v[2] < v[1] and v[3] > 0.95


def ledger(spark):
    e = spark.createDataFrame([("a", i, f"entry {i}") for i in range(6)], "chain string, seq bigint, payload string")
    return trials.chain_append(e, ["chain"], "seq")


@pytest.mark.parametrize(
    "change,first_bad",
    [
        (lambda d: d, None),
        (lambda d: d.withColumn("payload", F.when(F.col("seq") == 3, "forged").otherwise(F.col("payload"))), 3),
        (lambda d: d.withColumn("payload", F.when(F.col("seq") == 0, "forged").otherwise(F.col("payload"))), 0),
        (lambda d: d.filter("seq <> 2"), 3),
        (lambda d: d.withColumn("seq", F.when(F.col("seq") == 4, 5).when(F.col("seq") == 5, 4).otherwise(F.col("seq"))), 4),
    ],
)
def test_ledger_tamper(spark, change, first_bad):
    r = trials.chain_verify(change(ledger(spark)), ["chain"]).first()
    assert r.first_bad == first_bad and r.ok == (1 if first_bad is None else 0)


def test_lockbox_blocks_until_opened(spark):
    reg = spark.createDataFrame([(1, "seal", D(2020, 1, 10))], "seq int, kind string, seal_from date")
    rows = spark.createDataFrame([(D(2020, 1, 9),), (D(2020, 1, 10),)], "dt date")
    state = trials.lockbox_state(reg)
    assert trials.lockbox_filter(rows, state).count() == 1
    assert trials.lockbox_violation(rows, state).count() == 1
    with pytest.raises(Exception, match="sealed"):
        trials.lockbox_guard(rows, state).collect()
    opened = trials.lockbox_state(reg.unionByName(spark.createDataFrame([(2, "open", None)], reg.schema)))
    assert trials.lockbox_guard(rows, opened).count() == 2


def test_release_before_and_after_the_close(spark):
    cal = calendar.trading_calendar(spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 1, 8),), (D(2024, 1, 9),)], "dt date"))
    ev = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 5, 15, 59)), ("b", dt.datetime(2024, 1, 5, 16, 0)), ("c", dt.datetime(2024, 1, 6, 9, 0)), ("d", dt.datetime(2024, 1, 9, 17, 0))],
        "symbol string, announced_at timestamp_ntz",
    )
    got = {r.symbol: r.tradeable_from for r in calendar.resolve_tradeable_from(ev, cal).collect()}
    assert got == {"a": D(2024, 1, 5), "b": D(2024, 1, 8), "c": D(2024, 1, 8), "d": None}


def test_partial_windows_and_first_bar(spark):
    p = panel(1, 30)
    for c in ("open", "high", "low", "close"):
        p[c] = p.adj_close
    ix = spark.createDataFrame(p.assign(sector="x", kind="stock"))
    f = features.features(ix).orderBy("day_index").toPandas()
    assert f.ret_1d.isna()[0] and f.sma_20.notna().all()
    assert f.atr_14.isna()[:14].all() and f.atr_14.notna()[14:].all()
    assert f.prior_high_20.isna()[0]


def test_stop_is_tested_before_the_horizon(spark):
    rows = [("s", D(2024, 1, 1) + dt.timedelta(days=i), i, 10.0, 10.5, lo, 10.0) for i, lo in enumerate([9.9, 9.9, 9.9, 8.0, 9.9, 9.9, 9.9])]
    ix = spark.createDataFrame(rows, "symbol string, dt date, day_index int, open double, high double, low double, close double")
    sig = spark.createDataFrame([("s", D(2024, 1, 1), 0, 10.0, 0.5, 1, 1.5)], "symbol string, dt date, day_index int, next_open double, atr_14 double, top_n int, stop_atr double")
    e = trades.trade_entries(sig)
    hit = trades.trade_exits(e, trades.with_paths(ix, 3), 3).first()
    assert hit.exit_reason == "stop" and hit.sessions_held == 3 and hit.exit_raw == hit.stop
    far = trades.trade_exits(trades.trade_entries(sig.withColumn("stop_atr", F.lit(9.0))), trades.with_paths(ix, 3), 3).first()
    assert far.exit_reason == "horizon" and far.exit_raw == 10.0
    t = trades.trade_costs(trades.trade_exits(e, trades.with_paths(ix, 3), 3))
    assert trades.cost_identity(t).count() == 0
    late = trades.trade_exits(trades.trade_entries(sig.withColumn("stop_atr", F.lit(9.0))), trades.with_paths(ix.filter("day_index < 3"), 3), 3)
    assert late.count() == 0


def test_folds_keep_the_purge_gap(spark):
    days = [(D(2010, 1, 1) + dt.timedelta(days=i),) for i in range(365 * 8)]
    cal = spark.createDataFrame(days, "dt date")
    f = build_folds(cal)
    assert f.count() == 4 and f.first().train_end == D(2013, 12, 26)
    assert fold_violations(cal, f).count() == 0
    assert fold_violations(cal, build_folds(cal, purge=0)).count() == 4


def test_entity_windows(spark):
    rules = entities.Rules(
        names=(("SIKORSKY", "A", "2014-01-01", "2015-11-05"), ("SIKORSKY", "B", "2015-11-06", "2099-12-31"), ("DELO", None, "2014-01-01", "2099-12-31")),
        unpriceable=(("UNIVERSITY", "not listed"),),
    )
    df = spark.createDataFrame(
        [("Sikorsky", D(2015, 1, 1)), ("Sikorsky", D(2020, 1, 1)), ("Delo", D(2020, 1, 1)), ("Sikorsky University", D(2020, 1, 1)), ("x", D(2020, 1, 1))],
        "recipient string, action_date date",
    )
    assert [r.ticker for r in entities.resolve(df, rules).collect()] == ["A", "B", None, None, None]
    strict = entities.resolve(df, rules, first_fragment_decides=True).collect()
    assert [r.ticker for r in strict] == ["A", None, None, None, None] and "outside" in strict[1].why


def test_quarters_sum_and_restatement(spark):
    q = lambda i, end, filed, val: (i, "s", "NetIncomeLoss", end - dt.timedelta(days=90), end, filed, float(val), "10-Q")
    ends = [D(2020, 3, 31), D(2020, 6, 30), D(2020, 9, 30), D(2020, 12, 31), D(2021, 3, 31)]
    rows = [q(i, e, e + dt.timedelta(days=30), 10 * (i + 1)) for i, e in enumerate(ends)]
    rows.append(q(9, ends[3], D(2021, 6, 1), 100))  # restates the fourth quarter
    df = spark.createDataFrame(rows, "fact_id int, symbol string, concept string, period_start date, period_end date, filed date, val double, form string")
    got = {r.filed: r.value for r in fundamentals.known_values(df).collect()}
    assert got == {D(2021, 1, 30): 100.0, D(2021, 4, 30): 140.0, D(2021, 6, 1): 200.0}


def test_bootstrap_and_adjustment(spark):
    s = spark.createDataFrame([("a", D(2020, 1, 1) + dt.timedelta(days=i), 0.01 * ((i * 7) % 5 - 1)) for i in range(200)], "strategy string, dt date, ret double")
    c = inference.boot_mean_ci(s, 200, 10).first()
    assert c.lo < c.mean < c.hi and abs(c.mean - 0.01) < 1e-9 and c.p < 0.05
    draws = inference.stationary_draws(spark.createDataFrame([(500,)], "n_obs int"), ["n_obs"], 20, 10).toPandas()
    jump = (draws.sort_values(["rep", "t"]).groupby("rep").pos.diff().dropna() % 500 != 1).mean()
    assert 0.07 < jump < 0.13
    p = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.9)], "strategy string, p_raw double")
    adj = {r.strategy: round(r.p_bh, 6) for r in inference.p_adjust(p).collect()}
    assert adj == {"a": 0.04, "b": 0.04, "c": 0.04, "d": 0.9}


def test_readers(spark, tmp_path):
    f = tmp_path / "bars.csv.gz"
    with gzip.open(f, "wt") as fh:
        fh.write("symbol,dt,open,high,low,close,adj_close,volume\na,2020-01-02,1,2,1,2,2,10\n")
    assert readers.read_bars_csv(spark, str(f), 2).first().volume == 10
    u = tmp_path / "u.csv"
    u.write_text("symbol,name,sector,kind,inclusion_reason\na,A,x,stock,r\na,B,x,stock,r\n")
    with pytest.raises(Exception, match="duplicate key"):
        readers.read_universe_csv(spark, str(u)).collect()
    for name, text in (
        ("s", "ACCESSION_NUMBER\tFILING_DATE\tDOCUMENT_TYPE\tISSUERTRADINGSYMBOL\n1\t05-JAN-2020\t4\tbrk.b\n2\t05-JAN-2020\t5\tx\n"),
        ("t", "ACCESSION_NUMBER\tTRANS_DATE\tTRANS_CODE\tTRANS_SHARES\tTRANS_PRICEPERSHARE\n1\t03-JAN-2020\tP\t5\tbad\n2\t03-JAN-2020\tP\t5\t1\n"),
        ("o", "ACCESSION_NUMBER\tRPTOWNERNAME\tRPTOWNER_RELATIONSHIP\n1\tzed\tDirector\n1\tann\tOfficer\n"),
    ):
        (tmp_path / name).write_text(text)
    r = readers.read_filings_tsv(spark, *[str(tmp_path / n) for n in "sto"]).collect()
    assert len(r) == 1 and r[0].symbol == "BRK-B" and r[0].trans_date == D(2020, 1, 3) and r[0].price is None and r[0].owner == "ann"
    b = spark.createDataFrame([("a", D(2020, 1, 2), 5.0)], "symbol string, dt date, adv double")
    path = str(tmp_path / "panel")
    b.write.parquet(path)
    assert readers.read_panel(spark, path, ["symbol"], 6.0).count() == 0
    readers.write_bars(b, str(tmp_path / "bars"))
    readers.write_report(b, str(tmp_path / "report"))


def test_rule_registry(spark):
    p = panel(1, 40)
    for c in ("open", "high", "low", "close"):
        p[c] = p.adj_close
    ix = spark.createDataFrame(p)
    signals.register_rule("cheap", F.col("close") < 100)
    try:
        assert "cheap" in signals.rule_signals(ix).columns
    finally:
        signals.EXTRA_RULES.clear()
    signals.register_grouped("top", lambda pdf: pdf.nlargest(1, "adj_close")[["symbol", "adj_close"]], "symbol string, adj_close double")
    assert signals.run_grouped(ix, "top").count() == 1
    assert audit.forward_columns(ix.withColumn("fwd_x", F.lit(1))) == ["fwd_x"]


def test_upsert_is_idempotent_and_unit_gross(spark):
    a = spark.createDataFrame([("s", 1, 1.0)], "k string, v int, x double")
    b = spark.createDataFrame([("s", 2, 2.0), ("t", 2, 3.0)], "k string, v int, x double")
    once = quality.upsert_latest(a, b, ["k"], "v")
    assert sorted(quality.upsert_latest(once, b, ["k"], "v").collect()) == sorted(once.collect())
    g = np.random.default_rng(6)
    pdf = pd.DataFrame({"dt": 1, "sector": g.choice(list("ab"), 60), "symbol": [f"s{i}" for i in range(60)], "z": g.normal(size=60), "vol63": 1.0})
    for m in books.METHODS:
        for width in (None, 100):
            w = books.weights(spark.createDataFrame(pdf), "z", m, width=width).toPandas().w
            assert abs(w.abs().sum() - 1) < 1e-9
    s = spark.createDataFrame([("x", D(2020, 1, 1) + dt.timedelta(days=i), 0.01 * (i % 3)) for i in range(40)], "strategy string, dt date, ret double")
    assert perf.perf_stats(s, 5).first().n == 8
