"""Long frames from blocks, effective counts and the forward record against plain re-computation."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeaudit.functions.frames import trailing, trailing_mean
from tapeaudit.operators import inference, trials


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_trailing_equals_rolling(spark, n):
    rng = np.random.default_rng(n)
    rows = []
    for symbol, length in (("a", 1), ("b", n), ("c", n + 1), ("d", 3 * n + 2)):
        rows += [(symbol, i * 3, None if rng.random() < 0.2 else float(rng.integers(-50, 50))) for i in range(length)]
    df = spark.createDataFrame(rows, "symbol string, day_index int, x double")
    got = trailing(df, n, {"hi": ("max", "x"), "lo": ("min", "x"), "s": ("sum", "x"), "k": ("count", "x")}).toPandas()
    got = got.sort_values(["symbol", "day_index"]).reset_index(drop=True)
    roll = got.groupby("symbol")["x"].rolling(n, min_periods=1)
    for name, want in (("hi", roll.max()), ("lo", roll.min()), ("s", roll.sum())):
        assert np.allclose(got[name].astype(float), want.to_numpy(), equal_nan=True), name
    assert (got["k"].to_numpy() == got.groupby("symbol")["x"].rolling(n, min_periods=0).count().to_numpy()).all()
    assert list(got.columns) == ["symbol", "day_index", "x", "hi", "lo", "s", "k"]


def test_trailing_mean_waits_and_a_bad_value_stays_in_its_frames(spark):
    df = spark.createDataFrame([("a", i, float("nan") if i == 4 else float(i)) for i in range(20)], "symbol string, day_index int, x double")
    got = trailing_mean(df, 3, "x", "m", need=3).orderBy("day_index").toPandas()["m"]
    assert got[:2].isna().all() and got[2] == 1.0
    assert got[4:7].isna().all()
    assert list(got[7:]) == [float(i - 1) for i in range(7, 20)]
    assert trailing_mean(df.limit(0), 3, "x", "m").count() == 0


def test_trailing_keeps_one_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("symbol"), F.col("id").cast("int").alias("day_index"), F.rand(1).alias("x"))
    plan = trailing(df, 50, {"hi": ("max", "x"), "s": ("sum", "x")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def _days(k):
    return [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(k)]


def test_effective_books(spark):
    rng = np.random.default_rng(3)
    days = _days(90)
    a, b = rng.normal(size=90), rng.normal(size=90)
    books = {"a": a, "twin": 2 * a + 1, "b": b, "short": rng.normal(size=90)}
    rows = [(k, d, float(x)) for k, v in books.items() for i, (d, x) in enumerate(zip(days, v)) if k != "short" or i < 20]
    rows = [r for r in rows if not (r[0] == "b" and r[1] == days[5])]
    s = spark.createDataFrame(rows, "strategy string, dt date, ret double")
    sets = {"same": ["a", "twin"], "two": ["a", "b"], "three": ["a", "twin", "b", "short"], "one": ["b"], "none": ["absent"]}
    got = {r["set"]: r for r in inference.effective_books(s, sets).collect()}
    assert set(got) == {"same", "two", "three", "one"}
    keep = [i for i in range(90) if i != 5]
    for name, members in (("same", ["a", "twin"]), ("two", ["a", "b"]), ("three", ["a", "twin", "b"])):
        at = range(90) if name == "same" else keep
        rho = np.corrcoef([books[m][list(at)] for m in members])
        k = len(members)
        assert got[name]["nominal"] == k and got[name]["n_dates"] == len(list(at))
        assert got[name]["n_eff"] == pytest.approx(k * k / (rho**2).sum())
        assert got[name]["mean_corr"] == pytest.approx((rho.sum() - k) / (k * (k - 1)))
    assert got["one"]["nominal"] == 1 and got["one"]["n_eff"] is None and got["one"]["mean_corr"] is None


def test_breadth_curve_of_nested_sets(spark):
    rng = np.random.default_rng(5)
    names = [f"n{i:02d}" for i in range(23)]
    common = rng.normal(size=30)
    values = {n: 0.5 * common + rng.normal(size=30) for n in names}
    rows = [(n, d, "s" + n[-1], float(x)) for n, v in values.items() for d, x in zip(_days(30), v)]
    rows += [("part", d, "s1", 0.1) for d in _days(10)]
    p = spark.createDataFrame(rows, "symbol string, dt date, sector string, ret double")
    got = inference.breadth_curve(p, sizes=(3, 10, 100)).toPandas()
    assert sorted(set(got["n"])) == [3, 10, 23] and len(got) == 6
    every = got[(got["n"] == 23) & (got["kind"] == "raw")].iloc[0]
    rho = np.corrcoef([values[n] for n in names])
    assert every["n_eff"] == pytest.approx(23 * 23 / (rho**2).sum())
    by_name = p.groupBy("symbol").agg(F.count(F.lit(1)).alias("c")).filter("c = 30").select(
        "symbol", F.conv(F.substring(F.md5(F.concat(F.lit("pick-"), "symbol")), 1, 8), 16, 10).cast("bigint").alias("u")
    ).orderBy("u", "symbol").toPandas()["symbol"]
    for n in (3, 10):
        rho = np.corrcoef([values[s] for s in by_name[:n]])
        one = got[(got["n"] == n) & (got["kind"] == "raw")].iloc[0]
        assert one["sum_sq_corr"] == pytest.approx((rho**2).sum()) and one["n_dates"] == 30


def test_forward_record(spark):
    days = _days(40)
    rng = np.random.default_rng(9)
    res, pred = [], []
    for i, d in enumerate(days):
        stage = "holdout" if i < 35 else "live"
        for s in ("x", "y"):
            pred.append((stage, d, s))
            if i != 36:
                res.append((stage, d, s, 0.05 + 0.001 * float(rng.normal()), 1))
    pred += [("paper", days[0], "z")]
    results = spark.createDataFrame(res, "stage string, dt date, symbol string, ret_net double, win int")
    bench = spark.createDataFrame([(d, 0.01 if i != 3 else None) for i, d in enumerate(days)], "dt date, bench double")
    got = {r["stage"]: r for r in trials.ledger_record(results, bench, predictions=spark.createDataFrame(pred, "stage string, dt date, symbol string"), reps=300).collect()}
    r = pd.DataFrame(res, columns=["stage", "dt", "symbol", "ret", "win"])
    hold = r[r.stage == "holdout"].groupby("dt")["ret"].mean()
    h = got["holdout"]
    assert (h["trades"], h["dates"], h["paired_dates"], h["pending"]) == (70, 35, 34, 0)
    assert h["paired_excess"] == pytest.approx((hold.drop(days[3]) - 0.01).mean())
    assert h["lo"] < h["paired_excess"] < h["hi"] and h["p"] == 0.0
    live = got["live"]
    assert (live["trades"], live["dates"], live["pending"]) == (8, 4, 2)
    assert live["p"] is None and live["paired_excess"] is not None
    assert got["paper"]["pending"] == 1 and got["paper"]["trades"] == 0 and got["paper"]["mean_net"] is None
