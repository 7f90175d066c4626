"""The validation table and the concurrent walk-forward against direct computations."""

import datetime as dt

import numpy as np
import pandas as pd

from tapeaudit.operators import folds, models
from tapeaudit.plans import studies

D = dt.date


def test_validation_table_uses_common_dates(spark):
    g = np.random.default_rng(3)
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    rows = [(s, d, float(g.normal(m, 0.01))) for s, m in (("base", 0.0), ("good", 0.02), ("same", 0.0)) for d in days]
    # dates that one strategy lacks, or has without a return, count for none
    rows = [(s, d, None if (s, d) == ("same", days[7]) else v) for s, d, v in rows if (s, d) != ("good", days[5])]
    out = {r.strategy: r for r in studies.validation_table(spark.createDataFrame(rows, "strategy string, dt date, ret double"), "base", 400, 5).collect()}
    wide = pd.DataFrame(rows, columns=["s", "d", "v"]).pivot(index="d", columns="s", values="v").dropna()
    assert len(wide) == 118 and set(out) == {"base", "good", "same"}
    for s, r in out.items():
        assert r.dates == 118 and abs(r["mean"] - wide[s].mean()) < 1e-12 and r.lo < r["mean"] < r.hi
        assert abs(r.annual - ((1 + wide[s].mean()) ** (252 / 5) - 1)) < 1e-9
    assert out["base"].excess is None and out["base"].p_bh is None
    good, same = out["good"], out["same"]
    assert abs(good.excess - (wide.good - wide.base).mean()) < 1e-12 and good.p_raw == 0.0 and good.excess_lo > 0
    assert same.p_bonferroni == min(1.0, 2 * same.p_raw) and same.excess_lo < same.excess < same.excess_hi
    assert good.p_bh == 0.0 and good.passes_bh == 1 and same.p_bh == max(good.p_bh, same.p_raw)


def test_walk_forward_fits_every_fold_on_its_own_rows(spark):
    g = np.random.default_rng(4)
    days = pd.bdate_range("2018-01-01", "2021-12-31").date
    pdf = pd.DataFrame([(s, d) for s in "abc" for d in days], columns=["symbol", "dt"])
    for f in models.FEATURES:
        pdf[f] = g.normal(size=len(pdf))
    pdf["above_200"] = (g.random(len(pdf)) < 0.5).astype(float)
    pdf["label_win_5d"] = (pdf.mom_21d + g.normal(0, 0.3, len(pdf)) > 0).astype(int)
    rows = spark.createDataFrame(pdf)
    split = folds.split_folds(rows, folds.build_folds(rows.select("dt"), train_years=2)).cache()
    p = models.walk_forward(rows, split, ("logistic", "momentum_rule"), at_once=3).toPandas()
    test = split.filter("part = 'test'").toPandas()
    assert sorted(p.fold_id.unique()) == sorted(test.fold_id.unique()) and len(p) == 2 * len(test)
    for (fold, name), part in p.groupby(["fold_id", "model_name"]):
        hit = ((part.y_prob >= 0.5) == (part.label_win_5d == 1)).mean()
        assert hit > 0.85 if name == "logistic" else hit > 0.6
    one = models.predict(models.fit("logistic", split.filter("fold_id = 1 and part = 'train'")), split.filter("fold_id = 1 and part = 'test'"), "logistic").toPandas()
    same = p[(p.fold_id == 1) & (p.model_name == "logistic")].merge(one, on=["symbol", "dt"])
    assert len(same) == len(one) and np.allclose(same.y_prob_x, same.y_prob_y, atol=1e-6)
    split.unpersist()
