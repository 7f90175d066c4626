"""Block resamples against resamples draw by draw."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeaudit.functions import below, bound, uniform
from tapeaudit.operators import inference


@pytest.fixture(scope="module")
def series(spark):
    g = np.random.default_rng(2)
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x)) for s, n in (("a", 83), ("b", 83), ("c", 31), ("one", 1)) for i, x in enumerate(g.normal(size=n))]
    return spark.createDataFrame([*rows, ("a", dt.date(2021, 1, 1), None)], "strategy string, dt date, ret double")


@pytest.mark.parametrize("limit", [inference.SERIES_BYTES, 0])
def test_block_sums_are_the_means_of_the_draws(spark, series, monkeypatch, limit):
    monkeypatch.setattr(inference, "SERIES_BYTES", limit)
    got = {(r.strategy, r.rep): r.boot for r in inference.boot_means(series, 70, 4).collect()}
    s = inference.indexed(series.filter("ret is not null"))
    draws = inference.stationary_draws(s.select("strategy", "n_obs").distinct(), ["strategy"], 70, 4)
    want = draws.join(s, ["strategy", "pos"]).groupBy("strategy", "rep").agg(F.avg("ret").alias("boot")).collect()
    assert len(got) == len(want) == 4 * 70
    for r in want:
        assert got[r.strategy, r.rep] == pytest.approx(r.boot, abs=1e-12)


def test_thresholds_on_the_digest_are_those_on_the_number(spark):
    d = spark.range(4000).select("id", uniform("id").alias("u"))
    for p in (0.5, 0.1, 1 / 42, 1 / 3, 0.0):
        assert d.filter(below(bound(F.lit(p)), "id") != (F.col("u") < p)).count() == 0
