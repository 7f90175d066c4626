"""Ranks from ordered pieces, however the values lie."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeaudit.operators import inference, ranking


def rows_of(kind, n=3000):
    rng = random.Random(8)
    value = {"close": lambda: 100 + rng.random() / 2, "tied": lambda: 1.0, "mixed": lambda: rng.choice([None, 0.0, -1.5, 7.0, rng.gauss(0, 1e6)])}[kind]
    return [("g" if rng.random() < 0.8 else rng.choice("ab"), value(), f"Brand#{i:05d}") for i in range(n)]


@pytest.mark.parametrize("kind", ["close", "tied", "mixed"])
def test_row_numbers_and_counts_without_a_bound(spark, kind):
    rows = rows_of(kind)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 12)
        df = spark.createDataFrame(rows, "grp string, v double, name string").repartition(7)
        got = {r.name: (r.k, r.n) for r in ranking.row_numbers(df, ["grp"], "v", "name", "k", size="n").collect()}
        counts = {r.name: (r.less, r.ties, r.n) for r in ranking.with_counts(df, ["grp"], "v").collect()}
        pieces = ranking.in_pieces(df, ["grp", "v", "name"]).groupBy("_piece").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # no piece holds much more than its share, whether values are close or all equal
    assert len(pieces) > 4 and max(r["count"] for r in pieces) < 3 * len(rows) / 12
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        values = pd.Series([float("-inf") if r[1] is None else r[1] for r in mine])
        less, ties = values.rank(method="min") - 1, values.map(values.value_counts())
        for i, r in enumerate(mine):
            assert got[r[2]] == (i + 1, len(mine))
            assert counts[r[2]] == (less[i], ties[i], len(mine))


def test_step_up_minimum_over_pieces(spark):
    rng = random.Random(1)
    p = [round(rng.random() ** 3, 3) for _ in range(400)] + [None]
    df = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(p)], "strategy string, p_raw double")
    got = {r.strategy: r.p_bh for r in inference.p_adjust(df).collect()}
    order = sorted((x, i) for i, x in enumerate(p) if x is not None)
    low, want = 1.0, {}
    for k in range(len(order), 0, -1):
        x, i = order[k - 1]
        low = min(low, x * len(order) / k)
        want[f"s{i}"] = low
    assert got == pytest.approx(want)
