"""Steps whose tasks and shuffles must not grow with the tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from tapeaudit.catalog import xs
from tapeaudit.catalog.base import Data
from tapeaudit.functions import lineage
from tapeaudit.operators import books, ranking, xsection

SMOKE = "/root/testdata/sf0.001"
DAY = datetime.date(2024, 1, 5)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(lineage, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(ranking, "ROWS_PER_TASK", 100)


def test_wide_windows_get_tasks_by_rows(spark, small_tasks):
    d = Data(spark, SMOKE)
    wanted = d.wide_rows // 100
    assert wanted > 20  # the session has 4 shuffle partitions
    assert d.wix.rdd.getNumPartitions() >= wanted
    z = xs.zscored(d)
    assert z.rdd.getNumPartitions() >= wanted
    assert z.groupBy(F.spark_partition_id()).count().agg(F.max("count")).head()[0] < 400
    # dates, the market and names are looked up; bars are dealt once by symbol and once by date and sector
    assert plan_of(xs.wide(d)).count("Exchange hashpartitioning") == 1 and plan_of(xs.zscored(d)).count("Exchange hashpartitioning") == 2


def test_pieces_grow_in_number_not_in_size(spark, small_tasks):
    rows = [("ab"[i % 2], float(i * 37 % 1000 // 3), f"n{i:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "grp string, v double, name string")
    pieces = ranking.in_pieces(df, ["grp", "v", "name"]).groupBy("_piece").count().collect()
    assert len(pieces) > 20 and max(r["count"] for r in pieces) < 300
    numbered = ranking.row_numbers(df, ["grp"], "v", "name", "k", size="n")
    assert "Window" not in plan_of(numbered) and "SortMergeJoin" not in plan_of(numbered)
    got = {r.name: (r.k, r.n) for r in numbered.collect()}
    for g in "ab":
        for i, r in enumerate(sorted(r for r in rows if r[0] == g)):
            assert got[r[2]] == (i + 1, 1500)


@pytest.mark.parametrize("sector", [None, "sec"])
def test_residuals_do_not_shuffle_rows(spark, sector):
    rows = [(DAY, f"s{i}", "xy"[i % 2], float(i % 7), float(i * i % 11), float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "dt date, symbol string, sec string, y double, a double, b double")
    r = xsection.residualize(df, "y", ["a", "b"], sector=sector, width=100, need_share=0.5)
    assert not any(x in plan_of(r) for x in ("Exchange hashpartitioning", "Window", "SortMergeJoin"))
    got = r.agg(F.sum("resid"), F.sum(F.col("resid") * F.col("a")), F.sum(F.col("resid") * F.col("b"))).head()
    assert list(got) == pytest.approx([0, 0, 0], abs=1e-9)


def test_book_from_sector_weights_is_the_weighted_book(spark):
    other = DAY + datetime.timedelta(days=7)
    rows = [(DAY, f"s{i}", "xyz"[i % 3], float(i % 7), 0.01 * i, 5.0 + i, 0.2) for i in range(40)]
    rows += [(other, f"s{i}", "x", 1.0, 0.01 * i, 5.0, 0.2) for i in range(3)]  # nothing has weight
    df = spark.createDataFrame(rows, "dt date, symbol string, sector string, s double, fwd double, half_bps double, vol63 double")
    for method in ("quintile", "signal", "risk"):
        want = books.book_weighted(books.weights(df, "s", method, width=100), "fwd").orderBy("dt").collect()
        got = books.book_by_sector_weights(books.sector_weights(df, "s", method, width=100), "fwd").orderBy("dt").collect()
        assert [list(r)[1:] for r in got] == [pytest.approx(list(r)[1:], abs=1e-12) for r in want]
