"""Walk-forward folds with a purge gap, and the checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build_folds(
    dates: DataFrame, train_years: int = 4, test_years: int = 1, step_years: int = 1, purge: int = 5, embargo: int = 0
) -> DataFrame:
    """Rolling folds over distinct session dates (dt).

    The first training year is the first with more than 200 sessions.  Training
    ends `purge` + 1 sessions (plus `embargo`, off by default) before the test year.
    All tables here have one row per session or per year.
    """
    d = dates.select("dt").distinct()
    pos = d.select("dt", (F.row_number().over(Window.orderBy("dt")) - 1).alias("pos"))
    years = d.groupBy(F.year("dt").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    span = years.agg(
        F.coalesce(F.min(F.when(F.col("n") > 200, F.col("y"))), F.min("y")).alias("lo"), F.max("y").alias("hi")
    )
    last_start = F.col("hi") - train_years - test_years + 1
    starts = span.filter(F.col("lo") <= last_start).select(
        F.posexplode(F.sequence("lo", last_start, F.lit(step_years))).alias("i", "y0"), "hi"
    )
    # sessions before each candidate test year
    all_years = span.select(F.explode(F.sequence("lo", F.col("hi") + 1)).alias("y"))
    seen = years.unionByName(all_years.withColumn("n", F.lit(0).cast("bigint"))).groupBy("y").agg(F.sum("n").alias("n"))
    before = seen.select(
        F.col("y").alias("test_year"),
        (F.sum("n").over(Window.orderBy("y").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start_pos"),
    )
    f = starts.withColumn("test_year", F.col("y0") + train_years).join(before, "test_year")
    f = f.withColumn("pos", F.greatest(F.lit(0), F.col("start_pos") - purge - embargo - 1).cast("int"))
    f = f.join(pos, "pos")
    f = f.select(
        (F.col("i") + 1).alias("fold_id"),
        F.make_date("y0", F.lit(1), F.lit(1)).alias("train_start"),
        F.col("dt").alias("train_end"),
        F.make_date("test_year", F.lit(1), F.lit(1)).alias("test_start"),
        F.make_date(F.col("test_year") + test_years - 1, F.lit(12), F.lit(31)).alias("test_end"),
        F.lit(purge).alias("purge_days"),
        F.lit(embargo).alias("embargo_days"),
    )
    return f.filter("train_end > train_start")


def split_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Every row once per fold and role it belongs to: adds fold_id and part (train, test).

    The join is on the calendar year, so it is an equi-join with a small table.
    """
    part = lambda name, lo, hi: folds.select(
        "fold_id",
        F.lit(name).alias("part"),
        F.col(lo).alias("_lo"),
        F.col(hi).alias("_hi"),
        F.explode(F.sequence(F.year(lo), F.year(hi))).alias("_y"),
    )
    parts = part("train", "train_start", "train_end").unionByName(part("test", "test_start", "test_end"))
    d = rows.withColumn("_y", F.year("dt")).join(parts, "_y")
    return d.filter(F.col("dt").between(F.col("_lo"), F.col("_hi"))).drop("_y", "_lo", "_hi")


def fold_violations(rows: DataFrame, folds: DataFrame, horizon: int = 5) -> DataFrame:
    """One row per problem: empty split, label reaching into the test window, overlap."""
    pos = rows.select("dt").distinct().select(
        "dt", (F.row_number().over(Window.orderBy("dt")) - 1).alias("pos")
    )
    n = pos.agg(F.max("pos").alias("_last")).withColumn("_j", F.lit(1))
    s = split_folds(rows.select("dt"), folds)
    ends = s.groupBy("fold_id").agg(
        F.max(F.when(F.col("part") == "train", F.col("dt"))).alias("last_train"),
        F.min(F.when(F.col("part") == "test", F.col("dt"))).alias("first_test"),
    )
    f = folds.select("fold_id", "test_start").join(ends, "fold_id", "left")
    f = f.join(pos.withColumnRenamed("dt", "last_train"), "last_train", "left").withColumn("_j", F.lit(1)).join(n, "_j")
    f = f.withColumn("_res", F.least(F.col("pos") + horizon, F.col("_last")))
    f = f.join(pos.select(F.col("pos").alias("_res"), F.col("dt").alias("resolves")), "_res", "left")
    problem = F.array(
        F.when(F.col("last_train").isNull() | F.col("first_test").isNull(), "empty split"),
        F.when(F.col("resolves") >= F.col("test_start"), "label reaches the test window"),
        F.when(F.col("last_train") >= F.col("first_test"), "train and test overlap"),
    )
    return f.select("fold_id", "last_train", "resolves", "first_test", F.explode(F.array_compact(problem)).alias("problem"))
