"""Statistics of return series.  A series has one row per date, so its windows are
bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TRADING_DAYS
from ..functions import sym_order


def nonoverlap_flag(h: int, by, order: str = "dt") -> Column:
    """True on every h-th row of a date-ordered series, starting with the first."""
    w = Window.partitionBy(*by).orderBy(order)
    return (F.row_number().over(w) - 1) % h == 0


def nonoverlap(series: DataFrame, h: int, by=("strategy",), order: str = "dt") -> DataFrame:
    return series.withColumn("_k", nonoverlap_flag(h, by, order)).filter("_k").drop("_k")


def _sharpe_cols(r: Column, h: int) -> list[Column]:
    n, m, s = F.count(r), F.avg(r), F.stddev_samp(r)
    ok = (n >= 3) & (s > 0)
    y = (TRADING_DAYS / h) ** 0.5
    return [
        n.alias("n"),
        F.when(ok, s * y).alias("vol"),
        F.when(ok, m / s * y).alias("sharpe"),
        F.when(ok, m / (s / F.sqrt(n))).alias("t"),
    ]


def perf_stats(
    series: DataFrame, h: int, by=("strategy",), ret: str = "ret", order: str = "dt", min_dates: int = 0
) -> DataFrame:
    """Annual return over all dates; volatility, Sharpe, t and drawdown over every h-th."""
    by = list(by)
    s = series.filter(F.col(ret).isNotNull()).withColumn("_k", nonoverlap_flag(h, by, order))
    s = s.withColumn("_r", F.when(F.col("_k"), F.col(ret)))
    run = sym_order(by, order).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_eq", F.product(F.coalesce(1 + F.col("_r"), F.lit(1.0))).over(run))
    s = s.withColumn("_eq", F.when(F.col("_k"), F.col("_eq"))).withColumn("_pk", F.max("_eq").over(run))
    g = s.groupBy(*by).agg(
        F.count(F.lit(1)).alias("dates"),
        (F.avg(ret) * (TRADING_DAYS / h)).alias("ret_ann"),
        *_sharpe_cols(F.col("_r"), h),
        F.max(F.when(F.col("_k"), F.try_divide(F.col("_pk") - F.col("_eq"), F.col("_pk")))).alias("max_dd"),
    )
    return g.filter(F.col("dates") >= min_dates) if min_dates else g


def ic_summary(ic: DataFrame, h: int, by=("signal",), order: str = "dt") -> DataFrame:
    """Mean, deviation, annualised ratio and hit share of per-date IC; t on every h-th date."""
    by = list(by)
    s = ic.filter("ic is not null").withColumn("_k", nonoverlap_flag(h, by, order))
    r = F.when(F.col("_k"), F.col("ic"))
    n, sd, sk = F.count(r), F.stddev_samp("ic"), F.stddev_samp(r)
    return s.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_dates"),
        F.avg("ic").alias("ic_mean"),
        sd.alias("ic_std"),
        F.when(sd > 0, F.avg("ic") / sd * (TRADING_DAYS / h) ** 0.5).alias("ic_ir"),
        F.avg((F.col("ic") > 0).cast("int")).alias("ic_positive"),
        n.alias("n_nonoverlap"),
        F.when((n > 2) & (sk > 0), F.avg(r) / (sk / F.sqrt(n))).alias("ic_t"),
    )


def yearly_sharpe(series: DataFrame, h: int, by=("strategy",), ret: str = "ret") -> DataFrame:
    """Sharpe of each calendar year; every year samples from its own first date."""
    by = [*by, "year"]
    s = series.filter(F.col(ret).isNotNull()).withColumn("year", F.year("dt"))
    s = s.withColumn("_r", F.when(nonoverlap_flag(h, by), F.col(ret)))
    return s.groupBy(*by).agg(*_sharpe_cols(F.col("_r"), h)).drop("vol", "t")


REGIMES = {
    "all": "true",
    "above_200d": "above = 1",
    "below_200d": "above = 0",
    "high_vol": "vol_hi = 1",
    "low_vol": "vol_lo = 1",
}


def by_regime(series: DataFrame, flags: DataFrame, h: int, by=("strategy",)) -> DataFrame:
    """Statistics on the dates of each regime; the sampling starts after the mask."""
    d = series.join(flags, "dt", "left").fillna({"above": 0, "vol_hi": 0, "vol_lo": 0})
    hit = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in REGIMES.items()]))
    d = d.select(*by, "dt", "ret", F.explode(hit).alias("regime"))
    g = perf_stats(d, h, [*by, "regime"]).drop("vol", "max_dd")
    return g.filter(F.col("dates") >= 3 * h)


def invvol_weights(series: DataFrame, h: int, sleeve: str = "strategy") -> DataFrame:
    """Weight proportional to one over the expanding deviation of earlier dates."""
    past = sym_order([sleeve], "dt").rowsBetween(Window.unboundedPreceding, -1)
    ok = F.count("ret").over(past) >= 3 * h
    d = series.withColumn("_i", F.when(ok, F.try_divide(F.lit(1.0), F.stddev_samp("ret").over(past))))
    total = d.groupBy("dt").agg(F.sum("_i").alias("_t"))
    return d.join(total, "dt").withColumn("weight", F.try_divide("_i", "_t")).drop("_i", "_t")


def align_common_dates(series: DataFrame, strategy: str = "strategy") -> DataFrame:
    """Only the dates on which every strategy has a return."""
    k = series.agg(F.countDistinct(strategy).alias("_k")).withColumn("_j", F.lit(1))
    per = series.filter("ret is not null").groupBy("dt").agg(F.countDistinct(strategy).alias("_d"))
    full = per.withColumn("_j", F.lit(1)).join(k, "_j").filter("_d = _k").select("dt")
    return series.join(full, "dt", "left_semi")


def growth_of_one(curve: DataFrame, by=("series",), value: str = "value") -> DataFrame:
    w = sym_order(list(by), "dt")
    return curve.withColumn(
        "growth", F.try_divide(F.col(value), F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )


def breadth_realised(sharpe: Column, ic: Column) -> Column:
    """Independent bets a year implied by a Sharpe ratio and an IC."""
    return F.when(F.abs(ic) > 1e-6, F.pow(F.try_divide(sharpe, ic), F.lit(2)))


def ir_predicted(ic: Column, breadth: Column) -> Column:
    return ic * F.sqrt(breadth)


def breadth_adjusted(n_eff: Column, rho: Column, h: int) -> Column:
    """Breadth when a score repeats itself: rebalances shrink by (1 - rho) / (1 + rho)."""
    c = F.greatest(F.least(rho, F.lit(0.99)), F.lit(-0.99))
    return n_eff * F.greatest(F.lit(TRADING_DAYS / h) * (1 - c) / (1 + c), F.lit(0.1))
