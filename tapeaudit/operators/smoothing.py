"""Exponential averages as two window passes.

The recursion y = (1-a) y' + a x has the closed form of a weighted running sum.
Weights relative to the start of a block of rows stay inside double range, and a
block is long enough that what lies before the previous block has weight below
1e-16.  So the average is (local sum of the block) + decay * (value at the end of
the previous block); no per-symbol Python loop and no array per row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sym_order


def ema(
    df: DataFrame, col: str, out: str, alpha: float, min_periods: int, by="symbol", order="day_index"
) -> DataFrame:
    """Recursive average seeded by the first value; null before `min_periods` values.

    `col` may be null at the start of a history, not inside it.
    """
    by = [by] if isinstance(by, str) else list(by)
    block = math.ceil(-40.0 / math.log(1.0 - alpha))
    run = sym_order(by, order).rowsBetween(Window.unboundedPreceding, 0)
    k = F.count(col).over(run) - 1  # 0 on the seed row
    df = df.withColumn("_k", F.when(F.col(col).isNotNull(), k)).withColumn(
        "_b", F.floor(F.col("_k") / block)
    )
    pos = F.col("_k") - F.col("_b") * block
    grow = F.pow(F.lit(1.0 - alpha), -pos)
    weight = F.when(F.col("_k") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    inside = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(
        "_local", F.sum(F.col(col) * weight * grow).over(inside) * F.pow(F.lit(1.0 - alpha), pos)
    )
    past = sym_order(by, order).rowsBetween(Window.unboundedPreceding, -1)
    carry = F.last(F.when(pos == block - 1, F.col("_local")), ignorenulls=True).over(past)
    y = F.col("_local") + F.coalesce(carry, F.lit(0.0)) * F.pow(F.lit(1.0 - alpha), pos + 1)
    return df.withColumn(out, F.when(F.col("_k") >= min_periods - 1, y)).drop("_k", "_b", "_local")


def span_alpha(n: int) -> float:
    return 2.0 / (n + 1)


def rsi(df: DataFrame, col: str, out: str, n: int = 14, by="symbol", order="day_index") -> DataFrame:
    """Relative strength with Wilder smoothing; null where there were no losses."""
    w = sym_order(by, order)
    d = F.col(col) - F.lag(col).over(w)
    df = df.withColumn("_up", F.greatest(d, F.when(d.isNotNull(), F.lit(0.0)))).withColumn(
        "_dn", F.greatest(-d, F.when(d.isNotNull(), F.lit(0.0)))
    )
    df = ema(df, "_up", "_eu", 1.0 / n, n, by, order)
    df = ema(df, "_dn", "_ed", 1.0 / n, n, by, order)
    return df.withColumn(out, 100 - 100 / (1 + F.try_divide("_eu", "_ed"))).drop(
        "_up", "_dn", "_eu", "_ed"
    )


def macd(df: DataFrame, col: str = "adj_close", fast=12, slow=26, signal=9) -> DataFrame:
    """Adds ema_fast, ema_slow, macd, macd_signal, macd_hist."""
    df = ema(df, col, f"ema_{fast}", span_alpha(fast), fast)
    df = ema(df, col, f"ema_{slow}", span_alpha(slow), slow)
    df = df.withColumn("macd", F.col(f"ema_{fast}") - F.col(f"ema_{slow}"))
    df = ema(df, "macd", "macd_signal", span_alpha(signal), signal)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def ema_grouped(df: DataFrame, col: str, out: str, alpha: float, min_periods: int) -> DataFrame:
    """The same average by pandas inside one symbol's group; kept to test `ema` against."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def one(pdf):
        pdf = pdf.sort_values("day_index")
        pdf[out] = pdf[col].ewm(alpha=alpha, adjust=False, min_periods=min_periods).mean()
        return pdf

    return df.groupBy("symbol").applyInPandas(one, schema)
