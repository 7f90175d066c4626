"""Column builders used by many operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sym_order(by=("symbol",), order="day_index") -> WindowSpec:
    """A symbol's history in session order (at most one row per session)."""
    by = [by] if isinstance(by, str) else list(by)
    return Window.partitionBy(*by).orderBy(order)


def rows_back(n: int, end: int = 0, by=("symbol",), order="day_index") -> WindowSpec:
    """The n rows that end `end` rows before the current one."""
    return sym_order(by, order).rowsBetween(-(n - 1) - end, -end)


def lagged(col, n: int = 1, by=("symbol",), order="day_index") -> Column:
    return F.lag(col, n).over(sym_order(by, order))


def full(agg: Column, counted, n: int, need: int | None = None, **kw) -> Column:
    """`agg` over the last n rows, null until `need` (default n) values exist."""
    w = rows_back(n, **kw)
    return F.when(F.count(counted).over(w) >= (n if need is None else need), agg.over(w))


def ratio(a, b) -> Column:
    """a / b, null when b is zero."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(a.cast("double"), b.cast("double"))


# Two engines sum in different orders, so values may differ in the last bits.  The
# rounding boundary is put where no short decimal lies, instead of at one half.
ROUND_AT = 0.51372419


def settle(x, digits: int = 6) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * F.lit(10.0**digits) + F.lit(ROUND_AT)) / F.lit(10.0**digits)


def tidy(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Round every double column, so that two engines print the same value."""
    return df.select(
        *[
            settle(f.name, per_column.get(f.name, digits)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
