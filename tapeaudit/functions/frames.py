"""Long trailing row frames whose cost per row does not grow with their length."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import sym_order

#: From this length on a trailing frame is put together from blocks.
LONG = 100

_JOIN = {
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + b,
}


def trailing(df: DataFrame, n: int, wanted: Mapping[str, tuple[str, Column | str]], by=("symbol",), order: str = "day_index") -> DataFrame:
    """Adds `name` = fn(value) over the last n rows for each name -> (fn, value); fn is max, min, sum or count.

    Frames at the start of a series are partial, nulls are left out, and a frame of nothing but nulls gives null (count: 0).
    Rows are cut into blocks of n. A frame of n rows is the end of one block and the beginning of the next, or one
    whole block, so it takes a running value from each side: two values a row whatever n is. Blocks of a series stay
    in its partition: no further shuffle. Blocks follow the order of the rows, so the sort for the values from the front
    also serves the step back to the block before.
    """
    by = [by] if isinstance(by, str) else list(by)
    place = F.row_number().over(sym_order(by, order)) - 1
    d = df.withColumn("_at", place).withColumn("_block", F.floor(F.col("_at") / n))
    block = Window.partitionBy(*by, "_block")
    grown = lambda ordering: block.orderBy(ordering).rowsBetween(Window.unboundedPreceding, 0)
    fn = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}
    head, tail = {}, {}
    for name, (f, value) in wanted.items():
        head["_head_" + name] = fn[f](value).over(grown(F.col(order).asc()))
        tail["_tail_" + name] = fn[f](value).over(grown(F.col(order).desc()))
    d = d.withColumns(tail).withColumns(head)
    whole = F.col("_at") % n == n - 1
    out = {}
    for name, (f, _) in wanted.items():
        before = F.lag("_tail_" + name, n - 1).over(Window.partitionBy(*by).orderBy("_block", order))
        out[name] = F.when(whole, F.col("_head_" + name)).otherwise(_JOIN[f](before, F.col("_head_" + name)))
    return d.withColumns(out).drop("_at", "_block", *head, *tail)


def trailing_mean(df: DataFrame, n: int, col: str, out: str, need: int = 1, **kw) -> DataFrame:
    """Adds `out`, the mean of the last n rows; null until `need` values exist."""
    d = trailing(df, n, {"_sum": ("sum", F.col(col).cast("double")), "_n": ("count", col)}, **kw)
    return d.withColumn(out, F.when(F.col("_n") >= need, F.col("_sum") / F.col("_n"))).drop("_sum", "_n")
