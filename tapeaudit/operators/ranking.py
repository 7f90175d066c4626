"""Exact ranks inside groups of any size.

A window over a date puts that whole date into one task.  That is fine while the
cross-section is known to be narrow, so the callers pass `width`, an upper bound
on the rows of one group (for example the number of listed symbols).  Without a
bound, or beyond MAX_GROUP, the ranks are put together from ordered pieces:

1. rows are dealt by sampled ranges of (group, value), and of the tie-breaker where
   there is one, so a piece has about as many rows as any other, however the values
   lie: close together, far apart or, with a tie-breaker, all equal;
2. only the rows of one piece are ordered inside a task, and numbered as they are written;
3. a running count over the pieces of a group gives each piece its offset, a small stored
   table that is joined back.

Where ties share a rank, rows are first reduced to (group, value, count), so ties of any
size cost one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import ROWS_PER_TASK, cut

MAX_GROUP = 1_000_000


def _same(a: DataFrame, b: DataFrame, keys) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b["_k_" + k]) for k in keys])


def join_on(a: DataFrame, b: DataFrame, keys, how="left") -> DataFrame:
    """Join that treats null keys as equal; the keys of `a` are kept once."""
    keys = list(keys)
    r = b.select(
        *[F.col(c).alias("_k_" + c) if c in keys else F.col(c) for c in b.columns]
    )
    out = a.join(r, _same(a, r, keys), how)
    return out.drop(*["_k_" + k for k in keys])


def in_pieces(df: DataFrame, order) -> DataFrame:
    """`df` with _piece, the number of its piece in the order of the columns `order`, nulls first, and _at, the
    row's place inside the piece.

    Written once, since ranges are sampled: all that follows sees the same pieces. As many pieces as the session
    has shuffle partitions, or more, so that none is much larger than ROWS_PER_TASK; rows that are equal in all of
    `order` share one. `df` is stored before, or sampling would compute it once more.
    """
    df = cut(df)
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_TASK))
    by = [F.col(c).asc_nulls_first() for c in order]
    placed = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    return cut(placed.withColumns({"_piece": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))


def running(vals: DataFrame, by, value: str, **totals: str) -> DataFrame:
    """For rows with one entry per (by, value): adds, per total `name=column`, the sum of
    that column over smaller values (name_less) and over the group (name_all).

    Nulls come first, as in an ascending sort.
    """
    by = list(by)
    kept = vals.columns
    vals = in_pieces(vals, [*by, value])
    g = Window.partitionBy(*by)
    upto = g.orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)
    bins = vals.groupBy(*by, "_piece").agg(*[F.sum(c).alias("_c_" + n) for n, c in totals.items()])
    bins = bins.select(
        *by,
        "_piece",
        *[(F.sum("_c_" + n).over(upto) - F.col("_c_" + n)).alias("_b_" + n) for n in totals],
        *[F.sum("_c_" + n).over(g).alias(n + "_all") for n in totals],
    )
    w = (
        Window.partitionBy(*by, "_piece")
        .orderBy(F.col(value).asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = join_on(vals, cut(bins), [*by, "_piece"], "inner")
    return out.select(
        *kept,
        *[n + "_all" for n in totals],
        *[(F.col("_b_" + n) + F.sum(c).over(w) - F.col(c)).alias(n + "_less") for n, c in totals.items()],
    )


def value_counts(df: DataFrame, by, value: str) -> DataFrame:
    """(by, value) -> ties, less (rows with a smaller value), n (rows of the group)."""
    by = list(by)
    vals = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    return running(vals, by, value, n="ties").withColumnsRenamed({"n_less": "less", "n_all": "n"})


def _narrow(width) -> bool:
    return width is not None and width <= MAX_GROUP


def with_counts(df: DataFrame, by, value: str, width=None) -> DataFrame:
    """Adds less, ties and n for `value` inside each group."""
    by = list(by)
    if _narrow(width):
        o = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_first())
        return df.select(
            "*",
            (F.rank().over(o) - 1).cast("bigint").alias("less"),
            F.count(F.lit(1)).over(o.rangeBetween(0, 0)).alias("ties"),
            F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("n"),
        )
    base = cut(df)
    return join_on(base, value_counts(base, by, value), [*by, value])


def percent_rank(df: DataFrame, by, value: str, out: str, width=None) -> DataFrame:
    r = with_counts(df, by, value, width)
    pr = F.when(F.col("n") > 1, F.col("less") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return r.withColumn(out, pr).drop("less", "ties", "n")


def average_rank(df: DataFrame, by, value: str, out: str, width=None) -> DataFrame:
    r = with_counts(df, by, value, width)
    return r.withColumn(out, F.col("less") + (F.col("ties") + 1) / 2.0).drop("less", "ties", "n")


def row_numbers(
    df: DataFrame, by, value: str, tie: str, out: str, size: str | None = None, width=None
) -> DataFrame:
    """1-based position by (value, tie) inside the group, and the group size."""
    by = list(by)
    if _narrow(width):
        o = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_first(), tie)
        r = df.withColumn(out, F.row_number().over(o).cast("bigint"))
        if size:
            r = r.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*by)))
        return r
    # a tie of any size is spread over pieces by its tie-breaker
    placed = in_pieces(df, [*by, value, tie])
    g = Window.partitionBy(*by)
    upto = g.orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)
    pieces = placed.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    # the number of a group's first row, less that row's place in the piece
    pieces = pieces.select(
        *by, "_piece", (F.sum("_c").over(upto) - F.col("_c") + 1 - F.col("_first")).alias("_piece_from"), F.sum("_c").over(g).alias("_piece_n")
    )
    r = join_on(placed, cut(pieces), [*by, "_piece"]).withColumn(out, (F.col("_at") + F.col("_piece_from")).cast("bigint"))
    if size:
        r = r.withColumn(size, F.col("_piece_n"))
    return r.drop("_piece", "_at", "_piece_from", "_piece_n")


def group_join(df: DataFrame, by, width: int | None = None, **aggs: Column) -> DataFrame:
    """Attach group aggregates to every row, name=aggregate.

    A group known to be narrow is a window: one shuffle.  Otherwise the rows are
    materialised, aggregated map-side and joined back, so that no group is gathered
    in one task; the small side is broadcast only if it measures small.
    """
    by = list(by)
    if _narrow(width):
        w = Window.partitionBy(*by)
        return df.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    base = cut(df)
    return join_on(base, base.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()]), by)
