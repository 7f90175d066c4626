"""Look-ahead audits: rebuild on truncated data, check label direction and column names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORWARD_NAMES = re.compile(r"^(fwd_|label_|next_)|future")


def audit_truncation(
    build, bars: DataFrame, cutoff, columns, tol: float = 1e-9, keys=("symbol", "dt")
) -> DataFrame:
    """Differences at the cutoff between a layer built on all bars and on bars up to the cutoff.

    `build` maps bars to the layer.  Rows present on one side only count as well.
    """
    keys = list(keys)
    cut = F.lit(cutoff).cast("date")
    full = build(bars).filter(F.col("dt") == cut).select(*keys, *columns)
    part = build(bars.filter(F.col("dt") <= cut)).filter(F.col("dt") == cut).select(*keys, *columns)
    a = full.select(*keys, F.lit(True).alias("_a"), *[F.col(c).cast("double").alias("a_" + c) for c in columns])
    b = part.select(*keys, F.lit(True).alias("_b"), *[F.col(c).cast("double").alias("b_" + c) for c in columns])
    j = a.join(b, keys, "full")

    def off(c):
        x, y = F.col("a_" + c), F.col("b_" + c)
        scale = F.greatest(F.lit(1.0), F.abs(x))
        return (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tol * scale, F.lit(False))

    issue = [F.when(F.col("_a").isNull() | F.col("_b").isNull(), "row missing")]
    issue += [F.when(off(c), c) for c in columns]
    return j.select(*keys, F.explode(F.array_compact(F.array(*issue))).alias("column"))


def audit_layers(layers, bars: DataFrame, cutoffs, tol: float = 1e-9) -> DataFrame:
    """audit_truncation of several layers: per layer and cut-off the rows of that date and the values that change when
    all later bars are taken away (a value that differs, or a row that only one side has).

    `layers` maps a name to (build, keys); every column of the layer but the keys and texts is compared.
    """
    parts = []
    for name, (build, keys) in layers.items():
        every = build(bars)
        columns = [f.name for f in every.schema if f.name not in keys and f.dataType.simpleString() not in ("string", "date")]
        for cutoff in cutoffs:
            day = F.lit(cutoff).cast("date")
            n = every.filter(F.col("dt") == day).agg(F.count(F.lit(1)).alias("rows")).withColumn("_j", F.lit(1))
            bad = audit_truncation(build, bars, cutoff, columns, tol, keys).agg(F.count(F.lit(1)).alias("differences"))
            both = n.join(bad.withColumn("_j", F.lit(1)), "_j")
            parts.append(both.select(F.lit(name).alias("layer"), day.alias("cutoff"), F.lit(len(columns)).alias("columns"), "rows", "differences"))
    return reduce(DataFrame.unionByName, parts)


def audit_labels_absent(build_labels, bars: DataFrame, cutoff, columns) -> DataFrame:
    """Labels that exist on the last date of truncated data; none may."""
    cut = F.lit(cutoff).cast("date")
    last = build_labels(bars.filter(F.col("dt") <= cut)).filter(F.col("dt") == cut)
    return last.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])).select("symbol", "dt")


def audit_label_direction(indexed: DataFrame, labelled: DataFrame, horizons=(1, 5, 21), tol: float = 1e-12) -> DataFrame:
    """Labels that differ from a separate join on the symbol's session position + h."""
    from ..functions import sym_order

    pos = indexed.select("symbol", "dt", "adj_close", F.row_number().over(sym_order()).alias("_p"))
    parts = []
    for h in horizons:
        ahead = pos.select("symbol", (F.col("_p") - h).alias("_p"), F.col("adj_close").alias("_f"))
        want = pos.join(ahead, ["symbol", "_p"], "left").select(
            "symbol", "dt", (F.col("_f") / F.col("adj_close") - 1.0).alias("_want")
        )
        got = labelled.select("symbol", "dt", F.col(f"fwd_ret_{h}d").alias("_got"))
        j = got.join(want, ["symbol", "dt"], "full")
        bad = (F.col("_got").isNull() != F.col("_want").isNull()) | (F.abs(F.col("_got") - F.col("_want")) > tol)
        parts.append(j.filter(bad).select("symbol", "dt", F.lit(h).alias("horizon")))
    return reduce(DataFrame.unionByName, parts)


def forward_columns(df: DataFrame) -> list[str]:
    """Columns of a feature layer whose names belong to labels; none may."""
    return [c for c in df.columns if FORWARD_NAMES.search(c)]
