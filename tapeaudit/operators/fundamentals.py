"""Filed facts: what was known at each filing date, and ratios to price."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lagged
from . import asof
from .features import ffill

# fixed values: concept names and the sign under which a high value is attractive
FLOW = ("NetIncomeLoss", "NetCashProvidedByUsedInOperatingActivities", "GrossProfit")
STOCK = (
    "Assets",
    "StockholdersEquity",
    "CommonStockSharesOutstanding",
    "EntityCommonStockSharesOutstanding",
    "WeightedAverageNumberOfDilutedSharesOutstanding",
)
SHARE_CONCEPTS = (
    "EntityCommonStockSharesOutstanding",
    "CommonStockSharesOutstanding",
    "WeightedAverageNumberOfDilutedSharesOutstanding",
)
SIGNS = {
    "earnings_yield": 1,
    "book_to_price": 1,
    "roe": 1,
    "accruals": -1,
    "asset_growth": -1,
    "gross_profitability": 1,
}
SIGNALS = tuple(SIGNS)


def known_values(facts: DataFrame, tie: str = "fact_id") -> DataFrame:
    """(symbol, concept, filed, value): the value known after each filing date.

    Stock concepts: the latest period end.  Flow concepts: the latest annual period,
    unless a newer quarter is known, then the sum of the last four quarters.
    A later filing of the same period replaces the earlier one.
    """
    f = facts.groupBy("symbol", "concept", "filed", "period_end", "period_start").agg(
        F.max_by("val", tie).alias("val"), F.max(tie).alias("_tie")
    )
    f = f.withColumn("_days", F.datediff("period_end", "period_start"))
    key = ["symbol", "concept"]
    upto = Window.partitionBy(*key).orderBy("filed").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    latest = lambda cond: F.max(
        F.when(cond, F.struct("period_end", "filed", "_tie", "val"))
    ).over(upto)
    is_flow = F.col("concept").isin(*FLOW)
    annual, quarter = F.col("_days").between(330, 400), F.col("_days").between(60, 120)
    f = f.select(
        "*",
        latest(~is_flow).alias("_any"),
        latest(is_flow & annual).alias("_year"),
        latest(is_flow & quarter).alias("_qtr"),
    )
    at = f.groupBy(*key, "filed").agg(
        F.max("_any").alias("_any"), F.max("_year").alias("_year"), F.max("_qtr").alias("_qtr")
    )
    year_wins = F.col("_year").isNotNull() & (
        F.col("_qtr").isNull() | (F.col("_year.period_end") >= F.col("_qtr.period_end"))
    )
    direct = at.select(
        *key, "filed", F.when(year_wins, F.col("_year.val")).otherwise(F.col("_any.val")).alias("value")
    ).filter("value is not null")
    ask = at.filter(F.col("_qtr").isNotNull() & ~year_wins).select(*key, "filed")
    return direct.unionByName(_last_four(f.filter(is_flow & quarter), ask, key))


def _last_four(quarters: DataFrame, ask: DataFrame, key) -> DataFrame:
    """Sum of the four latest quarter ends known at each asked date.

    The set of known quarter ends changes only when a new one is first filed, so
    the running list is over quarter ends (months), never over filings.
    """
    upto = Window.partitionBy(*key).orderBy("filed").rowsBetween(Window.unboundedPreceding, 0)
    first = quarters.groupBy(*key, "period_end").agg(F.min("filed").alias("filed"))
    new = first.groupBy(*key, "filed").agg(F.collect_list("period_end").alias("_p"))
    new = new.withColumn("_p", F.flatten(F.collect_list("_p").over(upto)))
    new = new.withColumn("_p", F.slice(F.sort_array("_p", asc=False), 1, 4))
    four = asof.asof_backward(
        ask, new.withColumnRenamed("filed", "_f"), "_f", ["_p"], by=key, dt="filed"
    ).filter(F.size("_p") == 4)
    ends = four.select(*key, "filed", F.explode("_p").alias("period_end"))
    vals = quarters.select(*key, "period_end", F.col("filed").alias("_f"), "val", "_tie")
    hit = asof.asof_backward(
        ends, vals, "_f", ["val"], by=[*key, "period_end"], dt="filed", order=F.col("_tie")
    )
    return hit.groupBy(*key, "filed").agg(F.sum("val").alias("value"))


def wide_facts(known: DataFrame, concepts) -> DataFrame:
    """One column per concept at each filing date of the symbol, filled forward."""
    wide = known.groupBy("symbol", "filed").pivot("concept", list(concepts)).agg(F.max("value"))
    return ffill(wide, list(concepts), order="filed")


def attach_ratios(panel: DataFrame, wide: DataFrame, concepts) -> DataFrame:
    """Six signed ratios on every panel row (needs close); a missing concept gives null."""
    concepts = list(concepts)
    p = asof.asof_backward(panel, wide, "filed", concepts)
    col = lambda n: F.col(n) if n in concepts else F.lit(None).cast("double")
    shares = F.coalesce(*[col(n) for n in (STOCK[2], STOCK[3], STOCK[4])])
    mcap = F.nullif(shares * F.col("close"), F.lit(0.0))
    ni, eq, at = col("NetIncomeLoss"), col("StockholdersEquity"), col("Assets")
    ocf, gp = col(FLOW[1]), col(FLOW[2])
    prev = lagged("Assets", 252) if "Assets" in concepts else F.lit(None).cast("double")
    raw = {
        "earnings_yield": F.try_divide(ni, mcap),
        "book_to_price": F.try_divide(eq, mcap),
        "roe": F.try_divide(ni, eq),
        "accruals": F.try_divide(ni - ocf, at),
        "asset_growth": F.try_divide(at, prev) - 1.0,
        "gross_profitability": F.try_divide(gp, at),
    }
    return p.select(*panel.columns, *[(SIGNS[k] * v).alias(k) for k, v in raw.items()])


def pit_shares(facts: DataFrame) -> DataFrame:
    """One positive share count per (symbol, filing date), by order of preference."""
    rank = F.create_map(*[x for i, c in enumerate(SHARE_CONCEPTS) for x in (F.lit(c), F.lit(i))])
    f = facts.filter(F.col("concept").isin(*SHARE_CONCEPTS) & (F.col("val") > 0))
    order = F.struct(rank[F.col("concept")], F.col("period_end"), F.col("fact_id"))
    return f.groupBy("symbol", "filed").agg(F.min_by("val", order).alias("shares"))


def pit_mcap(panel: DataFrame, shares: DataFrame) -> DataFrame:
    """Market value from the shares known at the date and the raw close."""
    p = asof.asof_backward(panel, shares, "filed", ["shares"])
    return p.withColumn("mcap", F.col("shares") * F.col("close")).drop("filed")
