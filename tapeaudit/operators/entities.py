"""Mapping free-text recipients to tickers with validity windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: constituent list named in the inclusion reason, and its size class
CAP_BUCKETS = (("S&P 500", "large"), ("midcap400", "mid"), ("smallcap600", "small"))


def cap_bucket(reason: str = "inclusion_reason") -> Column:
    """Size class; when several lists are named, the later one counts."""
    out = F.lit("other")
    for text, label in CAP_BUCKETS:
        out = F.when(F.contains(F.col(reason), F.lit(text)), F.lit(label)).otherwise(out)
    return out


@dataclass(frozen=True)
class Rules:
    """Ordered fragments: (fragment, ticker or None, first day, last day); and names that
    cannot be priced: (fragment, reason).  A rule list is code, not data: it is planned
    as one expression and needs no join."""

    names: tuple[tuple[str, str | None, str, str], ...]
    unpriceable: tuple[tuple[str, str], ...] = ()


def resolve(
    actions: DataFrame, rules: Rules, first_fragment_decides: bool = False,
    name: str = "recipient", date: str = "action_date",
) -> DataFrame:
    """Adds ticker and why.

    By default the first rule whose fragment matches and whose window holds the
    date gives the ticker.  With `first_fragment_decides` the first matching
    fragment is final even when its window has passed, so a later row with the
    same fragment is never reached.
    """
    text = F.upper(F.coalesce(F.col(name), F.lit("")))
    has = lambda frag: F.contains(text, F.lit(frag))
    null = F.lit(None).cast("string")

    def answer(ticker: Column, why: Column) -> Column:
        return F.struct(ticker.alias("ticker"), why.alias("why"))

    def window(lo, hi):
        return F.col(date).between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))

    def outside(t):
        return answer(null, F.lit(f"{t} outside its window"))

    private = answer(null, F.lit("private company"))
    out = answer(null, F.lit("unmatched"))
    if first_fragment_decides:
        for frag, t, lo, hi in reversed(rules.names):
            hit = private if t is None else F.when(window(lo, hi), answer(F.lit(t), F.lit("mapped"))).otherwise(outside(t))
            out = F.when(has(frag), hit).otherwise(out)
    else:
        for frag, t, _, _ in reversed(rules.names):
            out = F.when(has(frag), private if t is None else outside(t)).otherwise(out)
        for frag, t, lo, hi in reversed(rules.names):
            hit = private if t is None else answer(F.lit(t), F.lit("mapped"))
            out = F.when(has(frag) & window(lo, hi), hit).otherwise(out)
    for frag, why in reversed(rules.unpriceable):
        out = F.when(has(frag), answer(null, F.lit(why))).otherwise(out)
    return actions.withColumn("_r", out).select("*", "_r.ticker", "_r.why").drop("_r")


def coverage(resolved: DataFrame) -> DataFrame:
    """Rows and dollars by outcome, with their shares of the total."""
    g = resolved.groupBy("why").agg(
        F.count(F.lit(1)).alias("actions"),
        F.sum("amount_usd").alias("usd"),
        F.max(F.col("ticker").isNotNull().cast("int")).alias("priceable"),
    )
    # one row per reason: the reasons are the rules, a fixed short list
    total = g.agg(F.sum("actions").alias("_n"), F.sum("usd").alias("_u")).withColumn("_j", F.lit(1))
    return (
        g.withColumn("_j", F.lit(1))
        .join(total, "_j")
        .withColumn("usd_share", F.try_divide("usd", "_u"))
        .withColumn("row_share", F.col("actions") / F.col("_n"))
        .drop("_j", "_n", "_u")
    )


def largest_unmatched(resolved: DataFrame, n: int = 15) -> DataFrame:
    return (
        resolved.filter("why = 'unmatched'")
        .groupBy("recipient")
        .agg(F.count(F.lit(1)).alias("actions"), F.sum("amount_usd").alias("usd"))
        .orderBy(F.desc("usd"), "recipient")
        .limit(n)
    )
