"""Long-short books from scores: buckets inside sectors, weights, per-name costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COSTS
from ..functions import cut, lagged
from . import ranking, xsection


def book_sector_neutral(
    df: DataFrame, score: str, fwd: str, q: int = 5, by=(), sector: str = "sector", min_names: int = 10,
    cost: float = 2 * COSTS.round_trip, width: int | None = None,
) -> DataFrame:
    """Long the top, short the bottom bucket of each sector; sectors equal; flat cost."""
    by = list(by)
    cell = [*by, "dt", sector]
    d = df.filter(F.col(fwd).isNotNull())
    d = xsection.with_bucket(d, cell, score, q, adaptive=True, min_names=min_names, width=width)
    legs = d.groupBy(*cell).agg(
        F.avg(F.when(F.col("bucket") == F.col("top_bucket"), F.col(fwd))).alias("_l"),
        F.avg(F.when(F.col("bucket") == 0, F.col(fwd))).alias("_s"),
    )
    return legs.groupBy(*by, "dt").agg((F.avg(F.col("_l") - F.col("_s")) - cost).alias("ret"))


def book_costed(
    df: DataFrame, score: str, fwd: str, half_bps: str = "half_bps", q: int = 5, by=(), sector: str = "sector",
    min_names: int = 10, borrow_bps: float = 0.0, hold: int = 0, width: int | None = None,
) -> DataFrame:
    """The same book where each leg pays the mean cost of its own names; gross and net.

    The legs' costs add.  `borrow_bps` a year is charged on the short leg for
    `hold` sessions (off by default).
    """
    by = list(by)
    cell = [*by, "dt", sector]
    d = df.filter(F.col(fwd).isNotNull() & F.col(half_bps).isNotNull())
    d = xsection.with_bucket(d, cell, score, q, adaptive=True, min_names=min_names, width=width)
    cost = 2 * F.col(half_bps) / 10_000
    top, low = F.col("bucket") == F.col("top_bucket"), F.col("bucket") == 0
    legs = d.groupBy(*cell).agg(
        (F.avg(F.when(top, F.col(fwd))) - F.avg(F.when(low, F.col(fwd)))).alias("gross"),
        (F.avg(F.when(top, cost)) + F.avg(F.when(low, cost))).alias("_c"),
    )
    borrow = borrow_bps / 10_000 * hold / 252
    return legs.groupBy(*by, "dt").agg(
        F.avg("gross").alias("gross"), F.avg(F.col("gross") - F.col("_c") - borrow).alias("net")
    )


METHODS = ("quintile", "signal", "risk", "neutral")


def sector_weights(
    df: DataFrame, score: str, method: str, q: int = 5, by=(), sector: str = "sector", vol: str = "vol63",
    width: int | None = None,
) -> DataFrame:
    """Adds _w: every sector of a date has gross one, or zero where nothing has weight.

    quintile: +1 / -1 on the outer buckets; signal: distance to the sector mean;
    risk and neutral: that distance over volatility.
    """
    by = list(by)
    cell = [*by, "dt", sector]
    if method == "quintile":
        d = xsection.with_bucket(df, cell, score, q, adaptive=True, width=width)
        raw = (
            F.when(F.col("bucket") == 0, -1.0)
            .when(F.col("bucket") == F.col("top_bucket"), 1.0)
            .otherwise(0.0)
        )
    elif method in METHODS:
        d = ranking.group_join(df, cell, width, _m=F.avg(score))
        raw = F.col(score) - F.col("_m")
        if method != "signal":
            raw = F.try_divide(raw, F.col(vol))
    else:
        raise ValueError(method)
    d = d.withColumn("_w", F.coalesce(raw, F.lit(0.0)))
    d = ranking.group_join(d, cell, width, _g=F.sum(F.abs("_w")))
    return d.select(*df.columns, F.coalesce(F.try_divide("_w", "_g"), F.lit(0.0)).alias("_w"))


def weights(
    df: DataFrame, score: str, method: str, q: int = 5, by=(), sector: str = "sector", vol: str = "vol63",
    width: int | None = None,
) -> DataFrame:
    """Adds w: the weights of sector_weights, scaled so that every date has gross one."""
    by = list(by)
    d = sector_weights(df, score, method, q, by, sector, vol, width)
    d = ranking.group_join(d, [*by, "dt"], width, _t=F.sum(F.abs("_w")))
    return d.select(*df.columns, F.coalesce(F.try_divide("_w", "_t"), F.lit(0.0)).alias("w"))


def book_weighted(weighted: DataFrame, fwd: str, half_bps: str = "half_bps", by=()) -> DataFrame:
    """Per date: weighted return, gross and net of entry and exit at the name's half spread."""
    gross = F.col("w") * F.col(fwd)
    cost = F.abs("w") * 2 * F.col(half_bps) / 10_000
    return weighted.groupBy(*by, "dt").agg(F.sum(gross).alias("gross"), F.sum(gross - cost).alias("net"))


def book_by_sector_weights(weighted: DataFrame, fwd: str, half_bps: str = "half_bps", by=()) -> DataFrame:
    """book_weighted from the weights _w of sector_weights: the date's gross is divided out of its sums, so rows
    are not gathered by date once more."""
    total, w = F.sum(F.abs("_w")), F.col("_w")
    cost = F.abs("_w") * 2 * F.col(half_bps) / 10_000
    share = lambda x: F.when(total > 0, F.sum(x) / total).otherwise(F.sum(x))
    return weighted.groupBy(*by, "dt").agg(share(w * F.col(fwd)).alias("gross"), share(w * F.col(fwd) - cost).alias("net"))


# ----------------------------------------------------------------------- spreads
# fixed values of the high-low spread estimator
CS_K = 3 - 2 * 2**0.5
FLOOR_BPS, CAP_BPS = 1.0, 1000.0
LARGE_HALF_BPS, MIN_HALF_BPS, MAX_HALF_BPS = 2.0, 1.0, 150.0


def corwin_schultz(ix: DataFrame, out: str = "spread") -> DataFrame:
    """Two-day high-low spread estimate (Corwin and Schultz 2012); negative becomes zero."""
    pc = lagged("close")
    seen = pc.isNotNull()
    d = ix.withColumn("_h", F.when(seen, F.greatest(F.col("high"), pc))).withColumn(
        "_l", F.when(seen, F.least(F.col("low"), pc))
    )
    d = d.withColumn("_hl", F.pow(F.log(F.try_divide("_h", "_l")), F.lit(2)))
    ph, pl = lagged("_h"), lagged("_l")
    beta = F.col("_hl") + lagged("_hl")
    d = d.withColumn("_b", beta).withColumn(
        "_g",
        F.when(ph.isNotNull(), F.pow(F.log(F.greatest(F.col("_h"), ph) / F.least(F.col("_l"), pl)), F.lit(2))),
    )
    alpha = (F.sqrt(2 * F.col("_b")) - F.sqrt("_b")) / CS_K - F.sqrt(F.col("_g") / CS_K)
    s = 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))
    return d.select(*ix.columns, F.when(s < 0, 0.0).otherwise(s).alias(out))


def spread_monthly(ix: DataFrame) -> DataFrame:
    """Median estimate per symbol and month in basis points, inside [1, 1000]."""
    d = corwin_schultz(ix).withColumn("month", F.date_format("dt", "yyyy-MM"))
    g = d.groupBy("symbol", "month").agg((F.median("spread") * 10_000).alias("spread_bps"))
    clip = F.least(F.greatest(F.col("spread_bps"), F.lit(FLOOR_BPS)), F.lit(CAP_BPS))
    return g.withColumn("spread_bps", F.when(F.col("spread_bps").isNotNull(), clip))


def spread_calibrated(monthly: DataFrame, large: DataFrame) -> DataFrame:
    """Half spreads scaled so that the large names' median is two basis points each month."""
    ref = monthly.join(large.select("symbol"), "symbol", "left_semi")
    anchor = ref.groupBy("month").agg(F.median("spread_bps").alias("anchor"))
    half = LARGE_HALF_BPS * F.try_divide("spread_bps", "anchor")
    clip = F.least(F.greatest(half, F.lit(MIN_HALF_BPS)), F.lit(MAX_HALF_BPS))
    return (
        monthly.join(anchor, "month", "left")
        .withColumn("half_spread_bps", F.when(half.isNotNull(), clip))
        .select("symbol", "month", "spread_bps", "half_spread_bps")
    )


# --------------------------------------------------------------------- live books
def latest_section(panel: DataFrame, needed, min_names: int = 100) -> DataFrame:
    """Rows of the last date whose complete rows number at least `min_names`."""
    d = panel.dropna(subset=list(needed))
    last = d.groupBy("dt").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_names)
    return d.join(last.agg(F.max("dt").alias("dt")), "dt", "left_semi")


def live_book(
    panel: DataFrame, score: str, factors, gross_usd: float, q: int = 5, min_names: int = 100,
    sector: str = "sector", width: int | None = None,
) -> DataFrame:
    """Positions for the latest full date: sector z-score, factor residual, outer sector
    buckets, equal dollars, whole shares."""
    # read for the last full date and again for its rows
    d = cut(panel.select("symbol", "dt", sector, "close", score, *factors))
    d = latest_section(d, [score, *factors], min_names)
    d = xsection.zscore(d, ["dt", sector], [score], "_z_", width).filter(F.col("_z_" + score).isNotNull())
    d = xsection.residualize(d, "_z_" + score, factors, out="res", min_names=1, width=width).filter("res is not null")
    d = xsection.with_bucket(d, ["dt", sector], "res", q, adaptive=True, width=width)
    side = F.when(F.col("bucket") == 0, -1).when(F.col("bucket") == F.col("top_bucket"), 1)
    d = d.withColumn("side", side).filter("side is not null")
    d = ranking.group_join(d, ["dt"], width, _n=F.count(F.lit(1)))
    usd = F.lit(float(gross_usd)) / F.col("_n")
    return d.select(
        "symbol", "dt", sector, "res", "close", F.col("side").cast("int").alias("side"),
        (usd * F.col("side")).alias("usd"),
        (F.rint(F.try_divide(usd, F.col("close"))) * F.col("side")).cast("bigint").alias("shares"),
    )


def capacity(book: DataFrame) -> DataFrame:
    """How many positions round to nothing, and the gross that ten shares a name would need."""
    g = book.agg(
        F.count(F.lit(1)).alias("names"),
        F.sum((F.col("shares") == 0).cast("int")).cast("bigint").alias("zero_shares"),
        F.median("close").alias("median_price"),
    )
    return g.withColumn("min_gross_usd", F.col("median_price") * 10 * F.col("names")).withColumn(
        "too_small", (F.col("zero_shares") > F.col("names") * 0.05).cast("int")
    )


def index_event_book(changes: DataFrame, last: DataFrame, gross_usd: float, market: str) -> DataFrame:
    """Short every addition in equal dollars, hedge with the market; `last` has (symbol, close)."""
    added = changes.filter("change = 'added'").select("symbol")
    n = added.agg(F.count(F.lit(1)).alias("_n")).withColumn("_j", F.lit(1))
    per = F.try_divide(F.lit(float(gross_usd)), 2 * F.col("_n"))
    s = added.join(last.select("symbol", "close"), "symbol").withColumn("_j", F.lit(1)).join(n, "_j")
    shorts = s.select(
        "symbol", F.lit("short").alias("side"), (-per).alias("usd"), "close",
        F.rint(F.try_divide(per, F.col("close"))).cast("bigint").alias("shares"),
    )
    hedge = shorts.agg((-F.sum("usd")).alias("usd")).select(
        F.lit(market).alias("symbol"), F.lit("long").alias("side"), "usd",
        F.lit(None).cast("double").alias("close"), F.lit(None).cast("bigint").alias("shares"),
    )
    return shorts.unionByName(hedge.filter("usd is not null"))
