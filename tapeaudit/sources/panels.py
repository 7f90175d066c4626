"""Bars, events, trials and journals derived from the order and event tables.

All rows are first aggregated to one row per (symbol, date): a symbol that holds
a third of the raw rows is reduced map-side before anything is shuffled, and
every later per-symbol group is bounded by the number of sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MARKET
from ..functions import uniform

ORDER_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def priced_lines(spark, sf_dir) -> DataFrame:
    """One traded line: date, unit price, discounted price, quantity, arrival key."""
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return li.select(
        "l_partkey",
        "l_suppkey",
        F.col("l_shipdate").cast("date").alias("dt"),
        price.alias("price"),
        (price * (1 - F.col("l_discount"))).alias("adj"),
        F.col("l_quantity").alias("qty"),
        F.struct(*ORDER_KEY).alias("ord"),
    )


def _bar(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(F.struct("ord", "price")).alias("first"),
        F.max(F.struct("ord", "price", "adj")).alias("last"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.sum("qty").alias("volume"),
    )


def _with_market(named: DataFrame) -> DataFrame:
    """Add the market bar of every date, built from the bars already aggregated."""
    market = named.groupBy("dt").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("volume").alias("volume"),
    )
    both = named.unionByName(market.withColumn("symbol", F.lit(MARKET)))
    return both.select(
        "symbol",
        "dt",
        F.col("first.price").alias("open"),
        "high",
        "low",
        F.col("last.price").alias("close"),
        F.col("last.adj").alias("adj_close"),
        F.col("volume").cast("bigint").alias("volume"),
    )


def bars(spark, sf_dir) -> DataFrame:
    """Daily bars of the brands and of the market."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    lines = priced_lines(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return _with_market(_bar(lines, "symbol", "dt"))


def wide_bars(spark, sf_dir) -> DataFrame:
    """Weekly bars of the suppliers and of the market (a wide cross-section)."""
    lines = priced_lines(spark, sf_dir).select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
        F.trunc("dt", "week").alias("dt"),
        "price",
        "adj",
        "qty",
        "ord",
    )
    return _with_market(_bar(lines, "symbol", "dt"))


def symbols(spark, sf_dir) -> DataFrame:
    brand = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct()
    num = F.substring("symbol", 7, 10).try_cast("int")
    stocks = brand.select(
        "symbol",
        F.col("symbol").alias("name"),
        F.concat(F.lit("SEC"), num % 5).alias("sector"),
        F.lit("stock").alias("kind"),
        F.when(num % 3 == 0, "S&P 500").when(num % 3 == 1, "midcap400").otherwise("smallcap600")
        .alias("inclusion_reason"),
    )
    return stocks.unionByName(_market_row(spark))


def wide_symbols(spark, sf_dir) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    sup = table(spark, sf_dir, "supplier").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    )
    stocks = sup.select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"),
        F.col("s_name").alias("name"),
        F.col("r_name").alias("sector"),
        F.lit("stock").alias("kind"),
        F.when(F.col("s_suppkey") % 3 == 0, "S&P 500")
        .when(F.col("s_suppkey") % 3 == 1, "midcap400")
        .otherwise("smallcap600")
        .alias("inclusion_reason"),
    )
    return stocks.unionByName(_market_row(spark))


def _market_row(spark) -> DataFrame:
    return spark.range(1).select(
        F.lit(MARKET).alias("symbol"),
        F.lit(MARKET).alias("name"),
        F.lit(None).cast("string").alias("sector"),
        F.lit("etf").alias("kind"),
        F.lit("benchmark").alias("inclusion_reason"),
    )


def wide_width(spark, sf_dir) -> int:
    """Upper bound of a weekly cross-section: the supplier count (parquet metadata)."""
    return table(spark, sf_dir, "supplier").count() + 1


def _brand_of(key) -> F.Column:
    return F.concat(F.lit("Brand#"), (F.lit(1) + F.col(key) % 25).cast("string"))


def earnings(spark, sf_dir) -> DataFrame:
    """Announcements (local time), one per symbol and time."""
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(
        hours=(F.col("o_orderkey") % 24).cast("int")
    )
    return (
        o.select(
            _brand_of("o_custkey").alias("symbol"),
            at.alias("announced_at"),
            "o_orderkey",
            "o_totalprice",
        )
        .groupBy("symbol", "announced_at")
        .agg(F.min_by("o_totalprice", "o_orderkey").alias("p"))
        .select(
            "symbol",
            "announced_at",
            F.lit(2.5).alias("eps_estimate"),
            (F.col("p") / 1e5).alias("eps_actual"),
            ((F.col("p") - 250000) / 2500).alias("surprise_pct"),
        )
    )


def fundamentals(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    filed = F.col("o_orderdate").cast("date")
    end = F.date_sub(F.trunc(filed, "month"), 1)
    concept = (
        F.when(F.floor(k / 4) % 6 == 0, "NetIncomeLoss")
        .when(F.floor(k / 4) % 6 == 1, "Assets")
        .when(F.floor(k / 4) % 6 == 2, "StockholdersEquity")
        .when(F.floor(k / 4) % 6 == 3, "NetCashProvidedByUsedInOperatingActivities")
        .when(F.floor(k / 4) % 6 == 4, "GrossProfit")
        .otherwise("CommonStockSharesOutstanding")
    )
    days = F.when(F.floor(k / 16) % 5 == 0, 365).otherwise(90)
    return o.select(
        _brand_of("o_custkey").alias("symbol"),
        concept.alias("concept"),
        F.date_sub(end, days).alias("period_start"),
        end.alias("period_end"),
        filed.alias("filed"),
        F.col("o_totalprice").alias("val"),
        F.when(days == 365, "10-K").otherwise("10-Q").alias("form"),
        k.alias("fact_id"),
    )


def insider_trades(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    ship = F.col("l_shipdate").cast("date")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("accession"),
        "symbol",
        F.date_add(ship, F.col("l_linenumber")).alias("filing_date"),
        ship.alias("trans_date"),
        F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "S").otherwise(F.col("l_returnflag"))
        .alias("trans_code"),
        F.col("l_quantity").alias("shares"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )


def short_interest(spark, sf_dir) -> DataFrame:
    """Half-monthly short positions per brand, settled on the 15th and at month end."""
    from pyspark.sql import Window

    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    li = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    d = F.col("l_shipdate").cast("date")
    settle = F.when(F.dayofmonth(d) <= 15, F.date_add(F.trunc(d, "month"), 14)).otherwise(
        F.last_day(d)
    )
    half = (
        li.select("symbol", d.alias("d"), settle.alias("settlement_date"), "l_quantity", "l_discount")
        .groupBy("symbol", "settlement_date", "d")
        .agg(
            F.sum(F.when(F.col("l_discount") >= 0.05, F.col("l_quantity")).otherwise(0.0)).alias("s"),
            F.sum("l_quantity").alias("v"),
        )
        .groupBy("symbol", "settlement_date")
        .agg(
            F.sum("s").alias("short_shares"),
            (F.sum("v") / F.count("d")).alias("avg_daily_vol"),
        )
    )
    w = Window.partitionBy("symbol").orderBy("settlement_date")
    return half.select(
        "symbol",
        "settlement_date",
        "short_shares",
        F.lag("short_shares").over(w).alias("prev_short"),
        "avg_daily_vol",
        F.try_divide("short_shares", "avg_daily_vol").alias("days_to_cover"),
    )


def contracts(spark, sf_dir) -> DataFrame:
    """Contract actions as downloaded: duplicates possible, nothing derived yet."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        (F.col("o_totalprice") * 1e4).alias("amount_usd"),
        F.upper(F.concat_ws(" ", "c_mktsegment", "c_name")).alias("recipient"),
        F.col("o_orderdate").cast("date").alias("action_date"),
        F.floor(F.col("o_orderkey") / 3).cast("string").alias("award_id"),
        (F.col("o_orderkey") % 3).cast("string").alias("mod"),
        F.col("o_orderpriority").alias("agency"),
    )


def trial_log(spark, sf_dir) -> DataFrame:
    """Every event as a registry entry: declarations, records, abandonments."""
    e = table(spark, sf_dir, "events")
    kind = (
        F.when(F.col("event_type") == "signup", "declare")
        .when(F.col("event_type") == "purchase", "record")
        .when(F.col("event_type") == "error", "abandon")
        .otherwise("prediction")
    )
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        kind.alias("kind"),
        F.when(kind == "declare", F.col("event_id"))
        .otherwise(F.floor(F.col("event_id") / 7) * 7).cast("bigint")
        .alias("strategy_id"),
        (1 + F.col("user_id") % 5).cast("int").alias("variants"),
        (F.col("value") / 100).alias("sharpe"),
        (F.lit(30) + F.col("user_id") % 400).cast("int").alias("n_obs"),
    )


def journal(spark, sf_dir) -> DataFrame:
    """Every order as a hand-kept trade, with planted violations."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    entry = F.col("o_totalprice") / 1000
    is_long = k % 2 == 0
    away = F.when(k % 17 == 0, -0.05).otherwise(F.when(k % 13 == 0, 0.30).otherwise(0.05))
    sign = F.when(is_long, 1.0).otherwise(-1.0)
    opened = F.col("o_orderdate").cast("date")
    closed = F.when(k % 3 == 0, F.date_add(opened, (k % 30 - 1).cast("int")))
    return o.select(
        k.alias("row_id"),
        F.when(k % 19 == 0, k - k % 5).otherwise(k).alias("trade_id"),
        F.when(k % 41 == 0, "ZZZZ").otherwise(_brand_of("o_custkey")).alias("symbol"),
        F.when(k % 43 == 0, "flat").when(is_long, "long").otherwise("short").alias("direction"),
        opened.alias("opened_at"),
        entry.alias("entry"),
        (entry * (1 - sign * away)).alias("stop"),
        F.when(k % 5 != 0, entry * (1 + sign * 0.10)).alias("target"),
        F.when(k % 47 == 0, F.lit(None)).otherwise(k % 100).cast("bigint").alias("shares"),
        closed.alias("closed_at"),
        F.when((k % 3 == 0) & (k % 23 != 0), entry * (1 + ((k % 21) - 10) / 100)).alias("exit"),
        F.when(k % 7 != 0, k % 12).cast("int").alias("signal_score"),
        F.when(k % 11 != 0, (k % 3 == 0).cast("int") + (k % 29 == 0).cast("int")).cast("int")
        .alias("followed_plan"),
    )


def observations(spark, sf_dir) -> DataFrame:
    """Every event as a hand-kept observation, with planted violations."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("obs_id"),
        F.when(k % 31 == 0, "ZZZZ").otherwise(_brand_of("user_id")).alias("symbol"),
        F.when(k % 37 != 0, F.col("ts").cast("date")).alias("dt"),
        F.when(k % 29 == 0, " ").otherwise(F.col("event_type")).alias("field"),
        F.when(k % 5 != 0, F.col("value")).alias("value"),
        F.when(k % 10 == 0, F.lit("seen")).alias("text_value"),
        F.when(k % 41 == 0, "").otherwise("desk").alias("source"),
    )


def scored_symbols(panel: DataFrame, models=("gbm", "logistic")) -> DataFrame:
    """Stand-in probabilities: a hash of (model, symbol, date)."""
    m = F.explode(F.array(*[F.lit(x) for x in models])).alias("model_name")
    return panel.select("*", m).withColumn("y_prob", uniform("model_name", "symbol", "dt"))


def snapshots(bars_df: DataFrame) -> DataFrame:
    """Two membership snapshots: brands of the first and last quarter, two left out of each."""
    stock = bars_df.filter(F.col("symbol") != MARKET)
    q = F.trunc("dt", "quarter")
    keyed = stock.select("symbol", q.alias("q")).distinct()
    ends = keyed.agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    out_of = {"before": ("Brand#3", "Brand#7"), "now": ("Brand#11", "Brand#12")}
    both = keyed.join(ends, (F.col("q") == F.col("lo")) | (F.col("q") == F.col("hi")))
    side = F.when(F.col("q") == F.col("lo"), "before").otherwise("now")
    left_out = F.when(side == "before", F.col("symbol").isin(*out_of["before"])).otherwise(
        F.col("symbol").isin(*out_of["now"])
    )
    return both.filter(~left_out).select(side.alias("snapshot"), "symbol")
