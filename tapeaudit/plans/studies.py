"""Whole studies: operators composed the way a researcher runs them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TRADING_DAYS
from ..functions import cut, settle
from ..operators import books, fundamentals, inference, perf, ranking, xsection


def factor_attribution(scored: DataFrame, h: int, q: int = 5, width: int | None = None) -> DataFrame:
    """Per signal: the book of the raw score and of its factor residual side by side.

    `scored` has (signal, symbol, dt, sector, score, resid, fwd_<h>, half_bps).  Raw and
    residual become rows, so both books are built in one pass.
    """
    both = F.explode(
        F.array(
            F.struct(F.lit("raw").alias("variant"), F.col("score").alias("s")),
            F.struct(F.lit("resid").alias("variant"), F.col("resid").alias("s")),
        )
    ).alias("v")
    d = scored.select("signal", "symbol", "dt", "sector", f"fwd_{h}", "half_bps", both)
    d = d.select("*", "v.variant", "v.s").drop("v")
    by = ["signal", "variant"]
    book = books.book_costed(d, "s", f"fwd_{h}", q=q, by=by, width=width)
    net = cut(book.select(*by, "dt", F.col("net").alias("ret")))
    st = cut(perf.perf_stats(net, h, by))
    first = net.filter("variant = 'raw'").groupBy("signal").agg(F.min("dt").alias("first_dt"))
    pick = lambda v: st.filter(F.col("variant") == v)
    a = pick("raw").select("signal", F.col("n").alias("n_obs"), F.col("sharpe").alias("raw_sharpe"), F.col("t").alias("raw_t"))
    b = pick("resid").select("signal", F.col("sharpe").alias("res_sharpe"), F.col("t").alias("res_t"))
    ok = (F.col("res_sharpe") > 0.2) & (F.abs("res_t") > 1.5)
    return a.join(b, "signal").join(first, "signal").withColumn("survives", F.coalesce(ok.cast("int"), F.lit(0)))


def cap_spectrum(
    panel: DataFrame, score: str, fwd: str, h: int, q: int = 5, min_names: int = 10, width: int | None = None
) -> DataFrame:
    """The same book in every size class and in all names: gross, net of each name's own
    costs, and the median cost.  Every row counts in its class and in 'all'."""
    cls = F.explode(F.array(F.lit("all"), F.col("bucket"))).alias("cls")
    d = panel.select("symbol", "dt", "sector", score, fwd, "half_bps", cls)
    d = xsection.zscore(d, ["cls", "dt", "sector"], [score], "_z_", width).withColumn("s", settle("_z_" + score, 9))
    d = cut(d)
    info = d.groupBy("cls").agg(
        F.countDistinct("symbol").alias("names"), F.median("half_bps").alias("med_half_bps")
    )
    b = books.book_costed(d, "s", fwd, q=q, by=["cls"], min_names=min_names, width=width)
    side = F.explode(
        F.array(F.struct(F.lit("g").alias("side"), F.col("gross").alias("ret")), F.struct(F.lit("n").alias("side"), F.col("net").alias("ret")))
    ).alias("s")
    st = cut(perf.perf_stats(b.select("cls", "dt", side).select("cls", "dt", "s.side", "s.ret"), h, ["cls", "side"]))
    g = st.filter("side = 'g'").select("cls", F.col("ret_ann").alias("gross_ret"), F.col("sharpe").alias("gross_sharpe"))
    n = st.filter("side = 'n'").select(
        "cls", F.col("ret_ann").alias("net_ret"), F.col("sharpe").alias("net_sharpe"), F.col("t").alias("net_t"), F.col("n").alias("n_obs")
    )
    return info.join(g, "cls").join(n, "cls").withColumnRenamed("cls", "bucket")


def sleeve_compare(
    panel: DataFrame, sleeves: dict[str, list[str]], fwd: str, h: int, q: int = 5, width: int | None = None
) -> DataFrame:
    """Books of each sleeve, of their average score, and of the sleeves' returns combined
    with equal and with inverse-volatility weights."""
    d = panel.withColumns({n: settle(xsection.composite(c), 9) for n, c in sleeves.items()})
    d = d.withColumn("both", settle(xsection.composite(list(sleeves)), 9))
    long = F.explode(
        F.array(*[F.struct(F.lit(n).alias("book"), F.col(n).alias("s")) for n in [*sleeves, "both"]])
    ).alias("b")
    d = d.select("symbol", "dt", "sector", fwd, long).select("symbol", "dt", "sector", fwd, "b.book", "b.s")
    series = cut(books.book_sector_neutral(d, "s", fwd, q, ["book"], width=width))
    legs = series.filter(F.col("book").isin(*sleeves))
    k = len(sleeves)
    full = legs.groupBy("dt").agg(F.count("ret").alias("_k")).filter(F.col("_k") == k)
    legs = legs.join(full.select("dt"), "dt", "left_semi")
    eq = legs.groupBy("dt").agg(F.avg("ret").alias("ret")).withColumn("book", F.lit("equal"))
    iv = perf.invvol_weights(legs, h, "book").groupBy("dt").agg(
        F.sum(F.col("ret") * F.col("weight")).alias("ret"), F.count("weight").alias("_k")
    )
    iv = iv.filter(F.col("_k") == k).select("dt", "ret", F.lit("invvol").alias("book"))
    every = reduce(DataFrame.unionByName, [series, eq, iv])
    return perf.perf_stats(every, h, ["book"], min_dates=60)


def portfolio_methods(
    panel: DataFrame, score: str, factors, fwd: str, h: int, q: int = 5, width: int | None = None
) -> DataFrame:
    """Four constructions of one score: quintile, signal weight, risk weight, factor neutral."""
    d = panel.filter(F.col(score).isNotNull() & F.col(fwd).isNotNull() & F.col("half_bps").isNotNull())
    d = d.select("symbol", "dt", "sector", fwd, "half_bps", "vol63", score, *factors)
    # stored by the regression; the four constructions read it from there
    d = xsection.residualize(d, score, factors, out="neutral_score", min_names=30, need_share=0.5, width=width)
    parts = []
    for name, col, method in (
        ("A quintile", score, "quintile"), ("B signal", score, "signal"), ("C risk", score, "risk"),
        ("D neutral", "neutral_score", "neutral"),
    ):
        w = books.sector_weights(d.filter(F.col(col).isNotNull()), col, method, q, width=width)
        b = books.book_by_sector_weights(w, fwd)
        parts.append(b.select(F.lit(name).alias("method"), "dt", F.col("net").alias("ret")))
    return perf.perf_stats(reduce(DataFrame.unionByName, parts), h, ["method"])


def materiality(resolved: DataFrame, bars: DataFrame, facts: DataFrame, excess: DataFrame) -> DataFrame:
    """Monthly awards of a company over its market value known then, with the following
    excess return: (symbol, month, award_over_mcap, fwd_21)."""
    month = lambda c: F.date_format(c, "yyyy-MM").alias("month")
    m = resolved.filter("ticker is not null").groupBy(F.col("ticker").alias("symbol"), month("action_date")).agg(
        F.sum("amount_usd").alias("award_usd")
    )
    end = bars.groupBy("symbol", month("dt")).agg(F.max_by(F.struct("dt", "close"), "dt").alias("e"))
    m = m.join(end, ["symbol", "month"]).select("symbol", "month", "award_usd", "e.dt", "e.close")
    m = fundamentals.pit_mcap(m, fundamentals.pit_shares(facts))
    m = m.withColumn("award_over_mcap", F.try_divide("award_usd", "mcap"))
    return m.join(excess.select("symbol", "dt", "fwd_21"), ["symbol", "dt"]).filter(
        "award_over_mcap is not null and fwd_21 is not null"
    )


def materiality_table(m: DataFrame, q: int = 5) -> DataFrame:
    """Excess return by quintile of award size over market value; `spread` is the top quintile's mean less the bottom's."""
    d = m.select(F.lit(1).alias("_all"), F.concat("symbol", "month").alias("key"), "award_over_mcap", "fwd_21")
    d = xsection.with_bucket(d, ["_all"], "award_over_mcap", q, tie="key")
    g = d.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("award_over_mcap").alias("lo"),
        F.median("award_over_mcap").alias("median"),
        F.max("award_over_mcap").alias("hi"),
        F.avg("fwd_21").alias("mean_fwd"),
        F.try_divide(F.avg("fwd_21"), F.stddev_samp("fwd_21") / F.sqrt(F.count(F.lit(1)))).alias("t"),
    )
    g = cut(g)
    ends = g.agg((F.max_by("mean_fwd", "bucket") - F.min_by("mean_fwd", "bucket")).alias("spread"))
    return g.withColumn("_j", F.lit(1)).join(ends.withColumn("_j", F.lit(1)), "_j").drop("_j")


def materiality_corr(m: DataFrame) -> DataFrame:
    d = m.select(F.lit(1).alias("_all"), "award_over_mcap", "fwd_21")
    d = ranking.average_rank(d, ["_all"], "award_over_mcap", "_a")
    d = ranking.average_rank(d, ["_all"], "fwd_21", "_b")
    return d.agg(F.count(F.lit(1)).alias("n"), F.corr("_a", "_b").alias("spearman"))


def validation_table(series: DataFrame, baseline: str, reps: int = 5000, mean_block: float = 10, horizon: int = 5) -> DataFrame:
    """One row per strategy, all on the dates that every strategy has: mean and annualised net return, bootstrap
    interval and p against zero, excess over the baseline with its interval, raw, Bonferroni and BH p.

    The baseline has no excess: its columns are null.  `series` has (strategy, dt, ret).
    """
    s = cut(perf.align_common_dates(series).filter("ret is not null"))
    span = s.groupBy("strategy").agg(F.count(F.lit(1)).alias("dates"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
    zero = inference.boot_mean_ci(s, reps, mean_block).select("strategy", "mean", "lo", "hi", F.col("p").alias("p_vs_zero"))
    zero = zero.withColumn("annual", F.pow(1 + F.col("mean"), F.lit(TRADING_DAYS / horizon)) - 1)
    pair = cut(inference.boot_paired_p(s, baseline, reps, mean_block))
    excess = pair.select("strategy", "excess", F.col("lo").alias("excess_lo"), F.col("hi").alias("excess_hi"))
    adjusted = inference.p_adjust(pair.select("strategy", "p_raw"))
    return span.join(zero, "strategy").join(excess, "strategy", "left").join(adjusted, "strategy", "left")
