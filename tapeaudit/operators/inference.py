"""Resampling tests, multiple-comparison control and luck-adjusted Sharpe ratios."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TRADING_DAYS
from ..functions import below, bound, cut, norm_cdf, norm_ppf, uniform
from . import perf, ranking

EULER = 0.5772156649015329


def indexed(series: DataFrame, by=("strategy",), order: str = "dt") -> DataFrame:
    """Adds pos (0-based position by date) and n_obs; a series has one row per date."""
    w = Window.partitionBy(*by)
    return series.withColumn("pos", (F.row_number().over(w.orderBy(order)) - 1).cast("bigint")).withColumn(
        "n_obs", F.count(F.lit(1)).over(w)
    )


def stationary_draws(sizes: DataFrame, by, reps: int, mean_block: float, n: str = "n_obs") -> DataFrame:
    """(by..., rep, t, pos): resampled positions in blocks of geometric length, wrapping round.

    `sizes` has one row per group with its length.  At every step a hash of
    (replicate, step) decides whether a new block starts; the block's first
    position is another part of the same hash.  Replicates are spread over the
    cluster before the steps are generated, so the running block needs no shuffle.
    Shared positions across groups of one length make a joint resample.
    """
    by = list(by)
    d = sizes.select(*by, F.col(n).alias("_n"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    d = d.repartition(*by, "rep")
    d = d.withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    new = (F.col("t") == 0) | below(bound(F.lit(1.0 / mean_block)), F.lit("cut"), "rep", "t")
    start = F.floor(uniform(F.lit("start"), "rep", "t") * F.col("_n"))
    w = Window.partitionBy(*by, "rep").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    block = F.last(F.when(new, F.struct("t", start.alias("s"))), ignorenulls=True).over(w)
    d = d.withColumn("_b", block)
    return d.select(*by, "rep", "t", ((F.col("_b.s") + F.col("t") - F.col("_b.t")) % F.col("_n")).alias("pos"))


#: Series are broadcast to the blocks up to so many bytes; beyond that they meet in SALTS groups of replicates.
SERIES_BYTES, SALTS = 64 << 20, 64


def resample_blocks(lengths: DataFrame, reps: int) -> DataFrame:
    """(block, rep, t, u, next): the blocks of `reps` stationary resamples, per mean block length `block`.

    `lengths` has block and most, the longest series that is resampled with it. A block begins at step t and ends
    before step next (null for the last); u places it in a series of any length. These are the blocks of
    `stationary_draws`: one row for about `block` draws, whatever the number of series.
    """
    d = lengths.select("block", bound(1.0 / F.col("block")).alias("p"), "most", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).repartition("block", "rep")
    d = d.select("block", "p", "rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("most") - 1)).alias("t"))
    starts = d.filter((F.col("t") == 0) | below(F.col("p"), F.lit("cut"), "rep", "t"))
    after = F.lead("t").over(Window.partitionBy("block", "rep").orderBy("t"))
    return starts.select("block", "rep", "t", uniform(F.lit("start"), "rep", "t").alias("u"), after.alias("next"))


def resampled_means(series: DataFrame, reps: int, block: Column, by, ret: str = "ret") -> DataFrame:
    """(by..., rep, boot): the mean of each resample of each series; series of one block length and size are resampled
    jointly. `block` is the mean block length, from the columns `by`.

    A block's sum is the difference of two prefix sums, so a replicate costs its blocks, not its draws.
    """
    by = list(by)
    s = indexed(series.filter(F.col(ret).isNotNull()), by)
    upto = F.sum(ret).over(Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    sums = s.select(*by, "n_obs", F.struct("pos", upto.alias("v")).alias("p")).groupBy(*by, "n_obs").agg(F.sort_array(F.collect_list("p"))["v"].alias("sums"))
    sums = cut(sums.select(*by, "n_obs", F.concat(F.array(F.lit(0.0)), "sums").alias("sums"), block.cast("double").alias("block")))
    size = sums.agg(F.sum(8 * F.col("n_obs"))).first()[0] or 0
    blocks = resample_blocks(sums.groupBy("block").agg(F.max("n_obs").alias("most")), reps)
    if size <= SERIES_BYTES:
        met = blocks.join(F.broadcast(sums), "block")
    else:
        salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = blocks.withColumn("_salt", F.col("rep") % SALTS).join(salted, ["block", "_salt"])
    n = F.col("n_obs")
    met = met.filter(F.col("t") < n).withColumns({
        "a": F.floor(F.col("u") * n).cast("int"), "b": (F.floor(F.col("u") * n) + F.least(F.coalesce("next", n), n) - F.col("t")).cast("int"),
    })
    at = lambda i: F.get("sums", i)
    wrapped = at(n.cast("int")) - at(F.col("a")) + at(F.col("b") - n.cast("int"))
    part = F.when(F.col("b") <= n, at(F.col("b")) - at(F.col("a"))).otherwise(wrapped)
    return met.groupBy(*by, "rep").agg((F.sum(part) / F.first("n_obs")).alias("boot"))


def boot_means(series: DataFrame, reps: int, mean_block: float, by=("strategy",), ret: str = "ret") -> DataFrame:
    """(by..., rep, boot): mean of each resample."""
    return resampled_means(series, reps, F.lit(float(mean_block)), by, ret)


def boot_mean_ci(
    series: DataFrame, reps: int = 5000, mean_block: float = 10, by=("strategy",), conf: float = 0.95
) -> DataFrame:
    """Mean, bootstrap error, percentile interval and two-sided p against zero."""
    by = list(by)
    est = series.filter("ret is not null").groupBy(*by).agg(F.avg("ret").alias("mean"))
    a = (1 - conf) / 2
    b = ranking.join_on(boot_means(series, reps, mean_block, by), est, by, "inner")
    return b.groupBy(*by).agg(
        F.first("mean").alias("mean"),
        F.stddev_samp("boot").alias("se"),
        F.percentile("boot", F.lit(a)).alias("lo"),
        F.percentile("boot", F.lit(1 - a)).alias("hi"),
        F.avg((F.abs(F.col("boot") - F.col("mean")) >= F.abs("mean")).cast("int")).alias("p"),
    )


def excess_over(series: DataFrame, baseline: str, strategy: str = "strategy") -> DataFrame:
    """Difference to the baseline strategy on the dates both have."""
    b = series.filter(F.col(strategy) == baseline).select("dt", F.col("ret").alias("_b"))
    d = series.filter(F.col(strategy) != baseline).join(b, "dt")
    return d.withColumn("ret", F.col("ret") - F.col("_b")).drop("_b").filter("ret is not null")


def boot_paired_p(series: DataFrame, baseline: str, reps: int = 5000, mean_block: float = 10) -> DataFrame:
    """Mean excess over the baseline, interval, and p under the null of no difference."""
    c = boot_mean_ci(cut(excess_over(cut(series), baseline)), reps, mean_block)
    return c.select("strategy", F.col("mean").alias("excess"), "lo", "hi", F.col("p").alias("p_raw"))


def reality_check(series: DataFrame, baseline: str, reps: int = 5000, mean_block: float = 10) -> DataFrame:
    """Null distribution of the best excess over all strategies, resampled jointly by date."""
    d = cut(excess_over(perf.align_common_dates(cut(series)), baseline))
    mean = d.groupBy("strategy").agg(F.avg("ret").alias("_m"))
    d = cut(d.join(mean, "strategy").withColumn("c", F.col("ret") - F.col("_m")))
    boot = boot_means(d, reps, mean_block, ret="c").withColumnRenamed("boot", "b")
    best = boot.groupBy("rep").agg(F.max("b").alias("b")).withColumn("_j", F.lit(1))
    obs = mean.agg(F.max("_m").alias("best_excess"), F.count(F.lit(1)).alias("n_strategies")).withColumn("_j", F.lit(1))
    size = d.groupBy("strategy").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n_dates")).withColumn("_j", F.lit(1))
    j = best.join(obs, "_j").join(size, "_j")
    return j.groupBy("best_excess", "n_strategies", "n_dates").agg(
        F.avg((F.col("b") >= F.col("best_excess")).cast("int")).alias("reality_check_p"),
        F.count(F.lit(1)).alias("bootstrap_reps"),
    )


def p_adjust(tests: DataFrame, p: str = "p_raw", key: str = "strategy", alpha: float = 0.05) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg adjusted p values.

    The step-up minimum runs from the largest p down; equal p values share it, so
    it is taken per distinct p with the counts at or below it.
    """
    t = tests.filter(F.col(p).isNotNull()).withColumn("_all", F.lit(1))
    v = ranking.value_counts(t, ["_all"], p)
    bh = F.col(p) * F.col("n") / (F.col("less") + F.col("ties"))
    v = ranking.in_pieces(v.withColumn("_bh", bh), [p])
    # running minimum over the pieces above, then inside the piece
    pieces = v.groupBy("_piece").agg(F.min("_bh").alias("_mb"))
    up = Window.orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_piece", F.min("_mb").over(up).alias("_above"))
    inside = Window.partitionBy("_piece").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    v = v.join(pieces, "_piece").withColumn(
        "_q", F.least(F.min("_bh").over(inside), F.coalesce("_above", F.lit(1.0)), F.lit(1.0))
    )
    d = t.join(v.select(p, "n", "_q"), p)
    return d.select(
        *[c for c in tests.columns],
        F.least(F.lit(1.0), F.col(p) * F.col("n")).alias("p_bonferroni"),
        F.col("_q").alias("p_bh"),
        (F.col("_q") < alpha).cast("int").alias("passes_bh"),
    )


# -------------------------------------------------------------- luck adjustment
def expected_max_z(trials: Column) -> Column:
    """Expected best of n standard normal draws (zero for one trial)."""
    n = F.greatest(F.lit(1), trials.cast("bigint"))
    z = (1 - EULER) * norm_ppf(1 - 1.0 / n) + EULER * norm_ppf(1 - 1.0 / (n * math.e))
    return F.when(n == 1, F.lit(0.0)).otherwise(z)


def expected_max_sharpe(trials: Column, n_obs: Column, per_year: float = TRADING_DAYS / 5) -> Column:
    """Annual Sharpe ratio that the best of `trials` useless strategies would show."""
    se = 1.0 / F.sqrt(F.greatest(F.lit(2), n_obs).cast("double"))
    return expected_max_z(trials) * se * per_year**0.5


def deflated_sharpe(
    sharpe: Column, trials: Column, n_obs: Column, skew=0.0, kurtosis=3.0, per_year: float = TRADING_DAYS / 5
) -> Column:
    """Probability that the Sharpe ratio beats the luck bar of its own number of observations."""
    col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    sr = sharpe / per_year**0.5
    sr0 = expected_max_sharpe(trials, n_obs, per_year) / per_year**0.5
    n = F.greatest(F.lit(2), n_obs)
    den = F.sqrt(F.greatest(F.lit(1e-12), 1 - col(skew) * sr + (col(kurtosis) - 1) / 4 * sr * sr))
    return norm_cdf((sr - sr0) * F.sqrt((n - 1).cast("double")) / den)


# ------------------------------------------------------------ independent bets
def participation_ratio(
    returns: DataFrame, by=(), symbol: str = "symbol", date: str = "dt", ret: str = "ret"
) -> DataFrame:
    """Effective number of independent series: N squared over the sum of squared correlations.

    Only series present on every date take part.  The sum over all pairs of series
    equals the squared norm of the date-by-date product matrix, so the cost grows
    with the number of series, not with its square: every task adds its series to
    one matrix of sessions x sessions, and the rows of those are summed.
    """
    by = list(by) or ["_all"]
    d = returns.withColumn("_all", F.lit(1)) if by == ["_all"] else returns
    d = cut(d.filter(F.col(ret).isNotNull()).select(*by, symbol, date, ret))
    dates = d.groupBy(*by).agg(F.countDistinct(date).alias("_t"))
    rows = d.groupBy(*by, symbol).agg(
        F.sort_array(F.collect_list(F.struct(date, ret))).alias("_v"), F.count(F.lit(1)).alias("_n")
    )
    rows = cut(ranking.join_on(rows, dates, by, "inner").filter(F.col("_n") == F.col("_t")))
    rows = rows.select(F.to_json(F.struct(*by)).alias("_g"), *by, F.transform("_v", lambda x: x[ret]).alias("_v"))
    groups = rows.groupBy("_g", *by).agg(F.count(F.lit(1)).alias("n_names"), F.max(F.size("_v")).alias("n_dates"))
    norm = _product_rows(rows).groupBy("_g").agg(F.sum(_squares("_s")).alias("sum_sq_corr"))
    out = groups.join(norm, "_g").withColumn(
        "n_eff", F.try_divide(F.col("n_names") * F.col("n_names"), F.col("sum_sq_corr"))
    )
    return out.drop("_g", "_all")


def _squares(vector: str) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)


def _sum_vectors(parts: DataFrame, keys, vector: str) -> DataFrame:
    """Element-wise sums of an array column per group, combined map-side."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    total = parts.groupBy(*keys).agg(Summarizer.sum(array_to_vector(vector)).alias("_s"))
    return total.withColumn("_s", vector_to_array("_s"))


def _product_rows(rows: DataFrame) -> DataFrame:
    """(_g, _i, _s): row _i of the date-by-date product matrix of the series `_v` of each group `_g`.

    A task keeps one matrix of sessions x sessions per group it meets: 51 MB for ten years of daily returns.
    """
    import numpy as np
    import pandas as pd

    def products(batches):
        sums = {}
        for pdf in batches:
            for g, part in pdf.groupby("_g"):
                z = np.vstack(part["_v"].to_numpy())
                z = z - z.mean(axis=1, keepdims=True)
                norm = np.sqrt((z * z).sum(axis=1, keepdims=True))
                z = np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)
                sums[g] = sums.get(g, 0.0) + z.T @ z
        for g, m in sums.items():
            yield pd.DataFrame({"_g": g, "_i": range(len(m)), "_row": list(m)})

    part = rows.select("_g", "_v").mapInPandas(products, "_g string, _i int, _row array<double>")
    return _sum_vectors(part, ["_g", "_i"], "_row")


def breadth_curve(
    returns: DataFrame, sizes=(50, 100, 200, 400, 800), sector: str = "sector", width: int | None = None
) -> DataFrame:
    """Effective bets for growing sets of names, raw and after removing the sector mean of the date.

    The sets are nested, so a name enters one product matrix only, that of the smallest set which holds it; the matrix
    of a set is the sum of those up to it.
    """
    d = returns.filter("ret is not null")
    d = ranking.group_join(d, ["dt", sector], width, _m=F.avg("ret"))
    d = cut(d.select("symbol", "dt", "ret", (F.col("ret") - F.col("_m")).alias("_r")))
    days = d.agg(F.countDistinct("dt").alias("_d")).withColumn("_j", F.lit(1))
    names = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).withColumn("_j", F.lit(1)).join(days, "_j")
    names = names.filter("_n = _d").select("symbol", F.lit(1).alias("_a"), uniform(F.lit("pick"), "symbol").alias("_u"))
    names = ranking.row_numbers(names, ["_a"], "_u", "symbol", "_pos", "_all")
    size = F.array_distinct(F.array(*[F.least(F.lit(int(n)), F.col("_all")).cast("bigint") for n in sizes], F.col("_all")))
    names = names.select("symbol", F.filter(size, lambda n: n >= F.col("_pos")).alias("_sets"))
    names = cut(names.withColumn("_g", F.array_min("_sets").cast("string")))
    kind = F.explode(
        F.array(F.struct(F.lit("raw").alias("kind"), F.col("ret").alias("v")), F.struct(F.lit("neutral").alias("kind"), F.col("_r").alias("v")))
    )
    long = d.join(names.select("symbol", "_g"), "symbol").select("_g", "symbol", "dt", kind.alias("k"))
    rows = long.groupBy("_g", "k.kind", "symbol").agg(F.sort_array(F.collect_list(F.struct("dt", "k.v"))).alias("_v"))
    rows = rows.select(F.concat_ws("|", "_g", "kind").alias("_g"), F.transform("_v", lambda x: x["v"]).alias("_v"))
    steps = _product_rows(rows).select(F.split("_g", "[|]").alias("_k"), "_i", F.col("_s").alias("_row"))
    steps = steps.select(F.col("_k")[0].alias("_g"), F.col("_k")[1].alias("kind"), "_i", "_row")
    into = names.groupBy("_g").agg(F.first("_sets").alias("_sets")).select("_g", F.explode("_sets").alias("n"))
    total = _sum_vectors(steps.join(into, "_g"), ["n", "kind", "_i"], "_row")
    out = total.groupBy("n", "kind").agg(F.count(F.lit(1)).cast("int").alias("n_dates"), F.sum(_squares("_s")).alias("sum_sq_corr"))
    return out.select("n", "kind", F.col("n").alias("n_names"), "n_dates", "sum_sq_corr", F.try_divide(F.col("n") * F.col("n"), F.col("sum_sq_corr")).alias("n_eff"))


def avg_cross_corr(series: DataFrame, groups: DataFrame, name: str = "strategy") -> DataFrame:
    """Mean and largest absolute correlation between books of different groups.

    Books are a short list (signals), one row per date each.
    """
    s = series.join(groups, name)
    a = s.select(F.col(name).alias("a"), F.col("grp").alias("ga"), "dt", F.col("ret").alias("x"))
    b = s.select(F.col(name).alias("b"), F.col("grp").alias("gb"), "dt", F.col("ret").alias("y"))
    pair = a.join(b, "dt").filter("ga < gb").groupBy("ga", "gb", "a", "b").agg(F.corr("x", "y").alias("rho"))
    return pair.groupBy("ga", "gb").agg(
        F.count("rho").alias("pairs"), F.avg("rho").alias("mean_corr"), F.max(F.abs("rho")).alias("max_abs_corr")
    )


def effective_books(series: DataFrame, sets: dict[str, list[str]], book: str = "strategy", min_dates: int = 60) -> DataFrame:
    """Per set of books: how many there are, how many they amount to, and their mean correlation.

    Books with fewer than `min_dates` returns are left out, and the others are compared on the dates that all of a set
    have; a set of one book has no effective count.  The mean correlation comes from the variance of the sum of the
    standardised books, so no pair of books is formed.
    """
    d = cut(series.filter("ret is not null").select(book, "dt", "ret"))
    long = d.groupBy(book).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_dates)
    member = F.create_map(*[x for s, names in sets.items() for x in (F.lit(s), F.array(*[F.lit(n) for n in names]))])
    long = long.select(book, F.explode(member).alias("set", "_in")).filter(F.array_contains("_in", F.col(book))).select("set", book)
    size = long.groupBy("set").agg(F.count(F.lit(1)).alias("nominal"))
    e = d.join(long, book)
    whole = e.groupBy("set", "dt").agg(F.count(F.lit(1)).alias("_k")).join(size, "set").filter("_k = nominal")
    e = cut(e.join(whole.select("set", "dt"), ["set", "dt"]))
    n_eff = participation_ratio(e, ["set"], symbol=book).select("set", "n_dates", "n_eff")
    shape = e.groupBy("set", book).agg(F.avg("ret").alias("_m"), F.stddev_pop("ret").alias("_s"), F.count(F.lit(1)).alias("_n"))
    z = e.join(shape, ["set", book]).withColumn("_z", F.try_divide(F.col("ret") - F.col("_m"), F.col("_s") * F.sqrt("_n")))
    both = z.groupBy("set", "dt").agg(F.sum("_z").alias("_z")).groupBy("set").agg(F.sum(F.col("_z") * F.col("_z")).alias("_all"))
    k, several = F.col("nominal"), F.col("nominal") > 1
    return size.join(n_eff, "set", "left").join(both, "set", "left").select(
        "set", "nominal", "n_dates", F.when(several, F.col("n_eff")).alias("n_eff"),
        F.when(several, (F.col("_all") - k) / (k * (k - 1))).alias("mean_corr"),
    )


# ------------------------------------------------------------------- signal zoo
def rule_returns(fired: DataFrame, forward: DataFrame) -> DataFrame:
    """Fired rules with their net forward returns: (symbol, dt, signal, horizon, ret)."""
    return fired.join(forward, ["symbol", "dt"]).filter("ret is not null")


def average_stock(forward: DataFrame) -> DataFrame:
    """The null a rule must beat: mean net forward return of all stocks per date and horizon."""
    return forward.filter("ret is not null").groupBy("horizon", "dt").agg(F.avg("ret").alias("bench"))


def zoo_eval(
    traded: DataFrame, bench: DataFrame, reps: int = 2000, min_trades: int = 50, min_dates: int = 30
) -> DataFrame:
    """Every (rule, horizon) in one job: trades, dates, Sharpe on every h-th date, excess over
    the average stock, its bootstrap p, and the hit rate.  Thin ones keep nulls."""
    by = ["signal", "horizon"]
    # one row per rule, horizon and date from here on
    per = cut(
        traded.groupBy(*by, "dt").agg(
            F.avg("ret").alias("ret"), F.count(F.lit(1)).alias("_c"), F.sum((F.col("ret") > 0).cast("int")).alias("_h")
        )
    )
    size = per.groupBy(*by).agg(F.sum("_c").alias("trades"), (F.sum("_h") / F.sum("_c")).alias("hit_rate"))
    w = Window.partitionBy(*by).orderBy("dt")
    per = per.withColumn("_k", (F.row_number().over(w) - 1) % F.col("horizon") == 0)
    r = F.when(F.col("_k"), F.col("ret"))
    n, s = F.count(r), F.stddev_samp(r)
    stat = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("dates"),
        n.alias("n_nonoverlap"),
        F.when((n > 2) & (s > 0), F.avg(r) / s).alias("_ratio"),
    )
    out = size.join(stat, by)
    ok = (F.col("trades") >= min_trades) & (F.col("dates") >= min_dates)
    out = out.withColumn("sharpe", F.when(ok, F.col("_ratio") * F.sqrt(TRADING_DAYS / F.col("horizon"))))
    good = out.filter(ok).select(*by)
    ex = per.join(bench, ["horizon", "dt"]).join(good, by, "left_semi")
    ex = cut(ex.select(*by, "dt", (F.col("ret") - F.col("bench")).alias("ret")))
    boot = _zoo_boot(ex, by, reps)
    out = out.join(boot, by, "left")
    return out.select(
        *by, "trades", "dates", "n_nonoverlap", "sharpe", "excess", "p",
        F.when(ok, F.col("hit_rate")).alias("hit_rate"),
    )


def _zoo_boot(excess: DataFrame, by, reps: int) -> DataFrame:
    mean = excess.groupBy(*by).agg(F.avg("ret").alias("excess"), F.count(F.lit(1)).alias("n")).filter("n >= 30").drop("n")
    centred = excess.join(mean, by).withColumn("ret", F.col("ret") - F.col("excess"))
    # the mean block is twice the horizon; rules of one horizon and length share their draws
    b = resampled_means(centred, reps, F.greatest(F.lit(2), 2 * F.col("horizon")), by).join(mean, by)
    return b.groupBy(*by).agg(
        F.first("excess").alias("excess"), F.avg((F.abs("boot") >= F.abs("excess")).cast("int")).alias("p")
    )


def zoo_verdict(zoo: DataFrame, trials: DataFrame) -> DataFrame:
    """Own-length luck bar and deflated Sharpe ratio per row.  `trials` is one row, n_trials."""
    z = zoo.filter("sharpe is not null").withColumn("_j", F.lit(1)).join(trials.select("n_trials", F.lit(1).alias("_j")), "_j")
    n = F.greatest(F.lit(3), F.col("n_nonoverlap"))
    z = z.withColumn("bar_own_n", expected_max_sharpe(F.col("n_trials"), n)).withColumn(
        "dsr", deflated_sharpe(F.col("sharpe"), F.col("n_trials"), n)
    )
    clears = (F.col("sharpe") > F.col("bar_own_n")) & (F.col("dsr") > 0.95)
    return z.withColumn("clears", clears.cast("int")).drop("_j")


def zoo_summary(verdict: DataFrame) -> DataFrame:
    """How many rules look significant against how many would by chance."""
    return verdict.agg(
        F.count(F.lit(1)).alias("tested"),
        F.count(F.when(F.col("p") < 0.05, 1)).alias("p_below_05"),
        (F.count(F.lit(1)) * 0.05).alias("expected_by_chance"),
        F.sum("clears").alias("clear_the_bar"),
        F.max("sharpe").alias("best_sharpe"),
    )
