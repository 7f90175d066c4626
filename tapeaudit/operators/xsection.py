"""Cross-section of one date (and sector): z-scores, buckets, rank correlation,
regression residuals.

Group statistics are aggregated map-side and joined back.  Ranks take `width`,
an upper bound on the names of one date; see ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cut, lagged
from . import ranking


def zscore(df: DataFrame, by, cols, prefix: str = "z_", width: int | None = None) -> DataFrame:
    """(x - mean) / sample deviation inside each group; null when there is no spread."""
    cols = list(cols)
    aggs = {"_m_" + c: F.avg(c) for c in cols} | {"_s_" + c: F.stddev_samp(c) for c in cols}
    d = ranking.group_join(df, by, width, **aggs)
    z = [F.try_divide(F.col(c) - F.col("_m_" + c), F.col("_s_" + c)).alias(prefix + c) for c in cols]
    keep = [c for c in df.columns if prefix + c not in df.columns and c not in {prefix + x for x in cols}]
    return d.select(*keep, *z)


def composite(cols, signs=None, skip_null: bool = True) -> Column:
    """Row mean of signed columns; without `skip_null`, one null makes the mean null."""
    cols = list(cols)
    signed = [F.col(c) * (signs or {}).get(c, 1) for c in cols]
    if not skip_null:
        return sum(signed[1:], signed[0]) / len(cols)
    total = sum((F.coalesce(c, F.lit(0.0)) for c in signed[1:]), F.coalesce(signed[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in signed[1:]), signed[0].isNotNull().cast("int"))
    return F.try_divide(total, n)


def adaptive_q(q: int, n: str = "_n") -> Column:
    """Fewer buckets in a small group: min(q, max(2, n // 5))."""
    return F.least(F.lit(q), F.greatest(F.lit(2), F.floor(F.col(n) / 5))).cast("bigint")


def with_bucket(
    df: DataFrame, by, score: str, q: int, adaptive: bool = False, min_names: int = 2,
    tie: str = "symbol", out: str = "bucket", width: int | None = None,
) -> DataFrame:
    """Equal-count buckets from 0 by (score, tie), as quantile cuts of the positions.

    Position r of n gets max(ceil((r - 1) q / (n - 1)), 1) - 1.  Adds also
    `top_bucket`, the highest bucket of the group.  Small groups drop out.
    """
    d = ranking.row_numbers(df.filter(F.col(score).isNotNull()), by, score, tie, "_r", "_n", width)
    d = d.filter(F.col("_n") >= max(2, min_names))
    d = d.withColumn("_q", adaptive_q(q) if adaptive else F.lit(q).cast("bigint"))

    def cut(r):
        step = F.floor(((r - 1) * F.col("_q") + F.col("_n") - 2) / (F.col("_n") - 1))
        return (F.greatest(step, F.lit(1)) - 1).cast("int")

    return d.withColumn(out, cut(F.col("_r"))).withColumn("top_bucket", cut(F.col("_n"))).drop("_r", "_n", "_q")


def rank_ic(
    df: DataFrame, score: str, fwd: str, by=("dt",), min_names: int = 50, width: int | None = None
) -> DataFrame:
    """Per date: correlation of average ranks of score and forward return."""
    by = list(by)
    d = df.filter(F.col(score).isNotNull() & F.col(fwd).isNotNull()).select(*by, score, fwd)
    d = ranking.average_rank(d, by, score, "_a", width)
    d = ranking.average_rank(d, by, fwd, "_b", width)
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("names"),
        F.corr("_a", "_b").alias("ic"),
        F.stddev_pop("_a").alias("_sa"),
        F.stddev_pop("_b").alias("_sb"),
    )
    g = g.filter(F.col("names") >= min_names)
    return g.withColumn("ic", F.when((F.col("_sa") > 0) & (F.col("_sb") > 0), F.col("ic"))).drop("_sa", "_sb")


def quantile_spread(
    df: DataFrame, score: str, fwd: str, q: int = 10, by=("dt",), cost: float = 0.0028,
    min_names: int = 50, width: int | None = None,
) -> DataFrame:
    """Per date: mean forward return of the top bucket minus the bottom one, less both round trips."""
    d = df.filter(F.col(fwd).isNotNull())
    d = with_bucket(d, by, score, q, min_names=min_names, width=width)
    g = d.groupBy(*by).agg(
        F.avg(F.when(F.col("bucket") == q - 1, F.col(fwd))).alias("_t"),
        F.avg(F.when(F.col("bucket") == 0, F.col(fwd))).alias("_b"),
    )
    return g.select(*by, (F.col("_t") - F.col("_b") - cost).alias("ret")).filter("ret is not null")


def score_autocorr(df: DataFrame, score: str, h: int, by=(), min_pairs: int = 1000) -> DataFrame:
    """Pooled correlation of a score with itself h rows earlier in the symbol."""
    by = list(by)
    d = df.select(*by, F.col(score).alias("_v"), lagged(score, h, by=[*by, "symbol"]).alias("_l"))
    d = d.filter("_v is not null and _l is not null")
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.corr("_v", "_l").alias("rho"))
    return g.withColumn("rho", F.when(F.col("pairs") >= min_pairs, F.col("rho")))


# ------------------------------------------------------------------- regression
def _solve(moments: DataFrame, k: int) -> DataFrame:
    """Normal equations of every group by elimination, in columns b0..b{k-1}.

    The table has one row per group; column a_i_j holds the centred cross moment,
    a_i_k the moment with the target.  A factor without spread left is skipped.
    """
    m = moments.withColumns({f"_d{i}": F.col(f"a_{i}_{i}") for i in range(k)})
    for p in range(k):
        live = F.col(f"a_{p}_{p}") > F.lit(1e-10) * F.col(f"_d{p}")
        inv = F.when(live, 1.0 / F.when(live, F.col(f"a_{p}_{p}")).otherwise(1.0)).otherwise(0.0)
        m = m.withColumn("_inv", inv)
        step = {}
        for i in range(k):
            for j in range(p, k + 1):
                row = F.col(f"a_{p}_{j}") * F.col("_inv")
                step[f"a_{i}_{j}"] = row if i == p else F.col(f"a_{i}_{j}") - F.col(f"a_{i}_{p}") * row
        m = m.withColumns(step)
    return m.withColumns({f"b{i}": F.col(f"a_{i}_{k}") for i in range(k)})


def residualize(
    df: DataFrame, score: str, factors, by=("dt",), sector: str | None = None, out: str = "resid",
    min_names: int = 30, need_share: float | None = None, width: int | None = None,
) -> DataFrame:
    """Residual of a per-group regression of the score on the factors and an intercept.

    With `sector`, also on sector indicators: centring inside (group, sector) does
    the same.  Only complete rows take part, the others get null.  With
    `need_share`, a factor present on at most that share of a group's rows is left
    out of that group.  Counts, means and cross moments are summed map-side, so a group
    of any size is one row of each; these are stored and joined back, and rows are not
    shuffled: `width` changes nothing.
    """
    by, factors, k = list(by), list(factors), len(list(factors))
    d = cut(df)
    if need_share is None:
        use = [F.lit(True)] * k
    else:
        counts = d.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *[F.count(f).alias(f"_c{i}") for i, f in enumerate(factors)])
        d = ranking.join_on(d, cut(counts), by)
        use = [F.col(f"_c{i}") > F.col("_rows") * need_share for i in range(k)]
    some = use[0]
    ok = F.col(score).isNotNull()
    for u, f in zip(use, factors):
        some = some | u
        ok = ok & (~u | F.col(f).isNotNull())
    d = d.withColumns({f"_x{i}": F.when(use[i], F.col(f)).otherwise(0.0) for i, f in enumerate(factors)})
    d = d.withColumn("_ok", ok & some)
    cell = [*by, sector] if sector else by
    mean = lambda c, name: F.avg(F.when(F.col("_ok"), F.col(c))).alias(name)
    xs = [f"_x{i}" for i in range(k)]
    means = d.groupBy(*cell).agg(mean(score, "_my"), *[mean(x, "_m" + x) for x in xs])
    d = ranking.join_on(d, cut(means), cell)
    d = d.withColumns({x: F.when(F.col("_ok"), F.col(x) - F.col("_m" + x)) for x in xs})
    d = d.withColumn("_y", F.when(F.col("_ok"), F.col(score) - F.col("_my")))
    cols = [*xs, "_y"]
    sums = {f"a_{i}_{j}": F.sum(F.col(xs[i]) * F.col(cols[j])) for i in range(k) for j in range(i, k + 1)}
    sums["_n"] = F.count("_y")
    mirror = {f"a_{j}_{i}": F.col(f"a_{i}_{j}") for i in range(k) for j in range(i + 1, k)}
    moments = d.filter("_ok").groupBy(*by).agg(*[a.alias(n) for n, a in sums.items()])
    moments = moments.filter(F.col("_n") >= min_names).withColumns(mirror)
    d = ranking.join_on(d, cut(_solve(moments, k).select(*by, *[f"b{i}" for i in range(k)])), by)
    fitted = sum((F.col(f"b{i}") * F.col(x) for i, x in enumerate(xs[1:], 1)), F.col("b0") * F.col(xs[0]))
    return d.select(*df.columns, (F.col("_y") - fitted).alias(out))


def resid_r2(df: DataFrame, score: str, resid: str = "resid", by=("signal",)) -> DataFrame:
    """Share of a score's variance that the regression removed."""
    d = df.filter(F.col(score).isNotNull() & F.col(resid).isNotNull())
    g = d.groupBy(*by).agg(F.var_pop(score).alias("var_before"), F.var_pop(resid).alias("var_after"))
    return g.withColumn(
        "r2_removed", F.when(F.col("var_before") > 0, 1 - F.col("var_after") / F.col("var_before"))
    ).withColumn("resid_std", F.sqrt("var_after"))


def to_long(df: DataFrame, cols, keep, name: str = "signal", value: str = "score") -> DataFrame:
    """Signals as rows: the loop over signals becomes a group key."""
    return df.select(*keep, *cols).unpivot(list(keep), list(cols), name, value)
