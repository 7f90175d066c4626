"""Walk-forward models with MLlib, their evaluation and feature importance."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TRADING_DAYS
from ..functions import uniform
from . import perf, ranking

# fixed values: column names
FEATURES = (
    "ret_1d", "gap_pct", "range_pct", "dist_sma_20", "dist_sma_50", "dist_sma_200", "rel_volume",
    "dist_52w_high", "dist_52w_low", "atr_pct", "mom_5d", "mom_21d", "mom_63d", "mom_126d", "vol_20_annual",
    "regime_bull", "above_200", "mkt_ret_1d", "mkt_vol_20", "mkt_dist_sma_200", "mkt_regime_bull",
    "mom_21d_xs_rank", "rel_volume_xs_rank", "vol_20_xs_rank",
)
TARGET, RET = "label_win_5d", "fwd_ret_5d_net"
# boosting goes on while the held-out loss falls by more than this share; MLlib's own 1 % ends at the first slow round
VALIDATION_TOL = 1e-7
KEEP = ("symbol", "dt", "fold_id")


def baseline_always_long(rows: DataFrame) -> DataFrame:
    return rows.withColumn("y_prob", F.lit(0.51)).withColumn("model_name", F.lit("always_long"))


def baseline_momentum_rule(rows: DataFrame) -> DataFrame:
    fires = (F.col("mom_21d") > 0) & (F.col("above_200") == 1)
    return rows.withColumn("y_prob", F.when(fires, 0.60).otherwise(0.40)).withColumn(
        "model_name", F.lit("momentum_rule")
    )


def _numeric(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("double") for c in [*FEATURES, TARGET]})


def logistic_pipeline(n_rows: int, c: float = 0.1, features=FEATURES):
    """Median imputation, scaling and L2 logistic regression; statistics from training rows only."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    f = list(features)
    imp = [x + "_i" for x in f]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=f, outputCols=imp),
            VectorAssembler(inputCols=imp, outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True),
            LogisticRegression(
                featuresCol="x", labelCol=TARGET, regParam=1.0 / (c * max(1, n_rows)), standardization=False, maxIter=100
            ),
        ]
    )


def gbt_pipeline(seed: int, rounds: int = 300, features=FEATURES, checkpoint_every: int = 10):
    """Boosted trees of depth 4, at most `rounds`, stopped early by the loss on a hashed 15 % of the training rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    f = list(features)
    imp = [x + "_i" for x in f]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=f, outputCols=imp),
            VectorAssembler(inputCols=imp, outputCol="x"),
            GBTClassifier(
                featuresCol="x", labelCol=TARGET, maxIter=rounds, maxDepth=4, stepSize=0.05, minInstancesPerNode=200,
                validationIndicatorCol="is_val", validationTol=VALIDATION_TOL, seed=seed, cacheNodeIds=False, checkpointInterval=checkpoint_every,
            ),
        ]
    )


def _train_rows(train: DataFrame) -> DataFrame:
    return _numeric(train).withColumn("is_val", uniform(F.lit("val"), "symbol", "dt") < 0.15)


def fit(name: str, train: DataFrame, seed: int = 20260101, rounds: int = 300):
    t = _train_rows(train)
    if name == "logistic":
        return logistic_pipeline(t.count()).fit(t)
    if name == "gbm":
        return gbt_pipeline(seed, rounds).fit(t)
    raise ValueError(name)


def predict(model, rows: DataFrame, name: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    p = model.transform(_numeric(rows))
    keep = [c for c in rows.columns]
    return p.select(
        *keep, vector_to_array("probability")[1].alias("y_prob"), F.lit(name).alias("model_name")
    )


def walk_forward(
    rows: DataFrame, split: DataFrame, names=("logistic",), seed: int = 20260101, rounds: int = 300, last: int | None = None, at_once: int = 4
) -> DataFrame:
    """Out-of-sample predictions of every fold.  `split` is split_folds(rows, folds), best stored once.

    A fold without training rows has no predictions. The driver reads only the fold numbers (one per test year); fitting and scoring run on the cluster. A fit is
    many small jobs one after another, so `at_once` fits (fold and model) share the cluster.
    """
    ids = sorted(r[0] for r in split.filter("part = 'train'").select("fold_id").distinct().collect())
    ids = ids[-last:] if last else ids
    rules = {"always_long": baseline_always_long, "momentum_rule": baseline_momentum_rule}

    def scored(job):
        i, name = job
        one = split.filter(F.col("fold_id") == i)
        test = one.filter("part = 'test'").drop("part")
        if name in rules:
            return rules[name](test)
        return predict(fit(name, one.filter("part = 'train'"), seed + i, rounds), test, name)

    with ThreadPoolExecutor(at_once) as pool:
        return reduce(DataFrame.unionByName, pool.map(scored, [(i, name) for i in ids for name in names]))


def as_predictions(scored: DataFrame, keep=("symbol", "dt")) -> DataFrame:
    """(model_name, fold_id, columns of `keep`, y_true, y_prob, y_pred)"""
    return scored.select(
        "model_name", "fold_id", *keep, F.col(TARGET).cast("double").alias("y_true"), "y_prob",
        (F.col("y_prob") >= 0.5).cast("int").alias("y_pred"),
    )


def auc(df: DataFrame, by, prob: str = "y_prob", label: str = "y_true") -> DataFrame:
    """Area under the ROC curve per group, from counts per distinct score.

    No group is sorted in one task: scores are counted map-side and the running
    count of negatives is put together from bins.
    """
    by = list(by)
    v = df.groupBy(*by, prob).agg(F.sum(label).alias("_p"), F.sum(1 - F.col(label)).alias("_q"))
    c = ranking.running(v, by, prob, q="_q")
    g = c.groupBy(*by).agg(
        F.sum(F.col("_p") * (F.col("q_less") + F.col("_q") / 2)).alias("_u"),
        F.sum("_p").alias("_np"),
        F.sum("_q").alias("_nq"),
    )
    return g.select(*by, F.try_divide(F.col("_u"), F.col("_np") * F.col("_nq")).alias("auc"))


def model_eval(pred: DataFrame, horizon: int = 5, by=("model_name", "fold_id"), share: float = 0.10, width: int | None = None) -> DataFrame:
    """Classification and selection statistics per model and fold.

    `pred` carries y_true, y_prob, ret (net forward return), symbol and dt.  The best
    tenth of the pooled rows is taken by (probability, date, symbol), then averaged
    per date before any ratio is formed.
    """
    by = list(by)
    y, p = F.col("y_true"), F.col("y_prob")
    base = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("base_rate"),
        F.avg(((p >= 0.5).cast("int") == y).cast("int")).alias("accuracy"),
        F.avg(F.pow(F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)) - y, F.lit(2))).alias("brier"),
        F.avg("ret").alias("all_mean_net_ret"),
        F.countDistinct("dt").alias("dates_available"),
    )
    major = F.when(F.col("base_rate") >= 0.5, F.col("base_rate")).otherwise(1 - F.col("base_rate"))
    base = base.withColumn("accuracy_lift", F.col("accuracy") - major)
    base = base.withColumn("top_n", F.greatest(F.lit(1), F.floor(F.col("n") * share)).cast("bigint"))
    d = pred.withColumn("_v", -p).withColumn("_tie", F.concat_ws("|", "dt", "symbol"))
    d = ranking.row_numbers(d, by, "_v", "_tie", "_r", width=width)
    d = ranking.join_on(d, base.select(*by, "top_n"), by).filter(F.col("_r") <= F.col("top_n"))
    per = d.groupBy(*by, "dt").agg(
        F.avg("ret").alias("ret"), F.count(F.lit(1)).alias("size"), F.sum("ret").alias("_s"),
        F.sum(F.col("ret") * F.col("ret")).alias("_ss"), F.sum(y).alias("_y"),
    )
    o = Window.partitionBy(*by).orderBy(F.desc("size"), "dt")
    per = per.withColumn("_k", perf.nonoverlap_flag(horizon, by)).withColumn("_big", F.row_number().over(o) <= 10)
    r = F.when(F.col("_k"), F.col("ret"))
    n, m, s = F.count(r), F.avg(r), F.stddev_samp(r)
    k = F.sum("size")
    naive_var = (F.sum("_ss") - F.sum("_s") * F.sum("_s") / k) / (k - 1)
    top = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("top_dates"),
        F.median("size").alias("median_picks"),
        F.max("size").alias("max_picks"),
        (F.sum(F.when(F.col("_big"), F.col("size"))) / k).alias("conc_top10"),
        F.avg("ret").alias("top_mean_net_ret"),
        (F.sum("_s") / k).alias("top_mean_naive"),
        (F.sum("_y") / k).alias("top_precision"),
        F.avg((F.col("ret") > 0).cast("int")).alias("pct_dates_positive"),
        n.alias("n_nonoverlap"),
        F.when((n > 2) & (s > 0), m / s * (TRADING_DAYS / horizon) ** 0.5).alias("sharpe_nonoverlap"),
        F.when((n > 2) & (s > 0), m / (s / F.sqrt(n))).alias("t_stat"),
        F.when(naive_var > 0, F.sum("_s") / k / F.sqrt(naive_var) * (TRADING_DAYS / horizon) ** 0.5).alias("sharpe_naive"),
    )
    out = ranking.join_on(ranking.join_on(base, top, by), auc(pred, by), by)
    return out.withColumn("edge_bps", (F.col("top_mean_net_ret") - F.col("all_mean_net_ret")) * 10_000).withColumn(
        "n_effective", F.col("top_dates") / horizon
    )


def pool_folds(fold_metrics: DataFrame) -> DataFrame:
    """Fold averages per model, and in how many folds the selection made money."""
    return fold_metrics.groupBy("model_name").agg(
        F.count("fold_id").alias("folds"),
        F.avg("auc").alias("auc"),
        F.stddev_samp("auc").alias("auc_sd"),
        F.avg("accuracy_lift").alias("lift"),
        F.avg("top_mean_net_ret").alias("top_ret"),
        F.avg("sharpe_nonoverlap").alias("sharpe"),
        F.avg("sharpe_naive").alias("sharpe_naive"),
        F.sum("n_effective").alias("n_eff"),
        F.sum((F.col("top_mean_net_ret") > 0).cast("int")).cast("bigint").alias("folds_positive"),
    )


def permutation_importance(model, test: DataFrame, features=FEATURES, reps: int = 3) -> DataFrame:
    """Mean and deviation of the AUC lost when one feature's column is shuffled.

    All (feature, repetition) copies are scored in one job.  The shuffle pairs two
    numberings of the rows, one by key and one by a hash.
    """
    from pyspark.ml.functions import vector_to_array

    features = list(features)
    t = _numeric(test).select("symbol", "dt", TARGET, *features)
    t = t.withColumn("_id", F.concat_ws("|", "symbol", "dt"))
    grid = F.explode(
        F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("rep")) for f in features for i in range(reps)])
    ).alias("g")
    # every copy needs the values of its own column only
    own = F.coalesce(*[F.when(F.col("feature") == f, F.col(f)) for f in features]).alias("v")
    keys = ["feature", "rep"]
    src = t.select("_id", *features, grid).select("_id", "g.*", *features).select("_id", *keys, own)
    src = src.withColumn("_u", uniform("feature", "rep", "_id")).withColumn("_w", uniform(F.lit("row"), "_id"))
    a = ranking.row_numbers(src.select(*keys, "v", "_u", "_id"), keys, "_u", "_id", "_pos").select(*keys, "_pos", "v")
    b = ranking.row_numbers(src.select(*keys, "_w", "_id"), keys, "_w", "_id", "_pos").select(*keys, "_pos", "_id")
    mixed = a.join(b, [*keys, "_pos"]).select(*keys, "_id", "v").join(t, "_id")
    mixed = mixed.withColumns({f: F.when(F.col("feature") == f, F.col("v")).otherwise(F.col(f)) for f in features})
    score = lambda d, by: auc(
        model.transform(d).select(*by, F.col(TARGET).alias("y_true"), vector_to_array("probability")[1].alias("y_prob")), by
    )
    base = score(t.withColumn("_j", F.lit(1)), ["_j"]).withColumnRenamed("auc", "_base")
    drops = score(mixed, keys).withColumn("_j", F.lit(1)).join(base, "_j")
    return drops.groupBy("feature").agg(
        F.avg(F.col("_base") - F.col("auc")).alias("auc_drop"), F.stddev_pop(F.col("_base") - F.col("auc")).alias("auc_drop_sd")
    )


def score_frozen(path: str, rows: DataFrame, cutoff, first_run, name: str = "frozen") -> DataFrame:
    """Score every date after the training cutoff with a saved pipeline; dates from the
    first forward run on are live, the earlier ones hold-out."""
    from pyspark.ml import PipelineModel

    p = predict(PipelineModel.load(path), rows.filter(F.col("dt") > cutoff), name)
    return p.withColumn("stage", F.when(F.col("dt") >= first_run, "live").otherwise("holdout"))


# ------------------------------------------------------------ per-date strategies
def rank_predictions(pred: DataFrame, width: int | None = None) -> DataFrame:
    """Percent rank of the probability and number of candidates per model and date."""
    d = ranking.with_counts(pred, ["model_name", "dt"], "y_prob", width)
    pr = F.when(F.col("n") > 1, F.col("less") / (F.col("n") - 1)).otherwise(0.0)
    return d.withColumn("prob_rank_in_date", pr).withColumnRenamed("n", "candidates_that_date").drop("less", "ties")


def strategy_daily(ranked: DataFrame, cut: float = 0.90) -> DataFrame:
    """One return per model and date: the equal-weight top decile."""
    return ranked.filter(F.col("prob_rank_in_date") >= cut).groupBy("model_name", "dt").agg(
        F.count(F.lit(1)).alias("n_selected"),
        F.avg("fwd_ret_5d_net").alias("ret_net"),
        F.avg("fwd_ret_5d").alias("ret_gross"),
        F.avg("y_true").alias("hit_rate"),
        F.avg("y_prob").alias("mean_prob"),
    )


def baseline_daily(pred: DataFrame, names=("always_long", "momentum_rule")) -> DataFrame:
    """Rule models on their own binary signal; a decile of a two-valued score means nothing."""
    d = pred.filter(F.col("model_name").isin(*names) & (F.col("y_pred") == 1))
    return d.groupBy("model_name", "dt").agg(
        F.count(F.lit(1)).alias("n_selected"),
        F.avg("fwd_ret_5d_net").alias("ret_net"),
        F.avg("fwd_ret_5d").alias("ret_gross"),
        F.avg("y_true").alias("hit_rate"),
    )


def union_strategies(daily: DataFrame, baseline: DataFrame, rankers=("logistic", "gbm")) -> DataFrame:
    cols = ["model_name", "dt", "n_selected", "ret_net", "ret_gross"]
    a = daily.filter(F.col("model_name").isin(*rankers)).select(*cols, F.lit("top_decile").alias("selection"))
    return a.unionByName(baseline.select(*cols, F.lit("rule_signal").alias("selection")))


def fold_summary(ranked: DataFrame, folds: DataFrame, cut: float = 0.90) -> DataFrame:
    d = ranked.filter(F.col("prob_rank_in_date") >= cut).join(
        folds.select("fold_id", "test_start", "test_end"), "fold_id"
    )
    return d.groupBy("model_name", "fold_id", "test_start", "test_end").agg(
        F.countDistinct("dt").alias("trading_dates"),
        F.count(F.lit(1)).alias("selections"),
        F.avg("fwd_ret_5d_net").alias("mean_ret_net"),
        F.avg("y_true").alias("hit_rate"),
    )


def fold_excess(summary: DataFrame, pred: DataFrame, baseline: str = "always_long") -> DataFrame:
    """Mean selected return of each fold minus the mean of all its rows."""
    base = pred.filter(F.col("model_name") == baseline).groupBy("fold_id").agg(
        F.avg("fwd_ret_5d_net").alias("base_ret")
    )
    d = summary.join(base, "fold_id", "left")
    return d.select(
        "model_name", "fold_id", "test_start", ((F.col("mean_ret_net") - F.col("base_ret")) * 100).alias("excess_pct")
    )
