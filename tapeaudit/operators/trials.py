"""Trial registry, hash-chained ledger, lockbox and the forward record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cut
from . import inference
from .ledger import GENESIS, chain_fold


# ------------------------------------------------------------------- hash chain
def chain_append(entries: DataFrame, by, order: str, payload: str = "payload", heads: DataFrame | None = None) -> DataFrame:
    """Chain entries in order inside each `by`, from the chain's head in `heads` (by, seq, entry_hash) if it has one.

    `ledger.Ledger` keeps the heads between batches; see `ledger.chain_fold`.
    """
    by = list(by)
    return chain_fold(entries, by, order, payload, heads).select(*by, order, payload, "prev_hash", "entry_hash")


#: What can be wrong with an entry: it does not point at the one before, or its own hash does not fit.
LINK, BODY = "prev_hash mismatch", "entry_hash mismatch"


def chain_check(ledger: DataFrame, by, order: str = "seq", payload: str = "payload", prev: str = GENESIS) -> DataFrame:
    """Every entry with what is wrong with it (null when sound).

    A stored prev_hash makes entries independent, so the chain is checked by an
    equi-join with the entry before; no long window.
    """
    by = list(by)
    before = ledger.select(*by, (F.col(order) + 1).alias(order), F.col("entry_hash").alias("_was"))
    start = ledger.groupBy(*by).agg(F.min(order).alias("_first"))
    d = ledger.join(before, [*by, order], "left").join(start, by)
    expect = F.when(F.col(order) == F.col("_first"), F.lit(prev)).otherwise(F.col("_was"))
    link = ~F.col("prev_hash").eqNullSafe(expect)
    body = ~F.sha2(F.concat(F.coalesce("prev_hash", F.lit("")), F.coalesce(payload, F.lit("null"))), 256).eqNullSafe(F.col("entry_hash"))
    return d.withColumn("fault", F.when(link, LINK).when(body, BODY)).drop("_was", "_first")


def chain_verify(ledger: DataFrame, by, order: str = "seq", payload: str = "payload") -> DataFrame:
    """Per chain: entries, first bad position and its reason."""
    by = list(by)
    c = chain_check(ledger, by, order, payload)
    bad = F.when(F.col("fault").isNotNull(), F.col(order))
    return c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entries"),
        F.min(bad).alias("first_bad"),
        F.min_by("fault", bad).alias("reason"),
    ).withColumn("ok", F.col("first_bad").isNull().cast("int"))


# --------------------------------------------------------------------- registry
def trial_count(registry: DataFrame) -> DataFrame:
    """One row: trials declared (each variant is one), closed and open.

    Abandoned trials count; that is the point of the registry.
    """
    dec = F.col("kind") == "declare"
    rec, ab = F.col("kind") == "record", F.col("kind") == "abandon"
    last = (
        registry.filter(rec | ab).groupBy("strategy_id").agg(F.max_by("kind", "seq").alias("end"))
    )
    ends = last.agg(
        F.count(F.when(F.col("end") == "record", 1)).alias("recorded"),
        F.count(F.when(F.col("end") == "abandon", 1)).alias("abandoned"),
    ).withColumn("_j", F.lit(1))
    d = registry.agg(
        F.count(F.when(dec, 1)).alias("declared"),
        F.coalesce(F.sum(F.when(dec, F.greatest(F.lit(1), F.coalesce("variants", F.lit(1))))), F.lit(0)).alias("n_trials"),
    ).withColumn("_j", F.lit(1))
    return d.join(ends, "_j").drop("_j").withColumn(
        "open", F.col("declared") - F.col("recorded") - F.col("abandoned")
    )


def trial_status(registry: DataFrame) -> DataFrame:
    """State of every declared trial: open, or how it was last closed."""
    c = registry.filter(F.col("kind").isin("record", "abandon")).groupBy("strategy_id").agg(
        F.max_by(F.struct("kind", "sharpe"), "seq").alias("c")
    )
    d = registry.filter("kind = 'declare'").select("strategy_id", "variants")
    return d.join(c, "strategy_id", "left").select(
        "strategy_id", "variants", F.coalesce("c.kind", F.lit("open")).alias("state"),
        F.when(F.col("c.kind") == "record", F.col("c.sharpe")).alias("sharpe"),
    )


def trial_close_guard(registry: DataFrame) -> DataFrame:
    """Closings that must be rejected: of an undeclared trial, or a second time."""
    close = registry.filter(F.col("kind").isin("record", "abandon"))
    declared = registry.filter("kind = 'declare'").groupBy("strategy_id").agg(F.min("seq").alias("_d"))
    first = close.groupBy("strategy_id").agg(F.min("seq").alias("_f"))
    d = close.join(declared, "strategy_id", "left").join(first, "strategy_id")
    why = F.when(F.col("_d").isNull() | (F.col("_d") > F.col("seq")), "never declared").when(
        F.col("seq") > F.col("_f"), "already closed"
    )
    return d.select("seq", "strategy_id", "kind", why.alias("rejected")).filter("rejected is not null")


# ---------------------------------------------------------------------- lockbox
def lockbox_state(registry: DataFrame) -> DataFrame:
    """One row: the last seal and how often it was opened since any seal (seal_from is a date)."""
    return registry.agg(
        F.max_by(F.when(F.col("kind") == "seal", F.col("seal_from")), F.when(F.col("kind") == "seal", F.col("seq"))).alias("seal_from"),
        F.count(F.when(F.col("kind") == "open", 1)).alias("openings"),
    )


def lockbox_filter(rows: DataFrame, state: DataFrame, dt: str = "dt") -> DataFrame:
    """Rows a search may read: before the seal, or all when unsealed or opened."""
    s = state.withColumn("_j", F.lit(1))
    d = rows.withColumn("_j", F.lit(1)).join(s, "_j")
    free = F.col("seal_from").isNull() | (F.col("openings") > 0)
    return d.filter(free | (F.col(dt) < F.col("seal_from"))).select(*rows.columns)


def lockbox_violation(rows: DataFrame, state: DataFrame, context: str = "search", dt: str = "dt") -> DataFrame:
    """One row per offence: data that reaches into the sealed period."""
    m = rows.agg(F.max(dt).alias("max_dt")).withColumn("_j", F.lit(1))
    d = m.join(state.withColumn("_j", F.lit(1)), "_j")
    return d.filter("seal_from is not null and openings = 0 and max_dt >= seal_from").select(
        F.lit(context).alias("context"), "max_dt", "seal_from"
    )


def lockbox_guard(rows: DataFrame, state: DataFrame, context: str = "search", dt: str = "dt") -> DataFrame:
    """The same rows; the job fails if one of them lies in the sealed period."""
    s = state.withColumn("_j", F.lit(1))
    d = rows.withColumn("_j", F.lit(1)).join(s, "_j")
    bad = F.col("seal_from").isNotNull() & (F.col("openings") == 0) & (F.col(dt) >= F.col("seal_from"))
    msg = F.concat(F.lit(context + " reads sealed data of "), F.col(dt).cast("string"))
    return d.filter(F.when(bad, F.raise_error(msg).cast("boolean")).otherwise(True)).select(*rows.columns)


# --------------------------------------------------------------- forward record
def new_predictions(scored: DataFrame, recorded: DataFrame, keys=("dt", "symbol")) -> DataFrame:
    """Predictions that are not in the ledger yet."""
    return scored.join(recorded.select(*keys).distinct(), list(keys), "left_anti")


def matured(predictions: DataFrame, labelled: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """Results of predictions whose horizon has elapsed and that were not scored before."""
    p = predictions if scored is None else new_predictions(predictions, scored)
    lab = labelled.select("symbol", "dt", "fwd_ret_5d", "fwd_ret_5d_net", "label_win_5d").filter(
        "fwd_ret_5d_net is not null"
    )
    return p.join(lab, ["symbol", "dt"]).withColumnsRenamed(
        {"fwd_ret_5d": "ret_gross", "fwd_ret_5d_net": "ret_net", "label_win_5d": "win"}
    )


def pending(predictions: DataFrame, results: DataFrame) -> DataFrame:
    return new_predictions(predictions, results)


def ledger_record(
    results: DataFrame, benchmark: DataFrame, horizon: int = 5, predictions: DataFrame | None = None,
    reps: int = 5000, mean_block: float = 10, min_dates: int = 10,
) -> DataFrame:
    """The forward record, one row per stage: trades, dates, effective count, mean of the per-date means, win rate, excess
    over the benchmark's mean, and whether the record is more than luck.

    `benchmark` has (dt, bench).  paired_excess is the mean of the per-date differences to it on the dates both have
    (`paired_dates`); its interval and p come from stationary resamples and are null below `min_dates`.  pending counts
    the predictions of the stage without a result; a stage with nothing but those has zero trades.
    """
    per = cut(results.groupBy("stage", "dt").agg(
        F.avg("ret_net").alias("m"), F.count(F.lit(1)).alias("k"), F.sum("win").alias("w")
    ))
    bench = cut(benchmark.filter("bench is not null").select("dt", "bench"))
    first = per.agg(F.min("dt").alias("_lo")).withColumn("_j", F.lit(1))
    b = bench.withColumn("_j", F.lit(1)).join(first, "_j").filter("dt > _lo")
    b = b.agg(F.avg("bench").alias("bench")).withColumn("_j", F.lit(1))
    g = per.groupBy("stage").agg(
        F.sum("k").alias("trades"),
        F.count(F.lit(1)).alias("dates"),
        (F.count(F.lit(1)) / horizon).alias("n_eff"),
        F.avg("m").alias("mean_net"),
        (F.sum("w") / F.sum("k")).alias("win_rate"),
    )
    g = g.withColumn("_j", F.lit(1)).join(b, "_j").withColumn(
        "excess_pct", (F.col("mean_net") - F.col("bench")) * 100
    ).drop("_j", "bench")
    pair = cut(per.join(bench, "dt").select("stage", "dt", (F.col("m") - F.col("bench")).alias("ret")))
    seen = pair.groupBy("stage").agg(F.count(F.lit(1)).alias("paired_dates"), F.avg("ret").alias("paired_excess"))
    enough = pair.join(seen.filter(F.col("paired_dates") >= min_dates).select("stage"), "stage", "left_semi")
    luck = inference.boot_mean_ci(enough, reps, mean_block, ["stage"]).select("stage", "lo", "hi", "p")
    g = g.join(seen, "stage", "left").join(luck, "stage", "left")
    if predictions is None:
        return g
    left = pending(predictions, results.select("dt", "symbol")).groupBy("stage").agg(F.count(F.lit(1)).alias("pending"))
    counts = ("trades", "dates", "paired_dates", "pending")
    return g.join(left, "stage", "full").fillna(0, list(counts))
