"""Outcomes of signals traded one by one, and the statistics of the trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import COSTS, RISK, CostModel, RiskLimits
from ..functions import sym_order


def topk_per_date(
    signals: DataFrame, k: int, threshold: float | None = None, by=("dt",), prob: str = "y_prob", rank: str | None = None
) -> DataFrame:
    """The k largest probabilities of each date, ties by symbol.

    The planner keeps only k rows per date in every task before the shuffle.
    """
    d = signals if threshold is None else signals.filter(F.col(prob) >= threshold)
    w = Window.partitionBy(*by).orderBy(F.desc(prob), "symbol")
    d = d.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k)
    return d.withColumnRenamed("_rk", rank) if rank else d.drop("_rk")


def with_paths(ix: DataFrame, horizon: int) -> DataFrame:
    """(symbol, dt, path): the next `horizon` sessions of the symbol, in order."""
    ahead = sym_order().rowsBetween(1, horizon)
    step = F.struct("day_index", "dt", "open", "high", "low", "close")
    return ix.select("symbol", "dt", F.collect_list(step).over(ahead).alias("path"))


def trade_entries(
    signals: DataFrame, stop_atr="stop_atr", costs: CostModel = COSTS, risk: RiskLimits = RISK, slots="top_n"
) -> DataFrame:
    """Fill at the next open plus slippage and half spread; stop below the fill; size by
    risk, at most an equal share of the exposure limit.  Signals that cannot fill or
    round to no shares drop out.  Needs next_open, atr_14 and the two parameters."""
    c = F.col
    d = signals.filter("next_open is not null and atr_14 > 0")
    d = d.withColumn("entry_raw", c("next_open")).withColumn("entry_px", c("next_open") * (1 + costs.side))
    d = d.withColumn("stop", c("entry_px") - c(stop_atr) * c("atr_14"))
    d = d.withColumn("risk_ps", c("entry_px") - c("stop")).filter("risk_ps > 0")
    budget = risk.account * risk.max_risk_pct / 100
    room = F.lit(risk.account * risk.max_exposure_pct / 100) / c(slots)
    size = F.least(F.floor(F.lit(budget) / c("risk_ps")), F.floor(room / c("entry_px")))
    return d.withColumn("shares", size.cast("bigint")).filter("shares >= 1")


def trade_exits(entries: DataFrame, paths: DataFrame, horizon: int = 5) -> DataFrame:
    """First session within the horizon whose low touches the stop, filled at the stop;
    otherwise the open of the last session.

    The horizon counts from the signal session, and on the last session the stop is
    tested before the open is taken.  Signals without a full path stay open and drop out.
    """
    d = entries.join(paths, ["symbol", "dt"])
    d = d.withColumn("_hit", F.filter("path", lambda x: x["low"] <= F.col("stop")))
    stopped = F.size("_hit") > 0
    d = d.filter(stopped | (F.size("path") >= horizon))
    leg = F.when(stopped, F.element_at("_hit", 1)).otherwise(F.try_element_at("path", F.lit(horizon)))
    d = d.withColumn("_x", leg).withColumn("exit_reason", F.when(stopped, "stop").otherwise("horizon"))
    return d.select(
        *entries.columns,
        F.col("_x.dt").alias("exit_dt"),
        F.when(stopped, F.col("stop")).otherwise(F.col("_x.open")).alias("exit_raw"),
        "exit_reason",
        (F.col("_x.day_index") - F.col("day_index")).alias("sessions_held"),
    )


def trade_costs(exits: DataFrame, costs: CostModel = COSTS) -> DataFrame:
    """Gross on raw prices; slippage on both fills; commission with a minimum; net = gross - costs."""
    c = F.col
    comm = F.greatest(F.lit(costs.min_commission), costs.commission_per_share * c("shares"))
    slip = (c("entry_raw") + c("exit_raw")) * costs.side * c("shares")
    d = exits.withColumn("gross_pnl", (c("exit_raw") - c("entry_raw")) * c("shares"))
    d = d.withColumn("costs", 2 * comm + slip).withColumn("net_pnl", c("gross_pnl") - c("costs"))
    return d.withColumn("r_multiple", F.try_divide("net_pnl", c("risk_ps") * c("shares")))


def cost_identity(trades: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Trades whose net is not gross minus costs; none expected."""
    return trades.filter(F.abs(F.col("net_pnl") - (F.col("gross_pnl") - F.col("costs"))) > tol)


def ordering_ambiguity(entries: DataFrame, paths: DataFrame, reward: float = 2.0) -> DataFrame:
    """Trades whose stop and target are both touched on one session; daily bars cannot
    tell which came first, so they count as stopped."""
    target = F.col("entry_px") + reward * F.col("risk_ps")
    d = entries.withColumn("target", target).join(paths, ["symbol", "dt"])
    both = F.filter("path", lambda x: (x["low"] <= F.col("stop")) & (x["high"] >= F.col("target")))
    first = F.filter("path", lambda x: (x["low"] <= F.col("stop")) | (x["high"] >= F.col("target")))
    hit = F.try_element_at(first, F.lit(1))
    amb = F.coalesce((hit["low"] <= F.col("stop")) & (hit["high"] >= F.col("target")), F.lit(False))
    return d.select(
        *entries.columns,
        "target",
        F.size(both).alias("sessions_touching_both"),
        amb.cast("int").alias("ambiguous"),
        F.when(amb | F.coalesce(hit["low"] <= F.col("stop"), F.lit(False)), "stop")
        .when(hit.isNotNull(), "target")
        .otherwise("none")
        .alias("outcome"),
    )


def equity_from_trades(trades: DataFrame, by=(), account: float = RISK.account) -> DataFrame:
    """Realised equity by exit date, its peak and drawdown.  Entry costs are charged once."""
    by = list(by)
    d = trades.groupBy(*by, F.col("exit_dt").alias("dt")).agg(
        F.sum("net_pnl").alias("net_pnl"), F.count(F.lit(1)).alias("trades")
    )
    w = sym_order(by, "dt").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("equity", F.lit(account) + F.sum("net_pnl").over(w))
    d = d.withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(account)))
    return d.withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak"))


def trade_metrics(trades: DataFrame, by=()) -> DataFrame:
    """Win rate, average win and loss, profit factor, average R, exits by reason."""
    n = F.col("net_pnl")
    win, loss = F.when(n > 0, n), F.when(n < 0, n)
    count = lambda c: F.count(F.when(c, 1))
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum("gross_pnl").alias("gross_pnl"),
        F.sum("costs").alias("total_costs"),
        F.sum("net_pnl").alias("net_pnl"),
        F.avg((n > 0).cast("int")).alias("win_rate"),
        F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        F.try_divide(F.sum(win), F.abs(F.sum(loss))).alias("profit_factor"),
        F.avg("r_multiple").alias("avg_r"),
        count(F.col("exit_reason") == "stop").alias("stops_hit"),
        count(F.col("exit_reason") == "horizon").alias("horizon_exits"),
    )


def simulate(
    candidates: DataFrame, paths: DataFrame, horizon: int = 5, costs: CostModel = COSTS, risk: RiskLimits = RISK
) -> DataFrame:
    return trade_costs(trade_exits(trade_entries(candidates, costs=costs, risk=risk), paths, horizon), costs)


def param_grid(thresholds, top_ns, stop_atrs):
    """Variants as an array of structs; the grid is a parameter, a few dozen entries."""
    return F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"), F.lit(int(n)).alias("top_n"), F.lit(float(s)).alias("stop_atr")
            )
            for t in thresholds
            for n in top_ns
            for s in stop_atrs
        ]
    )


def param_sweep(
    signals: DataFrame, paths: DataFrame, thresholds, top_ns, stop_atrs, horizon: int = 5, risk: RiskLimits = RISK
) -> DataFrame:
    """All variants in one job: rank once, then each surviving signal meets its variants.

    A threshold does not change the order inside a date, so the rank is shared.
    """
    best = topk_per_date(signals, max(top_ns), min(thresholds), rank="rk")
    v = F.explode(param_grid(thresholds, top_ns, stop_atrs)).alias("v")
    d = best.select("*", v).select("*", "v.*").drop("v")
    d = d.filter((F.col("y_prob") >= F.col("threshold")) & (F.col("rk") <= F.col("top_n")))
    return simulate(d, paths, horizon, risk=risk)


VARIANT = ("threshold", "top_n", "stop_atr")


def sweep_returns(trades: DataFrame, account: float = RISK.account) -> DataFrame:
    return trades.groupBy(*VARIANT).agg(
        F.count(F.lit(1)).alias("trades"), (F.sum("net_pnl") / account * 100).alias("return_pct")
    )


def sensitivity_summary(returns: DataFrame) -> DataFrame:
    """Spread of the variants, share that loses, and the median per parameter value."""

    def stats(d, by):
        return d.groupBy(*by).agg(
            F.count(F.lit(1)).alias("variants"),
            F.max("return_pct").alias("best"),
            F.min("return_pct").alias("worst"),
            F.median("return_pct").alias("median"),
            F.avg((F.col("return_pct") < 0).cast("int")).alias("share_losing"),
        )

    named = F.array(
        F.struct(F.lit("all").alias("parameter"), F.lit("").alias("setting")),
        *[F.struct(F.lit(p).alias("parameter"), F.format_string("%.2f", F.col(p).cast("double")).alias("setting")) for p in VARIANT],
    )
    d = returns.select("return_pct", F.explode(named).alias("p")).select("return_pct", "p.*")
    return stats(d, ["parameter", "setting"]).withColumn("spread", F.col("best") - F.col("worst"))


# ----------------------------------------------------------------------- journal
def journal_performance(journal: DataFrame) -> DataFrame:
    """Planned and realised risk of every journal trade."""
    c = F.col
    risk = F.abs(c("entry") - c("stop"))
    move = F.when(c("direction") == "long", c("exit") - c("entry")).otherwise(c("entry") - c("exit"))
    return journal.select(
        "*",
        risk.alias("risk_per_share"),
        (risk * c("shares")).alias("dollar_risk"),
        F.when(risk > 0, F.abs(c("target") - c("entry")) / risk).alias("planned_rr"),
        (move * c("shares")).alias("gross_pnl"),
        F.when(risk > 0, move / risk).alias("r_multiple"),
        F.when(c("exit").isNull(), "open").otherwise("closed").alias("state"),
    )


def journal_stats(performance: DataFrame, since=None) -> DataFrame:
    """Summary of closed trades; drawdown on cumulative profit by closing day.

    Trades are first summed by closing day, so the running window is one row a day.
    """
    d = performance.filter("state = 'closed' and closed_at is not null and gross_pnl is not null")
    if since is not None:
        d = d.filter(F.col("closed_at") >= since)
    p = F.col("gross_pnl")
    win, loss = F.when(p > 0, p), F.when(p < 0, p)
    day = d.groupBy("closed_at").agg(
        F.sum(p).alias("pnl"), F.count(F.lit(1)).alias("n"), F.count(win).alias("wins"), F.count(loss).alias("losses"),
        F.sum(win).alias("won"), F.sum(loss).alias("lost"), F.sum("r_multiple").alias("r"), F.count("r_multiple").alias("nr"),
        F.count("followed_plan").alias("noted"), F.sum((F.col("followed_plan") > 0).cast("int")).alias("kept"),
    )
    w = Window.orderBy("closed_at").rowsBetween(Window.unboundedPreceding, 0)
    day = day.withColumn("_e", F.sum("pnl").over(w))
    day = day.withColumn("_dd", F.greatest(F.max("_e").over(w), F.lit(0.0)) - F.col("_e"))
    s = F.sum
    return day.agg(
        s("n").alias("trades"),
        (100 * s("wins") / s("n")).alias("win_rate_pct"),
        F.coalesce(F.try_divide(s("won"), s("wins")), F.lit(0.0)).alias("average_win"),
        F.coalesce(F.try_divide(s("lost"), s("losses")), F.lit(0.0)).alias("average_loss"),
        F.try_divide(s("won"), -s("lost")).alias("profit_factor"),
        s("pnl").alias("net_pnl"),
        F.try_divide(s("r"), s("nr")).alias("average_r"),
        F.max("_dd").alias("max_drawdown"),
        F.try_divide(100 * s("kept"), s("noted")).alias("plan_adherence_pct"),
    )


def risk_check(plans: DataFrame, journal_perf: DataFrame, today, risk: RiskLimits = RISK) -> DataFrame:
    """Size every plan and list the limits it breaks, against the open book of the day."""
    c = F.col
    is_open = c("state") == "open"
    book = journal_perf.agg(
        F.count(F.when(is_open, 1)).alias("open_positions"),
        F.coalesce(F.sum(F.when(is_open, c("shares") * c("entry"))), F.lit(0.0)).alias("open_notional"),
        F.coalesce(F.sum(F.when(~is_open & (c("closed_at") == today), c("gross_pnl"))), F.lit(0.0))
        .alias("realized_today"),
    ).withColumn("_j", F.lit(1))
    p = plans.withColumn("_j", F.lit(1)).join(book, "_j").drop("_j")
    long, short = c("direction") == "long", c("direction") == "short"
    bad_side = (
        (long & (c("stop") >= c("entry"))) | (short & (c("stop") <= c("entry")))
        | F.coalesce(long & (c("target") <= c("entry")), F.lit(False))
        | F.coalesce(short & (c("target") >= c("entry")), F.lit(False))
    )
    p = p.withColumn("risk_per_share", F.abs(c("entry") - c("stop")))
    budget = risk.account * risk.max_risk_pct / 100
    p = p.withColumn("plan_shares", F.coalesce(F.floor(F.try_divide(F.lit(budget), c("risk_per_share"))), F.lit(0)).cast("bigint"))
    p = p.withColumn("dollar_risk", c("plan_shares") * c("risk_per_share"))
    p = p.withColumn("notional", c("plan_shares") * c("entry"))
    p = p.withColumn("risk_reward", F.try_divide(F.abs(c("target") - c("entry")), c("risk_per_share")))
    p = p.withColumn("total_exposure_pct", (c("open_notional") + c("notional")) / risk.account * 100)
    p = p.withColumn("headroom", F.lit(risk.daily_loss_limit) + c("realized_today"))
    halted = c("realized_today") <= -risk.daily_loss_limit
    rules = [
        (bad_side, "stop or target on the wrong side"),
        (c("plan_shares") < 1, "size rounds to zero"),
        (c("risk_reward") < risk.min_risk_reward, "risk-reward below minimum"),
        (c("open_positions") >= risk.max_positions, "max open positions"),
        (c("total_exposure_pct") > risk.max_exposure_pct, "exposure over the cap"),
        (halted, "daily loss limit hit"),
        (~halted & (c("dollar_risk") > c("headroom")), "risk exceeds daily headroom"),
    ]
    hits = F.array_compact(F.array(*[F.when(F.coalesce(k, F.lit(False)), F.lit(m)) for k, m in rules]))
    return p.withColumn("breaches", F.array_join(hits, "; ")).withColumn(
        "verdict", F.when(F.size(hits) > 0, "REJECTED").otherwise("WITHIN LIMITS")
    )


def cost_waterfall(trades: DataFrame, by=()) -> DataFrame:
    """Gross, costs and net as three steps."""
    g = trades.groupBy(*by).agg(
        F.sum("gross_pnl").alias("gross"), (-F.sum("costs")).alias("costs"), F.sum("net_pnl").alias("net")
    )
    return g.unpivot(list(by), ["gross", "costs", "net"], "step", "value")
