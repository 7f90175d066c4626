"""Normalising, checking, upserting and accounting for loaded rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lagged

EXTREME_MOVE = 0.35
GAP_DAYS = 10
IMPLAUSIBLE_USD = 5e9
PRICES = ("open", "high", "low", "close", "adj_close")


def normalize_bars(raw: DataFrame, arrival: str) -> DataFrame:
    """Drop null or non-positive prices, fill volume, keep the last arrival per (symbol, dt)."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in PRICES])
    body = F.struct(*PRICES, F.coalesce("volume", F.lit(0)).cast("bigint").alias("volume"))
    kept = raw.filter(ok).groupBy("symbol", F.col("dt").cast("date").alias("dt"))
    return kept.agg(F.max_by(body, arrival).alias("b")).select("symbol", "dt", "b.*")


def _issue(df: DataFrame, cond: Column, severity: str, issue: str, detail: Column) -> DataFrame:
    return df.filter(cond).select(
        "symbol", "dt", F.lit(severity).alias("severity"), F.lit(issue).alias("issue"), detail.alias("detail")
    )


def dq_ohlc_ordering(bars: DataFrame) -> DataFrame:
    h, lo, o, c = (F.col(x) for x in ("high", "low", "open", "close"))
    bad = (h < lo) | (h < o) | (h < c) | (lo > o) | (lo > c)
    return _issue(bars, bad, "error", "ohlc_ordering", h - lo)


def dq_zero_volume(bars: DataFrame) -> DataFrame:
    return _issue(bars, F.col("volume") == 0, "warn", "zero_volume", F.lit(0.0))


def dq_extreme_move(bars: DataFrame, limit: float = EXTREME_MOVE) -> DataFrame:
    prev = lagged("adj_close", order="dt")
    b = bars.withColumn("_m", F.when(prev > 0, F.col("adj_close") / prev - 1.0))
    return _issue(b, F.abs("_m") > limit, "warn", "extreme_move", F.col("_m"))


def dq_calendar_gap(bars: DataFrame, days: int = GAP_DAYS) -> DataFrame:
    b = bars.withColumn("_g", F.datediff("dt", lagged("dt", order="dt")))
    return _issue(b, F.col("_g") > days, "warn", "calendar_gap", F.col("_g").cast("double"))


def dq_issues(bars: DataFrame) -> DataFrame:
    parts = (dq_ohlc_ordering, dq_zero_volume, dq_extreme_move, dq_calendar_gap)
    return reduce(DataFrame.unionByName, [p(bars) for p in parts])


def dq_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "issue").agg(F.count(F.lit(1)).alias("rows"))


def quarantine(rows: DataFrame, issues: DataFrame, keys=("symbol", "dt")) -> DataFrame:
    """Rows without an error-level issue."""
    bad = issues.filter(F.col("severity") == "error").select(*keys).distinct()
    return rows.join(bad, list(keys), "left_anti")


def upsert_latest(stored: DataFrame, incoming: DataFrame, keys, version: str) -> DataFrame:
    """Natural-key upsert: the greatest version of a key wins; running it twice changes nothing."""
    return _one_per_key(stored.unionByName(incoming), keys, version, F.max_by)


def insert_ignore(stored: DataFrame, incoming: DataFrame, keys, version: str) -> DataFrame:
    """The smallest version of a key stays."""
    return _one_per_key(stored.unionByName(incoming), keys, version, F.min_by)


def _one_per_key(rows: DataFrame, keys, version: str, pick) -> DataFrame:
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    agg = rows.groupBy(*keys).agg(pick(F.struct(*rest), F.col(version)).alias("_r"))
    return agg.select(*keys, "_r.*").select(*rows.columns)


def run_accounting(loads: DataFrame, by: str = "run_id") -> DataFrame:
    """One row per load from (run_id, symbol, dt, hard_errors): counts and status."""
    a = loads.groupBy(by).agg(
        F.countDistinct("symbol").alias("symbols_loaded"),
        F.count("dt").alias("rows_loaded"),
        F.sum("hard_error").cast("bigint").alias("hard_errors"),
    )
    status = (
        F.when(F.col("rows_loaded") == 0, "failed")
        .when(F.col("hard_errors") > 0, "partial")
        .otherwise("ok")
    )
    return a.withColumn("status", status)


def completeness_guard(actions: DataFrame, floor_usd: float, last_page: DataFrame | None = None) -> DataFrame:
    """A month is complete if its smallest amount proves that the pull crossed the floor,
    or if the month is listed in `last_page` (ran out of rows)."""
    m = actions.groupBy(F.date_format("action_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("amount_usd").alias("smallest")
    )
    crossed = F.col("smallest") < floor_usd
    if last_page is not None:
        m = m.join(last_page.select("month", F.lit(True).alias("_end")), "month", "left")
        crossed = crossed | F.coalesce("_end", F.lit(False))
    return m.withColumn("complete", crossed.cast("int")).drop("_end")


def dedupe_actions(actions: DataFrame, implausible: float = IMPLAUSIBLE_USD) -> DataFrame:
    """One row per action; base awards and implausible amounts are flagged, not removed."""
    key = ["award_id", "action_date", "amount_usd", "recipient", "mod"]
    one = actions.groupBy(*key).agg(F.min("agency").alias("agency"))
    mod = F.trim(F.coalesce("mod", F.lit("")))
    return one.withColumn("is_base", mod.isin("0", "", "None", "nan").cast("int")).withColumn(
        "implausible", (F.col("amount_usd") > implausible).cast("int")
    )


def staleness_guard(source: DataFrame, derived: DataFrame) -> DataFrame:
    """One row: symbols in the source, in the derived table, and whether to rebuild."""
    s = source.agg(F.countDistinct("symbol").alias("in_source"), F.max("dt").alias("source_last"))
    d = derived.agg(F.countDistinct("symbol").alias("in_derived"), F.max("dt").alias("derived_last"))
    return (
        s.withColumn("_j", F.lit(1))
        .join(d.withColumn("_j", F.lit(1)), "_j")
        .withColumn(
            "stale",
            (
                (F.col("in_source") != F.col("in_derived")) | (F.col("source_last") > F.col("derived_last"))
            ).cast("int"),
        )
        .drop("_j")
    )


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt")
    )


def panel_coverage(panel: DataFrame, columns) -> DataFrame:
    """Share of rows with a value, one row per column."""
    wide = panel.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "signal", "coverage")


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def drop_blank_rows(df: DataFrame, inputs) -> DataFrame:
    """Drop rows in which every input column is null or white space."""
    have = [c for c in inputs if c in df.columns]
    return df.filter(~reduce(lambda a, b: a & b, [_blank(c) for c in have]))


#: Codes that are worth a look but do not make a row wrong.
DOUBTS = ("wide_stop", "oversized", "plan_unmarked")


def _collect_issues(df: DataFrame, row: str, rules: dict[str, dict[str, Column]]) -> DataFrame:
    """rules: column -> code -> condition; each condition that holds becomes a row (row, column, severity, message = code)."""
    hits = [
        F.when(cond, F.struct(F.lit(column).alias("column"), F.lit("warn" if code in DOUBTS else "error").alias("severity"), F.lit(code).alias("message")))
        for column, codes in rules.items()
        for code, cond in codes.items()
    ]
    return df.select(F.col(row), F.explode(F.array_compact(F.array(*hits))).alias("i")).select(row, "i.*")


def _quantity(name: str, required: bool = True) -> dict[str, Column]:
    """What any price or size has to be: there (if required) and above zero."""
    low = {"not_above_zero": F.col(name) <= 0}
    return {"empty": F.col(name).isNull(), **low} if required else low


def _flag_unknown(df: DataFrame, symbols: DataFrame) -> DataFrame:
    known = symbols.select(F.upper("symbol").alias("_sym"), F.lit(True).alias("_known")).distinct()
    return df.withColumn("_sym", F.upper(F.trim(F.coalesce("symbol", F.lit(""))))).join(known, "_sym", "left")


def _flag_repeats(df: DataFrame, keys, row: str) -> DataFrame:
    """_dup: the key was already seen on an earlier row."""
    g = df.groupBy(*keys).agg(F.min(row).alias("_first"))
    g = g.select(*[F.col(k).alias("_d_" + k) for k in keys], "_first")
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(g["_d_" + k]) for k in keys])
    return (
        df.join(g, cond, "left")
        .withColumn("_dup", F.col("_first") < F.col(row))
        .drop("_first", *["_d_" + k for k in keys])
    )


def validate_trades(
    trades: DataFrame, symbols: DataFrame, today: Column, account: float = 10_000.0, row: str = "row_id"
) -> DataFrame:
    """Row rules over a hand-kept trade journal; one output row per problem."""
    t = _flag_repeats(_flag_unknown(trades, symbols), ["trade_id"], row)
    c = F.col
    side = F.lower(F.trim(F.coalesce("direction", F.lit(""))))
    sign = F.when(side == "long", 1).when(side == "short", -1)  # null: neither
    # distances along the trade: a stop has to lie behind the entry, a target ahead of it
    to_stop, to_target = sign * (c("stop") - c("entry")), sign * (c("target") - c("entry"))
    risk = F.try_divide(F.abs(to_stop), F.when(c("entry") > 0, c("entry")))
    rules = {
        "trade_id": {"empty": c("trade_id").isNull(), "repeated": c("trade_id").isNotNull() & c("_dup")},
        "symbol": {"empty": c("_sym") == "", "not_listed": (c("_sym") != "") & c("_known").isNull()},
        "direction": {"no_side": sign.isNull()},
        "opened_at": {"no_date": c("opened_at").isNull(), "after_today": c("opened_at") > today},
        "entry": _quantity("entry"),
        "stop": {**_quantity("stop"), "wrong_side": to_stop >= 0, "wide_stop": risk > 0.25},
        "target": {"wrong_side": to_target <= 0},
        "shares": {**_quantity("shares"), "oversized": (c("shares") > 0) & (c("entry") * c("shares") > account * 4)},
        "closed_at": {"before_open": c("closed_at") < c("opened_at")},
        "exit": _quantity("exit", required=False),
        "closed_at/exit": {"half_closed": c("closed_at").isNull() != c("exit").isNull()},
        "signal_score": {"off_scale": ~c("signal_score").between(1, 10)},
        "followed_plan": {"plan_unmarked": c("followed_plan").isNull(), "not_a_flag": ~c("followed_plan").isin(0, 1)},
    }
    return _collect_issues(t, row, rules)


def validate_observations(obs: DataFrame, symbols: DataFrame, row: str = "obs_id") -> DataFrame:
    o = _flag_unknown(obs, symbols).withColumn("_fld", F.trim(F.coalesce("field", F.lit(""))))
    o = _flag_repeats(o, ["_sym", "dt", "_fld"], row)
    c = F.col
    rules = {
        "symbol": {"not_listed": (c("_sym") != "") & c("_known").isNull()},
        "dt": {"no_date": c("dt").isNull()},
        "field": {"empty": c("_fld") == ""},
        "value": {"nothing_observed": c("value").isNull() & _blank("text_value")},
        "source": {"empty": _blank("source")},
        "symbol/dt/field": {"repeated": c("_dup")},
    }
    return _collect_issues(o, row, rules)


def snapshot_diff(snapshots: DataFrame) -> DataFrame:
    """(snapshot in {before, now}, symbol) -> additions and removals."""
    before = snapshots.filter("snapshot = 'before'").select("symbol")
    now = snapshots.filter("snapshot = 'now'").select("symbol")
    added = now.join(before, "symbol", "left_anti").withColumn("change", F.lit("added"))
    removed = before.join(now, "symbol", "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def latest_row(bars: DataFrame, columns=("close",)) -> DataFrame:
    return (
        bars.groupBy("symbol")
        .agg(F.max_by(F.struct("dt", *columns), "dt").alias("_l"))
        .select("symbol", "_l.*")
    )


