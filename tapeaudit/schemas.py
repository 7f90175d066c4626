"""Explicit schemas of every input; nothing is inferred."""

from __future__ import annotations

BARS = (
    "symbol string, dt date, open double, high double, low double, close double, "
    "adj_close double, volume bigint"
)
SYMBOLS = "symbol string, name string, sector string, kind string, inclusion_reason string"
CALENDAR = "dt date, day_index int, year int, month int, dow int"
EARNINGS = (
    "symbol string, announced_at timestamp_ntz, eps_estimate double, eps_actual double, "
    "surprise_pct double"
)
FACTS = (
    "symbol string, concept string, period_start date, period_end date, filed date, "
    "val double, form string"
)
FACTS_JSON = (
    "cik string, facts map<string, map<string, struct<units: map<string, "
    "array<struct<start: string, end: string, val: double, form: string, filed: string>>>>>>"
)
INSIDER = (
    "accession string, symbol string, filing_date date, trans_date date, trans_code string, "
    "shares double, price double"
)
SHORT_INTEREST = (
    "symbol string, settlement_date date, short_shares double, prev_short double, "
    "avg_daily_vol double, days_to_cover double"
)
CONTRACTS = (
    "amount_usd double, recipient string, action_date date, award_id string, mod string, "
    "agency string"
)
PREDICTIONS = (
    "model_name string, fold_id int, symbol string, dt date, y_true double, y_prob double, "
    "y_pred int"
)
SERIES = "strategy string, dt date, ret double"
LEDGER = "seq bigint, payload string, prev_hash string, entry_hash string"
TRIALS = "seq bigint, kind string, strategy_id bigint, variants int, sharpe double, n_obs int"
JOURNAL = (
    "trade_id bigint, symbol string, direction string, opened_at date, entry double, stop double, "
    "target double, shares bigint, closed_at date, exit double, signal_score int, "
    "followed_plan int"
)
OBSERVATIONS = (
    "obs_id bigint, symbol string, dt date, field string, value double, text_value string, "
    "source string"
)
