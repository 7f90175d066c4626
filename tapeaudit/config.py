"""Parameters shared by the operators.  All of them can be overridden per call."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CostModel:
    """Execution costs: basis points per side, commission per share."""

    slippage_bps: float = 5.0
    spread_bps: float = 2.0
    commission_per_share: float = 0.005
    min_commission: float = 1.0
    borrow_bps_annual: float = 0.0

    @property
    def side(self) -> float:
        """Cost of one fill as a fraction of price."""
        return (self.slippage_bps + self.spread_bps) / 10_000

    @property
    def round_trip(self) -> float:
        return 2 * (self.slippage_bps + self.spread_bps) / 10_000


@dataclass(frozen=True)
class RiskLimits:
    account: float = 10_000.0
    max_risk_pct: float = 1.0
    max_exposure_pct: float = 50.0
    max_positions: int = 3
    daily_loss_limit: float = 300.0
    min_risk_reward: float = 2.0


COSTS = CostModel()
RISK = RiskLimits()
HORIZON = 5
MARKET = "MKT"
TRADING_DAYS = 252
