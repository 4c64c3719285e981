"""Stops, targets, sizes, costs and settlement as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlespan.config import Costs, PaperTrading, Risk


def stop_level(level: Column, atr: Column, multiplier: Column | float) -> Column:
    return level - multiplier * atr


def targets(entry: Column, stop: Column, base_height: Column, r_multiple: float = 2.0) -> tuple[Column, Column]:
    return entry + r_multiple * F.abs(entry - stop), entry + base_height


def position_size(entry: Column, stop: Column, risk: Risk = Risk(), multiplier: Column | float = 1.0) -> Column:
    """Whole shares that lose the risked amount at the stop, capped so that a full book fits the account."""
    amount = risk.capital * (risk.risk_per_trade_pct * (F.lit(multiplier) if isinstance(multiplier, float) else multiplier) / 100.0)
    per_share = F.abs(entry - stop)
    cap = risk.capital / max(1, risk.max_concurrent_positions)
    by_risk = F.floor(amount / per_share)
    by_value = F.when(entry > 0, F.floor(F.lit(cap) / entry))
    return F.when(per_share == 0, 0).otherwise(F.least(by_risk, by_value)).cast("long")


def stop_multiplier(date: Column, next_monday_open: Column, p: PaperTrading = PaperTrading()) -> Column:
    """Wider stops over a weekend, wider still when the Monday after is not a trading day."""
    friday = F.dayofweek(date) == 6
    return (
        F.when(friday & ~next_monday_open, p.long_gap_multiplier)
        .when(friday, p.friday_multiplier).otherwise(p.atr_stop_multiplier)
    )


def leg_cost(turnover: Column, c: Costs, buy: bool) -> Column:
    brokerage = F.least(turnover * c.brokerage_pct / 100.0, F.lit(c.brokerage_max_inr))
    exchange = turnover * c.exchange_txn_pct / 100.0
    sebi = turnover * c.sebi_turnover_pct / 100.0
    stt = turnover * c.stt_pct / 100.0
    gst = (brokerage + exchange + sebi) * c.gst_pct / 100.0
    cost = brokerage + exchange + sebi + stt + gst + turnover * c.slippage_pct / 100.0
    if buy:
        cost = cost + turnover * c.stamp_duty_pct / 100.0
    return F.when(turnover > 0, cost).otherwise(0.0)


def round_trip_cost(entry: Column, exit_: Column, shares: Column, c: Costs = Costs()) -> Column:
    if not c.enabled:
        return F.lit(0.0)
    both = leg_cost(entry * shares, c, True) + leg_cost(exit_ * shares, c, False)
    return F.when(shares > 0, both).otherwise(0.0)


def settlement(entry: Column, exit_: Column, shares: Column, stop: Column, c: Costs = Costs()) -> dict[str, Column]:
    """gross, costs, net in currency and net in units of the initial risk."""
    gross = (exit_ - entry) * shares
    costs = round_trip_cost(entry, exit_, shares, c)
    risk = F.greatest(F.lit(1e-9), F.abs(entry - stop))
    per_share = round_trip_cost(entry, exit_, F.lit(1.0), c)
    return {
        "gross_pnl_inr": gross, "costs_inr": costs, "pnl_inr": gross - costs,
        "pnl_r": ((exit_ - entry) - per_share) / risk,
    }


def level_problem(entry: Column, stop: Column, t1: Column, t2: Column, min_spread_pct: float = 0.05) -> Column:
    """First reason why trade levels make no sense, 'OK' if none."""
    return (
        F.when((entry <= 0) | (stop <= 0) | (t1 <= 0) | (t2 <= 0), "non_positive_price")
        .when(stop >= entry, "stop_not_below_entry").when(t1 <= entry, "target_1_not_above_entry")
        .when(t2 <= entry, "target_2_not_above_entry")
        .when((entry - stop) / entry * 100.0 < min_spread_pct, "stop_too_close").otherwise("OK")
    )


def extension_pct(entry: Column, level: Column) -> Column:
    return F.when(level > 0, (entry - level) / level * 100.0)


def atr_pct(atr: Column, entry: Column) -> Column:
    return F.when(entry > 0, atr / entry * 100.0)
