"""Thresholds and limits, as immutable parameter groups passed to the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# The states a trade can be in.
OPEN_STATES = ("ALERTED", "ENTERED", "TARGET_1_HIT")

# Pattern names in dispatch order (ties in confidence go to the earlier name).
PATTERN_ORDER = (
    "fifty_two_week_high",
    "darvas_box",
    "nr7",
    "inside_bar",
    "bollinger_squeeze",
    "ascending_triangle",
    "vcp",
    "cup_and_handle",
    "flag",
)

# Score bands, lower bound inclusive, upper bound exclusive.
SCORE_BANDS = ((60, 70), (70, 80), (80, 90), (90, 101))

# Features split into terciles, and features grouped by value.
NUMERIC_FEATURES = (
    "pattern_confidence", "rs_percentile", "tightness", "volume_ratio", "distance_pct",
    "extension_pct", "close_in_range", "atr_pct", "vix", "breadth_pct", "regime_score",
)
CATEGORICAL_FEATURES = (
    "sector_trend", "market_mood", "stage", "alert_type", "regime", "nifty_trend",
)

# Fixed values: (minutes since the open, share of the day's volume traded by then).
VOLUME_PROFILE = (
    (0, 0.000), (15, 0.039), (45, 0.117), (75, 0.181), (105, 0.243), (135, 0.316), (165, 0.395),
    (195, 0.471), (225, 0.543), (255, 0.609), (285, 0.671), (315, 0.747), (345, 0.851), (375, 1.000),
)
SESSION_OPEN_MINUTE = 9 * 60 + 15
SESSION_CLOSE_MINUTE = 15 * 60 + 30
EXCHANGE_TZ = "Asia/Kolkata"

# Canonical sector -> substrings looked for in ' <industry> '.
SECTOR_KEYWORDS = (
    ("BANK", ("bank",)),
    ("IT", ("information technology", "software", " it ")),
    ("AUTO", ("auto", "automobile")),
    ("PHARMA", ("pharma", "healthcare", "drug")),
    ("FMCG", ("fmcg", "consumer goods", "food", "personal")),
    ("METAL", ("metal", "steel", "mining", "iron")),
    ("REALTY", ("realty", "real estate", "construction")),
    ("ENERGY", ("energy", "power", "oil", "gas", "petroleum")),
    ("FINANCE", ("finance", "financial", "nbfc", "insurance")),
)

# Exchange holidays known in advance (date strings).
FIXED_HOLIDAYS = (
    "2026-01-26", "2026-04-03", "2026-04-14", "2026-05-01", "2026-08-15", "2026-10-02", "2026-12-25",
)


@dataclass(frozen=True)
class Risk:
    capital: float = 500000.0
    risk_per_trade_pct: float = 1.0
    max_concurrent_positions: int = 8
    max_positions_per_sector: int = 3
    max_daily_loss_pct: float = 3.0
    max_monthly_loss_pct: float = 10.0


@dataclass(frozen=True)
class Thresholds:
    min_score_to_alert: float = 60.0
    watchlist_min_score: float = 50.0
    min_volume_ratio: float = 1.5
    volume_saturation_ratio: float = 3.0
    extension_free_pct: float = 2.0
    extension_max_pct: float = 8.0
    extension_max_penalty: float = 10.0
    min_market_cap_cr: float = 500.0
    min_adv_cr: float = 5.0
    min_listing_days: int = 365
    max_pledge_pct: float = 30.0
    near_breakout_pct: float = 2.0
    min_history: int = 200


@dataclass(frozen=True)
class PaperTrading:
    hold_max_days: int = 30
    atr_stop_multiplier: float = 1.5
    target_1_r_multiple: float = 2.0
    friday_multiplier: float = 2.5
    long_gap_multiplier: float = 3.5


@dataclass(frozen=True)
class Regime:
    enabled: bool = True
    index_sma: int = 200
    index_slope_lookback: int = 20
    flat_band: float = 0.005
    breadth_up_pct: float = 60.0
    breadth_down_pct: float = 40.0
    risk_off_multiplier: float = 0.5
    severe_multiplier: float = 0.25


@dataclass(frozen=True)
class Costs:
    enabled: bool = True
    brokerage_pct: float = 0.1
    brokerage_max_inr: float = 20.0
    stt_pct: float = 0.1
    exchange_txn_pct: float = 0.00297
    sebi_turnover_pct: float = 0.0001
    stamp_duty_pct: float = 0.015
    gst_pct: float = 18.0
    slippage_pct: float = 0.05


@dataclass(frozen=True)
class Settings:
    risk: Risk = field(default_factory=Risk)
    thresholds: Thresholds = field(default_factory=Thresholds)
    paper: PaperTrading = field(default_factory=PaperTrading)
    regime: Regime = field(default_factory=Regime)
    costs: Costs = field(default_factory=Costs)
    patterns: tuple = PATTERN_ORDER
