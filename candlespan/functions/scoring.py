"""Score components, the composite score and market-wide multipliers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlespan.config import SECTOR_KEYWORDS, Regime, Thresholds


def _clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x))


def rs_points(pct: Column, full_at: float = 75.0, zero_at: float = 50.0, most: float = 15.0) -> Column:
    """Linear from the zero to the full percentile; a missing percentile earns nothing."""
    return (
        F.when(pct.isNull() | (pct <= zero_at), 0.0)
        .when(pct >= full_at, most)
        .otherwise((pct - zero_at) / (full_at - zero_at) * most)
    )


def tightness_points(score: Column, most: float = 10.0) -> Column:
    return F.when(score.isNull(), 0.0).otherwise(_clamp(score * most, 0.0, most))


def volume_points(ratio: Column, weight: float = 15.0, knee_at: float = 1.5, full_at: float = 3.0) -> Column:
    """Half the weight at the confirmation ratio, all of it at saturation, linear on both sides of the knee."""
    if knee_at <= 0:
        return F.lit(weight)
    v, knee = F.greatest(ratio, F.lit(0.0)), weight * 0.5
    if full_at <= knee_at:
        above = F.lit(weight)
    else:
        above = F.least(F.lit(weight), knee + (v - knee_at) / (full_at - knee_at) * (weight - knee))
    return F.when(v <= knee_at, v / knee_at * knee).otherwise(above)


def extension_penalty(ext: Column, free: float = 2.0, full_at: float = 8.0, most: float = 10.0) -> Column:
    """Points off for paying up above the level; unknown extension is not penalised."""
    ramp = F.least(F.lit(most), (ext - free) / (full_at - free) * most) if full_at > free else F.lit(most)
    return F.when(ext.isNull() | (ext <= free), 0.0).otherwise(ramp)


def close_points(cir: Column, weight: float = 5.0) -> Column:
    """Points for closing high in the bar's range; an unknown position earns the full weight."""
    return F.when(cir.isNull(), weight).otherwise(_clamp(cir * weight, 0.0, weight))


def sector_points(trend: Column) -> Column:
    return F.when(trend == "up", 5.0).when(trend == "down", 0.0).otherwise(3.0)


def composite_score(
    confidence: Column, rs_pts: Column, volume_ratio: Column, tightness: Column, sector_trend: Column,
    extension_pct: Column, close_in_range: Column, gate: Column, th: Thresholds = Thresholds(),
) -> Column:
    """0..100; 0 where `gate` (quality, stage 2, no blackout) fails or there is no pattern."""
    total = (
        confidence * 0.35 + 15.0 + _clamp(rs_pts, 0.0, 15.0)
        + volume_points(volume_ratio, 15.0, th.min_volume_ratio, th.volume_saturation_ratio)
        + _clamp(tightness * 10.0, 0.0, 10.0) + close_points(close_in_range) + sector_points(sector_trend)
        - extension_penalty(extension_pct, th.extension_free_pct, th.extension_max_pct, th.extension_max_penalty)
    )
    return F.when(gate & confidence.isNotNull(), F.greatest(F.lit(0.0), total)).otherwise(0.0)


def classify_sector(industry: Column) -> Column:
    """First canonical sector one of whose keywords occurs in the padded, lower-cased text."""
    text = F.concat(F.lit(" "), F.lower(industry), F.lit(" "))
    out = F.lit(None).cast("string")
    for sector, words in reversed(SECTOR_KEYWORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, sector).otherwise(out)
    return F.when(F.length(industry) > 0, out)


def vix_mood(now: Column, avg: Column, high: float = 1.25, low: float = 0.85) -> Column:
    return (
        F.when(now.isNull() | avg.isNull() | (avg <= 0), "neutral")
        .when(now >= avg * high, "risk_off").when(now <= avg * low, "risk_on").otherwise("neutral")
    )


def market_tradeable(vix: Column, ceiling: float = 25.0) -> Column:
    return vix.isNull() | (vix <= ceiling)


def regime_score(trend: Column, breadth: Column, mood: Column, r: Regime = Regime()) -> Column:
    vote_t = F.when(trend == "up", 1).when(trend == "down", -1).otherwise(0)
    vote_b = F.when(breadth >= r.breadth_up_pct, 1).when(breadth <= r.breadth_down_pct, -1).otherwise(0)
    vote_m = F.when(mood == "risk_on", 1).when(mood == "risk_off", -1).otherwise(0)
    return vote_t + vote_b + vote_m


def regime_label(score: Column) -> Column:
    return F.when(score >= 2, "risk_on").when(score <= -2, "risk_off").otherwise("neutral")


def regime_multiplier(score: Column, r: Regime = Regime()) -> Column:
    if not r.enabled:
        return F.lit(1.0)
    return F.when(score <= -3, r.severe_multiplier).when(score == -2, r.risk_off_multiplier).otherwise(1.0)


def stress_multiplier(vix: Column, breadth: Column, label: Column) -> Column:
    """Smallest of the volatility, breadth and regime cuts; a missing input cuts nothing."""
    by_vix = F.when(vix >= 30, 0.25).when(vix >= 25, 0.5).when(vix >= 20, 0.75).otherwise(1.0)
    by_breadth = F.when(breadth < 30, 0.3).when(breadth < 40, 0.6).when(breadth < 50, 0.8).otherwise(1.0)
    by_label = F.when(label == "risk_off", 0.5).when(label == "neutral", 0.8).otherwise(1.0)
    return F.least(by_vix, by_breadth, by_label)


def sector_multiplier(count: Column, max_per_sector: int = 3, base: float = 1.0) -> Column:
    """Size cut for a sector that already holds positions; `count` is NULL or 0 for a new sector."""
    return (
        F.when(count.isNull(), base)
        .when(count >= max_per_sector - 1, base * 0.25).when(count >= max_per_sector - 2, base * 0.5)
        .when(count >= 1, base * 0.75).otherwise(base)
    )


def correlated_size(size: Column, corr: Column, sector_mult: Column, max_discount: float = 0.5) -> Column:
    cut = F.when(corr < 0.3, 1.0).when(corr < 0.5, 0.8).when(corr < 0.7, 0.6).otherwise(max(1.0 - max_discount, 0.5))
    return F.greatest(F.lit(0).cast("long"), (size * (sector_mult * cut)).cast("long"))
