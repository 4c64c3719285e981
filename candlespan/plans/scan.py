"""The daily scan for every (symbol, date) at once, its confirmation step, and the replay of its signals."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespan.config import Settings
from candlespan.functions import scoring as M
from candlespan.functions import sizing as Z
from candlespan.operators import crosssection as X
from candlespan.operators import indicators as I
from candlespan.operators.confirm import near_level
from candlespan.operators.panel import own_rows, panel, series
from candlespan.operators.patterns import best_pattern, with_patterns
from candlespan.operators.quality import bad_move, blackout, continuous, first_failure, quality, stale_days
from candlespan.operators.ranking import percentile_ranks
from candlespan.operators.stage import peaks, slope_kernel, with_stage
from candlespan.operators.trades import label_outcomes, non_overlapping, with_future
from candlespan.session import stored

Signal = Callable[[DataFrame, Settings], DataFrame]


def prepass(bars: DataFrame) -> DataFrame:
    """What the cross-section needs of every bar: returns, moving average and continuity, all plain windows."""
    p = panel(bars).withColumns({
        "bad": bad_move(), "ret_63": I.period_return(63), "ret_1": I.daily_return(), "sma_50": I.sma("close", 50),
        "next_date": F.lead("date").over(series()),
    })
    return own_rows(p.withColumn("continuous", continuous())).drop("bad")


def analysed(bars: DataFrame, s: Settings = Settings(), extra_kernels: list | None = None) -> DataFrame:
    """Indicators, stage, patterns and gates of every bar: windows over plain bars, then one grouped map on narrow rows, and no window behind it,
    which would cost an exchange of all that the map adds. `extra_kernels` may use the columns of the standard ones."""
    p = panel(bars).withColumns({"tr": I.true_range(), "bad": bad_move(), "adv_cr": I.adv_crores()})
    p = peaks(p.withColumn("continuous", continuous())).drop("bad")
    p = with_patterns(p, s.patterns, [*I.standard_kernels(), slope_kernel(), *(extra_kernels or [])], notes=False)
    p = p.withColumns({"close_in_range": I.close_in_range(), "tightness": I.tightness(), "best": best_pattern(s.patterns)})
    return with_stage(p).withColumn("volume_ratio_20", F.try_divide("volume", "vol_avg_20")).drop(
        *[f"p_{n}" for n in s.patterns], "piv_high", "piv_low"
    )


def morning_scan(
    bars: DataFrame, universe: DataFrame, s: Settings = Settings(), calendar: DataFrame | None = None, events: DataFrame | None = None
) -> DataFrame:
    """Score, gates and features of every (symbol, date); `gate` names the first gate that fails.

    With a `calendar`, the sessions on which a symbol that has traded before has no bar are rows as well, with the gate `stale` and no
    features. With `events` too, an announcement ahead is a blackout: like a failed quality check or another stage it makes the score 0.
    The quality floor looks at what the universe knows of market_cap_cr, listing_date and promoter_pledge_pct; unknown facts pass. A symbol
    without a sector gets the one its industry's words stand for.
    """
    th = s.thresholds
    known = {c: F.col(c) if c in universe.columns else F.lit(None).cast(t) for c, t in (
        ("sector", "string"), ("industry", "string"), ("market_cap_cr", "double"), ("listing_date", "date"), ("promoter_pledge_pct", "double"))}
    facts = universe.select("symbol", *[c.alias(n) for n, c in known.items()])
    facts = facts.withColumn("sector", F.coalesce(F.nullif(F.trim("sector"), F.lit("")), M.classify_sector(F.col("industry")))).drop("industry")
    light = prepass(bars).select("symbol", "date", "ret_63", "continuous", "next_date")
    fair = light.filter("continuous").select("symbol", "date", "ret_63").join(facts.select("symbol", "sector"), "symbol", "left")
    ranked = percentile_ranks(fair, ["date"], "ret_63").select("symbol", "date", "rs_percentile")
    trends = X.sector_trends(fair, "ret_63").select("date", "sector", "sector_trend")
    rows = own_rows(analysed(bars, s)).join(facts, "symbol", "left")
    rows = rows.join(ranked, ["symbol", "date"], "left").join(trends, ["date", "sector"], "left")
    if events is None:
        rows = rows.withColumn("earnings_blackout", F.lit(False))
    else:
        rows = rows.join(blackout(light.select("symbol", "date"), events, calendar), ["symbol", "date"], "left").withColumnRenamed("blackout", "earnings_blackout")
    level = F.col("best")["breakout_level"]
    failed = quality(F.col("adv_cr"), F.col("market_cap_cr"), F.datediff("date", "listing_date"), F.col("promoter_pledge_pct"), th)
    rows = rows.withColumns({
        "rs_percentile": F.coalesce("rs_percentile", F.lit(0.0)), "sector_trend": F.coalesce("sector_trend", F.lit("flat")),
        "volume_ratio": F.coalesce("volume_ratio_20", F.lit(1.0)), "distance_pct": F.try_divide(level - F.col("close"), level) * 100.0,
        "quality_failed": failed, "quality_ok": F.size(failed) == 0,
    }).withColumn("rs_points", M.rs_points(F.col("rs_percentile")))
    score = M.composite_score(
        F.col("best")["confidence"], F.col("rs_points"), F.col("volume_ratio"), F.col("tightness"), F.col("sector_trend"),
        F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("quality_ok") & (F.col("stage") == "STAGE_2") & ~F.col("earnings_blackout"), th,
    )
    rows = rows.withColumn("score", score)
    gate = first_failure(
        discontinuous=~F.col("continuous"), insufficient_data=F.col("bar_no") < th.min_history, quality=~F.col("quality_ok"),
        stage=F.col("stage") != "STAGE_2", no_pattern=F.col("best").isNull() | (level <= 0),
        far_from_breakout=~near_level(F.col("close"), level, th.near_breakout_pct), low_score=F.col("score") < th.watchlist_min_score,
    )
    rows = rows.withColumn("gate", gate)
    if calendar is None:
        return rows
    stale = stale_days(light, calendar).select("symbol", "date", F.lit("stale").alias("gate"))
    return rows.unionByName(stale, allowMissingColumns=True)


def watchlist(scan: DataFrame) -> DataFrame:
    """Rows that passed every gate, with their features as columns."""
    b = F.col("best")
    return scan.filter("gate = 'passed'").select(
        "symbol", "date", "score", b["pattern"].alias("pattern"), b["breakout_level"].alias("breakout_level"),
        b["base_height"].alias("base_height"), b["confidence"].alias("pattern_confidence"), "stage", "rs_percentile",
        "rs_points", "tightness", "volume_ratio", "sector", "sector_trend", "distance_pct", "adv_cr",
    )


def default_signal(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Stage 2, best pattern near its level, score at the alert threshold without cross-sectional inputs."""
    th = s.thresholds
    b = F.col("best")
    score = M.composite_score(
        b["confidence"], F.lit(0.0), F.coalesce("volume_ratio_20", F.lit(1.0)), F.lit(0.0), F.lit("flat"),
        Z.extension_pct(F.col("close"), b["breakout_level"]), F.col("close_in_range"), F.col("stage") == "STAGE_2", th,
    )
    hit = (F.col("bar_no") >= th.min_history) & near_level(F.col("close"), b["breakout_level"], th.near_breakout_pct)
    return rows.withColumn("score", score).filter(hit & (F.col("score") >= th.min_score_to_alert)).withColumns({
        "level": b["breakout_level"], "base_height": b["base_height"], "pattern": b["pattern"],
    })


def replay(rows: DataFrame, signal: Signal = default_signal, s: Settings = Settings(), lookback: int | None = None) -> DataFrame:
    """Trades a sequential replay of `signal` would have taken over analysed panel rows.

    All signals of all bars are labelled in one pass; only the choice of non-overlapping ones is sequential.
    """
    rows = with_future(rows, s.paper.hold_max_days)
    rows = rows.filter((F.col("bar_no") > s.thresholds.min_history) & (F.col("bar_no") < F.col("n_bars")))
    rows = rows.filter(F.col("n_bars") >= s.thresholds.min_history + 2)
    if lookback:
        rows = rows.filter(F.col("bar_no") > F.col("n_bars") - lookback)
    fired = signal(rows.filter("own"), s).filter(F.col("atr_14").isNotNull())
    return non_overlapping(stored(label_outcomes(fired, s), "labelled"))
