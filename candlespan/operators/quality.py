"""Gates on symbols: freshness, continuity, quality floor, blackout, and the audit and funnel that count them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespan.config import Thresholds
from candlespan.operators.panel import BACK, series

SEASON_MONTHS = (1, 4, 7, 10)
FUNNEL = ("stale", "discontinuous", "insufficient_data", "quality", "stage", "no_pattern", "far_from_breakout", "low_score")


def latest_dates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("date").alias("latest"))


def freshness(latest: DataFrame, as_of: DataFrame) -> DataFrame:
    """Age in days and freshness per symbol. `as_of` is one row (as_of, required): today and the last closed session."""
    rows = latest.withColumns({c: as_of.select(c).scalar() for c in ("as_of", "required")})
    age = F.datediff("as_of", "latest")
    return rows.select(
        "symbol", "latest", age.alias("age_days"), (age >= 1).alias("needs_refetch"),
        (F.col("latest") >= F.col("required")).alias("usable"),
        F.when(F.col("latest") >= F.col("required"), "fresh").when(age >= 7, "very_stale").when(age >= 1, "stale")
        .otherwise("today").alias("age_bucket"),
    )


def stale_days(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Freshness as of every session: (symbol, date, latest, age_days) of the sessions on which a symbol that has traded has no bar.

    `bars` is (symbol, date, next_date), with the symbol's next bar's date. A stale symbol has no row on that session, so each bar
    stands for the sessions up to the next one, or after the last bar up to the newest date of all: their numbers come from the calendar by
    equality, and as many rows are made as there are stale symbols.
    """
    day = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per day of the calendar
    days = calendar.select("date", "trading", F.count_if("trading").over(day).alias("session"))
    newest = bars.agg(F.max("date")).scalar()
    upto = days.select(F.col("date").alias("end"), (F.col("session") - F.col("trading").cast("long")).alias("last"), F.col("session").alias("at"))
    rows = bars.select("symbol", "date", "next_date", F.coalesce("next_date", newest).alias("end"))
    rows = rows.join(days.select("date", "session"), "date").join(upto, "end")
    last = F.when(F.col("next_date").isNull(), F.col("at")).otherwise(F.col("last"))
    gaps = rows.filter(last > F.col("session")).select(
        "symbol", F.col("date").alias("latest"), F.explode(F.sequence(F.col("session") + 1, last)).alias("session"))
    out = gaps.join(days.filter("trading").select("date", "session"), "session")
    return out.select("symbol", "date", "latest", F.datediff("date", "latest").alias("age_days"))


def bad_move(max_drop: float = 0.25, max_jump: float = 0.40) -> Column:
    """The one-bar move where it is implausible, else NULL. Away from a price of zero it is infinite."""
    prev = F.lag("close").over(series())
    away = F.when(F.col("close") > 0, float("inf")).when(F.col("close") < 0, float("-inf"))
    move = F.when(prev == 0, away).otherwise(F.try_divide(F.col("close"), prev) - 1.0)
    return F.when((move <= -abs(max_drop)) | (move >= abs(max_jump)), move)


def discontinuities(panel: DataFrame, max_drop: float = 0.25, max_jump: float = 0.40) -> DataFrame:
    """The largest implausible move per symbol, the earliest on ties."""
    hits = panel.withColumn("_m", bad_move(max_drop, max_jump)).filter(F.col("own") & F.col("_m").isNotNull())
    order = F.struct(F.abs("_m"), -F.col("bar_no"))
    return hits.groupBy("symbol").agg(F.max_by("date", order).alias("date"), F.max_by("_m", order).alias("move"))


def continuous(window: int = 300, max_drop: float = 0.25, max_jump: float = 0.40) -> Column:
    """No implausible move among the last `window - 1` moves. Needs column `bad` from `bad_move`.

    The newest implausible move so far tells; it grows with the rows, where a count would read the whole window again for every bar.
    """
    if window - 1 > BACK:
        raise ValueError(f"trailing window of {window - 1} rows exceeds the {BACK}-row halo")
    newest = F.max(F.when(F.col("bad").isNotNull(), F.col("bar_no"))).over(series().rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(F.col("bar_no") - newest >= window - 1, F.lit(True))


def quality(adv: Column, cap: Column, listed_days: Column, pledge: Column, th: Thresholds = Thresholds()) -> Column:
    """Failed quality checks, empty when all pass; unknown facts pass."""
    return F.array_compact(F.array(
        F.when(adv < th.min_adv_cr, "adv_below_floor"),
        F.when(cap < th.min_market_cap_cr, "market_cap_below_floor"),
        F.when(listed_days < th.min_listing_days, "too_recent_listing"),
        F.when(pledge >= th.max_pledge_pct, "high_promoter_pledge"),
    ))


def blackout(dates: DataFrame, events: DataFrame, calendar: DataFrame, window: int = 5, season_window: int = 7,
             allow_post: bool = True) -> DataFrame:
    """Adds `blackout` to (symbol, date) rows: an announcement lies within the window of business days ahead.

    Every event is spread over the business days it can reach, so the interval join becomes an equality join on
    (symbol, business-day number) whose fan-out is the window, not the number of event pairs.
    """
    biz = calendar.select("date", "biz_no")
    span = max(window, season_window)
    back = 0 if allow_post else span
    reach = (
        events.select("symbol", F.col("date").alias("event_date"))
        .join(biz.select(F.col("date").alias("event_date"), F.col("biz_no").alias("event_no")), "event_date")
        .select("symbol", "event_date", "event_no",
                F.explode(F.sequence(F.col("event_no") - span, F.col("event_no") + back)).alias("biz_no"))
    )
    width = F.when(F.month("date").isin(*SEASON_MONTHS), season_window).otherwise(window)
    gap = F.abs(F.col("event_no") - F.col("biz_no"))
    hit = (gap <= width) & ((F.col("event_date") >= F.col("date")) if allow_post else F.lit(True))
    keyed = dates.select("symbol", "date").join(biz, "date")
    flags = (
        keyed.join(reach, ["symbol", "biz_no"]).filter(hit).select("symbol", "date").distinct()
        .withColumn("blackout", F.lit(True))
    )
    return dates.join(flags, ["symbol", "date"], "left").withColumn("blackout", F.coalesce("blackout", F.lit(False)))


def gate_audit(universe: DataFrame, checked: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """One row per gate: is it ACTIVE, INERT or REDUNDANT, and on how many rows does it have something to judge.

    `checked` has one row per analysed symbol: adv_rejected, has_event (booleans).
    """

    def known(col):
        c = F.col(col)
        return F.count_if(c.isNotNull() & (F.trim(c.cast("string")) != "") & ~F.isnan(c.cast("double"))) \
            if dict(universe.dtypes).get(col) in ("double", "float") else \
            F.count_if(c.isNotNull() & (F.trim(c.cast("string")) != ""))

    facts = universe.agg(
        F.count("*").alias("n_symbols"), known("market_cap_cr").alias("cap"), known("listing_date").alias("listed"),
        known("promoter_pledge_pct").alias("pledge"),
    )
    tried = checked.agg(
        F.count("*").alias("n_checked"), F.count_if("adv_rejected").alias("adv_rejected"),
        F.count_if("has_event").alias("with_events"),
    )
    both = facts.unionByName(tried, allowMissingColumns=True)
    facts = both.agg(*[F.max(c).alias(c) for c in both.columns])

    def line(gate, n, of, idle):
        state = F.lit("ACTIVE") if idle is None else F.when(n > 0, "ACTIVE").otherwise(idle)
        rate = F.when(of > 0, n * 100.0 / of).otherwise(0.0)
        return F.struct(F.lit(gate).alias("gate"), state.alias("state"), n.alias("n"), of.alias("of"), rate.alias("pct"))

    c = F.col
    return facts.select(F.inline(F.array(
        line("adv", c("adv_rejected"), c("n_checked"), None),
        line("market_cap", c("cap"), c("n_symbols"), "REDUNDANT"),
        line("listing_age", c("listed"), c("n_symbols"), "REDUNDANT"),
        line("promoter_pledge", c("pledge"), c("n_symbols"), "INERT"),
        line("earnings_blackout", c("with_events"), c("n_checked"), "INERT"),
    )))


def first_failure(**failed: Column) -> Column:
    """Name of the first gate, in funnel order, whose condition holds; 'passed' if none does."""
    out = None
    for name in FUNNEL:
        if name in failed:
            hit = F.coalesce(failed[name], F.lit(False))
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("passed")


def funnel(rows: DataFrame, gate: Column, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, gate.alias("gate")).agg(F.count("*").alias("n"))
