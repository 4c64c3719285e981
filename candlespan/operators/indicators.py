"""Moving indicators over the panel. Column functions use the shared window; smoothing goes through a kernel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlespan.operators.kernels import Kernel, Rolling, Smooth, rolling, run_kernels, smoothing
from candlespan.operators.panel import frame, series, trailing, warm


def sma(col: str, n: int) -> Column:
    """Mean of the last `n` rows, NULL before there are `n`."""
    return warm(F.avg(col).over(trailing(n)), n)


def true_range() -> Column:
    """max(high-low, |high-previous close|, |low-previous close|); the first bar has only high-low."""
    prev = F.lag("close").over(series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def bollinger(col: str = "close", n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    """(upper, middle, lower) bands from the population deviation."""
    mid = sma(col, n)
    dev = warm(F.stddev_pop(col).over(trailing(n)), n)
    return mid + k * dev, mid, mid - k * dev


def volume_ratio(n: int = 20) -> Column:
    """Volume over the mean of the last `n` bars, today included."""
    return F.col("volume") / warm(F.avg("volume").over(trailing(n)), n)


def volume_ratio_prior(volume: Column | str = "volume", n: int = 20) -> Column:
    """(Projected) volume over the mean of the `n` bars before today; 0 where that mean is not positive."""
    v = F.col(volume) if isinstance(volume, str) else volume
    base = F.when(F.col("bar_no") > n, F.avg("volume").over(frame(-n, -1)))
    return F.when(base <= 0, F.lit(0.0)).otherwise(v / base)


def period_return(n: int = 63) -> Column:
    """Close over the close `n` bars ago, minus one; NULL where that close is missing or not positive."""
    past = F.lag("close", n).over(series())
    return F.when(past > 0, F.col("close") / past - 1.0)


def daily_return() -> Column:
    prev = F.lag("close").over(series())
    return F.when(prev > 0, F.col("close") / prev - 1.0)


def close_in_range() -> Column:
    """Where the bar closed in its own range: 0 at the low, 1 at the high, NULL for an empty range."""
    span = F.col("high") - F.col("low")
    return F.when(span > 0, (F.col("close") - F.col("low")) / span)


def adv_crores(n: int = 20) -> Column:
    """Mean daily turnover in units of 10^7; 0 before `n` bars."""
    turnover = F.col("close") * F.col("volume")
    return F.coalesce(warm(F.avg(turnover).over(trailing(n)), n) / 1e7, F.lit(0.0))


def direction_inputs(panel: DataFrame) -> DataFrame:
    """Adds the inputs of the smoothed indicators: true range, gain/loss and directional moves."""
    s = series()
    delta = F.col("close") - F.lag("close").over(s)
    up = F.col("high") - F.lag("high").over(s)
    dn = F.lag("low").over(s) - F.col("low")
    return panel.select(
        "*", true_range().alias("tr"),
        F.greatest(delta, F.lit(0.0)).alias("_delta_up"), F.greatest(-delta, F.lit(0.0)).alias("_delta_dn"),
        up.alias("_up"), dn.alias("_dn"),
    ).withColumns({
        # greatest() skips NULL, so the first bar has to be blanked again
        "gain": F.when(F.col("bar_no") > 1, F.col("_delta_up")),
        "loss": F.when(F.col("bar_no") > 1, F.col("_delta_dn")),
        "plus_dm": F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up"))
                    .when(F.col("bar_no") > 1, F.lit(0.0)),
        "minus_dm": F.when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn"))
                     .when(F.col("bar_no") > 1, F.lit(0.0)),
    }).drop("_delta_up", "_delta_dn", "_up", "_dn")


def ema_spec(out: str, source, span: int) -> Smooth:
    return Smooth(out, source, 2.0 / (span + 1))


def wilder_spec(out: str, source, n: int) -> Smooth:
    return Smooth(out, source, 1.0 / n, n)


def atr_specs(*periods: int) -> list[Smooth]:
    """Needs column `tr`."""
    return [wilder_spec(f"atr_{n}", "tr", n) for n in periods]


def rsi_specs(n: int = 14) -> list[Smooth]:
    """Needs columns `gain`, `loss`."""
    return [wilder_spec("avg_gain", "gain", n), wilder_spec("avg_loss", "loss", n)]


def rsi() -> Column:
    """100 where there was no loss, NULL while the means are warming up."""
    ratio = F.col("avg_gain") / F.col("avg_loss")
    return F.when(F.col("avg_loss") == 0, F.lit(100.0)).otherwise(100.0 - 100.0 / (1.0 + ratio))


def macd_specs(fast: int = 12, slow: int = 26, signal: int = 9) -> list[Smooth]:
    return [
        ema_spec("ema_fast", "close", fast),
        ema_spec("ema_slow", "close", slow),
        ema_spec("macd_signal", lambda f: f["ema_fast"] - f["ema_slow"], signal),
    ]


def macd_line() -> Column:
    return F.col("ema_fast") - F.col("ema_slow")


def _directional_index(f):
    plus, minus = 100 * f["sm_plus"] / f["sm_tr"], 100 * f["sm_minus"] / f["sm_tr"]
    total = plus + minus
    return 100 * (plus - minus).abs() / total.where(total != 0)


def adx_specs(n: int = 14) -> list[Smooth]:
    """Needs columns `tr`, `plus_dm`, `minus_dm`; a zero directional sum counts as missing."""
    return [
        wilder_spec("sm_tr", "tr", n),
        wilder_spec("sm_plus", "plus_dm", n),
        wilder_spec("sm_minus", "minus_dm", n),
        wilder_spec("adx", _directional_index, n),
    ]


def tightness() -> Column:
    """1 - ATR(10)/ATR(50); 0 before 51 bars or for a flat series. Needs `atr_10`, `atr_50`."""
    ok = (F.col("bar_no") >= 51) & (F.col("atr_50") > 0)
    return F.coalesce(F.when(ok, 1.0 - F.col("atr_10") / F.col("atr_50")), F.lit(0.0))


#: The trailing means of the standard indicator set.
STANDARD_MEANS = (
    Rolling("sma_50", "close", 50), Rolling("sma_150", "close", 150), Rolling("sma_200", "close", 200), Rolling("vol_avg_20", "volume", 20),
)


def standard_kernels() -> list[Kernel]:
    """ATR 14/10/50 and the trailing means. Needs `tr`."""
    return [smoothing(atr_specs(14, 10, 50)), rolling(list(STANDARD_MEANS))]


def with_standard(panel: DataFrame, extra_kernels: list | None = None, keep=None) -> DataFrame:
    """Standard indicators: moving averages, ATR 14/10/50, mean volume and volume ratio."""
    out = run_kernels(panel.withColumn("tr", true_range()), [*standard_kernels(), *(extra_kernels or [])], keep)
    return out.withColumn("volume_ratio_20", F.try_divide("volume", "vol_avg_20"))


def smoothed_indicators(panel: DataFrame) -> DataFrame:
    """RSI, MACD, ADX, ATR and tightness in one pass over the segments."""
    specs = [*atr_specs(14, 10, 50), *rsi_specs(), *macd_specs(), *adx_specs()]
    out = run_kernels(direction_inputs(panel), [smoothing(specs)])
    return out.withColumns({
        "rsi": rsi(), "macd": macd_line(), "macd_hist": macd_line() - F.col("macd_signal"), "tightness": tightness(),
    })


def index_trend(sma_col: Column, past_sma: Column, close: Column, bars: Column, need: int, band: float = 0.005) -> Column:
    """up / down / flat from the slope of a moving average and the close's side of it."""
    slope = (sma_col - past_sma) / past_sma
    return (
        F.when((bars < need) | past_sma.isNull() | (past_sma <= 0), "flat")
        .when((close > sma_col) & (slope > band), "up")
        .when(~(close > sma_col) & (slope < -band), "down")
        .otherwise("flat")
    )
