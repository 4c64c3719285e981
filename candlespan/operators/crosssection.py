"""Facts about a date's whole cross-section: breadth, sector medians, stress gauge, regime."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlespan.config import Regime
from candlespan.functions import scoring as M
from candlespan.operators.indicators import index_trend, sma
from candlespan.operators.panel import own_rows, panel, series, trailing
from candlespan.operators.ranking import medians

SECTOR_BAND = 0.02
GAUGE_SCALE = 2000.0


def breadth(rows: DataFrame, sma_col: str = "sma_50") -> DataFrame:
    """Percent of measurable symbols whose close is above their moving average, per date; NULL if none are."""
    above = F.when(F.col(sma_col).isNotNull(), (F.col("close") > F.col(sma_col)).cast("double"))
    return rows.groupBy("date").agg((F.avg(above) * 100.0).alias("breadth_pct"))


def sector_trends(rows: DataFrame, ret: str, sector: str = "sector", band: float = SECTOR_BAND) -> DataFrame:
    """Median member return per date and sector, as up / down / flat."""
    known = rows.filter(F.col(sector).isNotNull()).select("date", F.col(sector).alias("sector"), ret)
    m = medians(known, ["date", "sector"], ret, "median_return")
    trend = F.when(F.col("median_return") > band, "up").when(F.col("median_return") < -band, "down").otherwise("flat")
    return m.select("date", "sector", "median_return", trend.alias("sector_trend"))


def prefer(real: DataFrame, proxy: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Precedence merge of two keyed maps: the real value where there is one."""
    a = real.select(*keys, F.col(value).alias("_r"))
    b = proxy.select(*keys, F.col(value).alias("_p"))
    return a.join(b, keys, "full").select(*keys, F.coalesce("_r", "_p").alias(value))


def stress_gauge(rows: DataFrame, ret: str = "ret_1") -> DataFrame:
    """Scaled cross-sectional deviation of one-day returns per date."""
    return rows.groupBy("date").agg((F.stddev_pop(ret) * GAUGE_SCALE).alias("vix"))


def index_trends(index: DataFrame, n: int = 50, lookback: int = 20, band: float = 0.005) -> DataFrame:
    """Trend of every index series on every date."""
    p = panel(index.withColumnRenamed("index_symbol", "symbol"))
    p = p.withColumn("_sma", sma("close", n))
    p = p.withColumn("_past", F.lag("_sma", lookback).over(series()))
    trend = index_trend(F.col("_sma"), F.col("_past"), F.col("close"), F.col("bar_no"), n + lookback, band)
    rows = own_rows(p.withColumn("trend", trend))
    return rows.select(F.col("symbol").alias("index_symbol"), "date", "close", F.col("_sma").alias("sma"), "trend")


def moods(gauge: DataFrame, n: int = 20, ceiling: float = 25.0) -> DataFrame:
    """Stress level against its own recent mean, per date. A shorter history averages what there is."""
    p = panel(gauge.filter(F.col("vix").isNotNull()).withColumn("symbol", F.lit("GAUGE")))
    p = p.withColumn("vix_avg", F.avg("vix").over(trailing(n)))
    return own_rows(p).select(
        "date", "vix", "vix_avg", M.vix_mood(F.col("vix"), F.col("vix_avg")).alias("market_mood"),
        M.market_tradeable(F.col("vix"), ceiling).alias("tradeable"),
    )


def regimes(dates: DataFrame, trends: DataFrame, breadths: DataFrame, mood: DataFrame, r: Regime = Regime()) -> DataFrame:
    """Votes of trend, breadth and mood per date, with the size multiplier they imply."""
    rows = (
        dates.join(trends.select("date", F.col("trend").alias("index_trend")), "date", "left")
        .join(breadths, "date", "left").join(mood.select("date", "vix", "market_mood"), "date", "left")
        .withColumns({
            "index_trend": F.coalesce("index_trend", F.lit("flat")),
            "market_mood": F.coalesce("market_mood", F.lit("neutral")),
        })
    )
    rows = rows.withColumn("regime_score", M.regime_score(F.col("index_trend"), F.col("breadth_pct"), F.col("market_mood"), r))
    return rows.withColumns({
        "regime": M.regime_label(F.col("regime_score")),
        "risk_multiplier": M.regime_multiplier(F.col("regime_score"), r),
    }).withColumn("stress_multiplier", M.stress_multiplier(F.col("vix"), F.col("breadth_pct"), F.col("regime")))


def relative_strength(stock: Column, bench: Column) -> Column:
    """Ratio of growth factors, NULL when the benchmark lost everything."""
    return F.when(1.0 + bench > 0, (1.0 + stock) / (1.0 + bench))


#: Tiles of a cohort that meet in one task, which takes the products of two of them at a time.
TOGETHER = 8


def _tile_correlations(least: int, tile: int):
    """Sum of absolute correlations and number of pairs between the symbols of two groups of tiles (or within one), from matrix products."""

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        days, place = np.unique(np.concatenate(rows["days"].to_list()), return_inverse=True)
        owner = np.repeat(np.arange(len(rows)), rows["days"].map(len).to_numpy())
        x, seen = np.zeros((len(rows), len(days))), np.zeros((len(rows), len(days)))
        values = np.concatenate(rows["xs"].to_list())
        # a shift of a whole series changes no correlation and keeps the sums small
        x[owner, place] = values - (np.bincount(owner, values) / np.maximum(np.bincount(owner), 1))[owner]
        seen[owner, place] = 1.0
        mine = (rows["part"] == key[1]).to_numpy()
        within = key[1] == key[2]
        first, second = np.flatnonzero(mine), np.flatnonzero(mine if within else ~mine)
        total, pairs = 0.0, 0
        for i in range(0, len(first), tile):
            xa, sa = x[first[i : i + tile]], seen[first[i : i + tile]]
            for j in range(i if within else 0, len(second), tile):
                xb, sb = x[second[j : j + tile]], seen[second[j : j + tile]]
                n, ta, tb = sa @ sb.T, xa @ sb.T, sa @ xb.T
                va, vb = n * ((xa * xa) @ sb.T) - ta * ta, n * (sa @ (xb * xb).T) - tb * tb
                whole = (n >= least) & (va > 1e-12 * n * ((xa * xa) @ sb.T)) & (vb > 1e-12 * n * (sa @ (xb * xb).T))
                if within and i == j:
                    whole &= np.triu(np.ones_like(whole), 1)
                c = np.abs((n * (xa @ xb.T) - ta * tb)[whole] / np.sqrt(va[whole] * vb[whole]))
                total, pairs = total + c.sum(), pairs + len(c)
        return pd.DataFrame({"date": [key[0]], "total": [total], "pairs": [pairs]})

    return work


def mean_abs_correlation(
    returns: DataFrame, cohorts: DataFrame, window: int = 63, least: int = 10, tile: int = 1024, together: int = TOGETHER
) -> DataFrame:
    """Mean absolute pairwise return correlation inside each date's cohort of positions, of any size.

    `cohorts` is (date, symbol), `returns` (symbol, date, bar_no, ret_1). A symbol's returns are packed into one row for each `window` bars, with
    those of the `window` bars before, so a member finds its own by equality on (symbol, block) in a single row. A cohort is dealt into parts of about
    `together` tiles of `tile` symbols, one row for a symbol and its returns; the sums over common days of all pairs of two tiles come from products
    of their matrices, so no pair is ever a row. A cohort of up to a part is sent once; a larger one once for every part it has. Pairs with
    fewer than `least` common days, or without variance on them, do not count.
    """
    r = returns.select("symbol", "date", "bar_no", "ret_1")
    block = F.floor(F.col("bar_no") / window)
    members = cohorts.select("date", "symbol").distinct()
    parts = members.groupBy("date").agg(F.ceil(F.count("*") / (tile * together)).cast("int").alias("parts"))
    members = members.join(r.select("symbol", "date", "bar_no"), ["symbol", "date"]).withColumn("block", block)
    past = r.filter(F.col("ret_1").isNotNull()).select(
        "symbol", F.explode(F.array(block, block + 1)).alias("block"), F.struct("bar_no", F.unix_date("date").alias("day"), F.col("ret_1").alias("x")).alias("bar"))
    blocks = past.groupBy("symbol", "block").agg(F.collect_list("bar").alias("bars"))
    own = F.filter("bars", lambda b: (b["bar_no"] > F.col("bar_no") - window) & (b["bar_no"] <= F.col("bar_no")))
    rows = members.join(blocks, ["symbol", "block"]).select("date", "symbol", own.alias("r"))
    rows = rows.join(parts, "date").withColumn("part", F.pmod(F.xxhash64("symbol"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pairs = rows.select("date", "part", F.col("r.day").alias("days"), F.col("r.x").alias("xs"), other.alias("other"))
    sums = pairs.groupBy("date", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).applyInPandas(
        _tile_correlations(least, tile), "date date, total double, pairs long")
    means = sums.groupBy("date").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))
    return cohorts.select("date").distinct().join(means, "date", "left").select(
        "date", F.when(F.col("pairs") > 0, F.col("total") / F.col("pairs")).otherwise(0.0).alias("avg_correlation")
    )
