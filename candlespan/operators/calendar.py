"""Trading calendar as a table: one row per day, so every calendar rule is a window over at most a few thousand days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespan.config import FIXED_HOLIDAYS, SESSION_CLOSE_MINUTE


def _days():
    """All days in order. A calendar has one row per day whatever the data size, so one task is enough."""
    return Window.partitionBy("cal").orderBy("date")


def calendar(span: DataFrame, holidays: DataFrame) -> DataFrame:
    """Days lo..hi of `span` (one row: lo, hi) with trading flag, previous trading day and business-day number.

    The holidays known in advance (`FIXED_HOLIDAYS`) count besides those given. `biz_no` counts Mondays to Fridays before the day, so the number of business days in [a, b) is the difference.
    """
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("date")).withColumn("cal", F.lit(0))
    known = span.select(F.explode(F.array(*[F.lit(d).cast("date") for d in FIXED_HOLIDAYS])).alias("date"))
    hol = holidays.select("date").unionByName(known).distinct().withColumn("holiday", F.lit(True))
    weekday = F.weekday("date") < 5
    rows = days.join(hol, "date", "left").withColumns({
        "weekday": weekday, "trading": weekday & F.col("holiday").isNull(),
    })
    w = _days()
    before = F.last(F.when(F.col("trading"), F.col("date")), ignorenulls=True).over(w.rowsBetween(-10, -1))
    biz = F.coalesce(F.sum(F.col("weekday").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({
        "prev_trading": F.coalesce(before, F.date_sub("date", 1)), "biz_no": biz,
    }).select("date", "weekday", "trading", "prev_trading", "biz_no")


def last_completed_session(minute: Column) -> Column:
    """The newest finished session at a minute of the day. Needs `trading`, `prev_trading`, `date`."""
    return F.when(F.col("trading") & (minute >= SESSION_CLOSE_MINUTE), F.col("date")).otherwise(F.col("prev_trading"))


def business_days_between(a: Column, b: Column) -> Column:
    """From business-day numbers of the two dates, in either order."""
    return F.abs(a - b)


def monday_after(cal: DataFrame) -> DataFrame:
    """(date, monday_open): is the day three days after a trading day."""
    return cal.select(F.date_sub("date", 3).alias("date"), F.col("trading").alias("monday_open"))


def volume_profile(ticks: DataFrame, minutes: int = 60) -> DataFrame:
    """Median cumulative share of the day's volume by time-of-day bucket, over (symbol, day) pairs.

    `ticks` is (symbol, ts, size). Shares are taken on bucket totals, so a symbol-day contributes at most one row per
    bucket, and the median is an exact distributed one.
    """
    from candlespan.operators.ranking import medians

    b = ticks.select(
        "symbol", F.to_date("ts").alias("day"),
        F.floor((F.hour("ts") * 60 + F.minute("ts")) / minutes).cast("int").alias("bucket"), "size",
    ).groupBy("symbol", "day", "bucket").agg(F.sum("size").alias("v"))
    upto = Window.partitionBy("symbol", "day").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("symbol", "day")
    shares = b.select("bucket", (F.sum("v").over(upto) / F.sum("v").over(whole)).alias("share"))
    return medians(shares, ["bucket"], "share", "median_share").select("bucket", "median_share", F.col("n").alias("n_days"))
