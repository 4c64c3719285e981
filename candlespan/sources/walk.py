"""Bars derived from transaction rows and from event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlespan.operators.panel import spread

BASE_PRICE = 1500.0
MEAN_STEP = 25.5
ORDER_BLOCK = 1 << 20

BAR_COLUMNS = ["symbol", "date", "open", "high", "low", "close", "volume"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def walk_bars(lineitem: DataFrame, gap_open: bool = False) -> DataFrame:
    """Numbered daily bars from order lines: every line moves its supplier's price by `quantity - 25.5`.

    The running price is a prefix sum over all lines of a supplier, computed in three levels so that a supplier
    (or a supplier-day) with a large share of the lines never meets in one task: lines inside a block of order
    keys, blocks inside a day, days of a supplier, which the calendar bounds. Each level hands up one row per group
    holding the net step and the extremes of the running step, which is all the next level needs. Steps are multiples
    of 0.5, so the sums are exact in any order.

    A day opens at the price before its first line, or with `gap_open` at the price after it, in which case
    neighbouring bars share no price and swing extremes are unique.
    """
    # suppliers stay numbers until their days are known: sorts and hashes of numbers are cheaper than those of text
    lines = lineitem.filter("l_suppkey is not null").select(
        F.col("l_suppkey").alias("_key"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_shipdate").alias("_ts"),
        F.floor(F.col("l_orderkey") / ORDER_BLOCK).alias("_ob"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
    )
    first = [F.max(F.when(F.col("_first") == 1, F.col("_step"))).alias("_step")] if gap_open else []
    in_block = (
        Window.partitionBy("_key", "date", "_ts", "_ob")
        .orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    blocks = (
        lines.withColumn("_step", F.col("l_quantity") - MEAN_STEP)
        .withColumns({"_run": F.sum("_step").over(in_block), "_first": F.row_number().over(in_block)})
        .groupBy("_key", "date", "_ts", "_ob")
        .agg(F.sum("_step").alias("net"), F.max("_run").alias("up"), F.min("_run").alias("dn"), F.sum("l_quantity").alias("vol"), *first)
    )
    in_day = Window.partitionBy("_key", "date").orderBy("_ts", "_ob")
    days = (
        blocks.withColumns({
            "_off": F.coalesce(F.sum("net").over(in_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_first": F.row_number().over(in_day),
        })
        .groupBy("_key", "date")
        .agg(
            F.sum("net").alias("net"), F.max(F.col("_off") + F.col("up")).alias("up"),
            F.min(F.col("_off") + F.col("dn")).alias("dn"), F.sum("vol").cast("long").alias("volume"), *first,
        )
    )
    so_far = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    run = spread(days.withColumn("symbol", F.col("_key").cast("string")), "symbol").withColumns({
        "_close": F.sum("net").over(so_far), "bar_no": F.row_number().over(so_far).cast("long"),
        "n_bars": F.count("*").over(Window.partitionBy("symbol")),
        # a year's price is unknown until the first day of it whose step is known
        "_known": F.max(F.when(F.col("net").isNotNull(), F.year("date"))).over(so_far) == F.year("date"),
    }).filter("date is not null")
    close = F.when(F.col("_known"), F.col("_close"))
    open_ = close - F.col("net") + BASE_PRICE
    up, dn = F.col("up"), F.col("dn")
    return run.select(
        "symbol", "date",
        (open_ + F.col("_step") if gap_open else open_).alias("open"),
        (open_ + (up if gap_open else F.greatest(up, F.lit(0.0)))).alias("high"),
        (open_ + (dn if gap_open else F.least(dn, F.lit(0.0)))).alias("low"),
        (close + BASE_PRICE).alias("close"),
        "volume", "bar_no", "n_bars",
    )


def event_bars(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """OHLCV per event type and time window; ties on the timestamp go by event id."""
    at = F.struct("ts", "event_id")
    return (
        events.groupBy(F.col("event_type").alias("symbol"), F.window("ts", width).alias("w"))
        .agg(
            F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
            F.max_by("value", at).alias("close"), F.count("*").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def universe(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Symbol dimension: supplier -> nation (industry) -> region (sector).

    No broadcast hints: nation and region are tiny and are broadcast by size; suppliers are as many as symbols.
    """
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_name").alias("company_name"),
            F.col("r_name").alias("sector"), F.col("n_name").alias("industry"),
            F.col("s_acctbal").alias("market_cap_cr"),
        )
    )


def index_series(bars: DataFrame) -> DataFrame:
    """Mean close over all symbols per date, as a one-series index."""
    return bars.groupBy("date").agg(F.avg("close").alias("close")).select(F.lit("ALL").alias("index_symbol"), "date", "close")


def event_calendar(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Announcement dates: each symbol's first urgent order of the month."""
    urgent = orders.filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return (
        lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").cast("string").alias("symbol"))
        .join(urgent, "o_orderkey")
        .groupBy("symbol", F.trunc("date", "month").alias("_m"))
        .agg(F.min("date").alias("date"))
        .select("symbol", "date")
    )
