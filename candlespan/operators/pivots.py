"""Swing pivots: bars whose high (low) is the unique extreme of `n` bars on either side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespan.operators.kernels import dominance_kernel, run_kernels
from candlespan.operators.panel import SEG_ROWS, frame, series


def pivot_high(n: int) -> Column:
    """The high where it is a confirmed pivot, else NULL. Bars near either end cannot be confirmed."""
    inside = (F.col("bar_no") > n) & (F.col("bar_no") <= F.col("n_bars") - n)
    top = (F.col("high") > F.max("high").over(frame(-n, -1))) & (F.col("high") > F.max("high").over(frame(1, n)))
    return F.when(inside & top, F.col("high"))


def pivot_low(n: int) -> Column:
    inside = (F.col("bar_no") > n) & (F.col("bar_no") <= F.col("n_bars") - n)
    bottom = (F.col("low") < F.min("low").over(frame(-n, -1))) & (F.col("low") < F.min("low").over(frame(1, n)))
    return F.when(inside & bottom, F.col("low"))


def with_pivots(panel: DataFrame, n: int = 3) -> DataFrame:
    """Adds `piv_high`, `piv_low`."""
    return panel.withColumns({"piv_high": pivot_high(n), "piv_low": pivot_low(n)})


def pivots(panel: DataFrame, n: int = 5) -> DataFrame:
    """One row per pivot: symbol, date, bar_no, kind, price and the date on which it became known."""
    rows = panel.withColumns({
        "piv_high": pivot_high(n), "piv_low": pivot_low(n), "confirmed_on": F.lead("date", n).over(series()),
    }).filter("own")
    kinds = F.array(
        F.struct(F.lit("HIGH").alias("kind"), F.col("piv_high").alias("price")),
        F.struct(F.lit("LOW").alias("kind"), F.col("piv_low").alias("price")),
    )
    return (
        rows.select("symbol", "date", "bar_no", "confirmed_on", F.inline(kinds)).filter(F.col("price").isNotNull())
    )


def pivot_strength(panel: DataFrame, bars: DataFrame, n: int = 5, seg_rows: int = SEG_ROWS) -> DataFrame:
    """Pivots with `strength` = the shorter of the two runs of strictly dominated bars around them.

    Runs are unbounded. Inside a segment they come from one pass; a run that reaches the segment's edge is finished
    against the per-segment extremes of the other segments and then against the one segment that stops it, so no
    symbol is ever gathered whole. `bars` are the numbered bars the panel was cut from.
    """
    runs = run_kernels(panel.select("symbol", "seg", "own", "bar_no", "n_bars", "date", "high", "low"), [dominance_kernel()])
    whole = series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = runs.withColumns({
        "ph": pivot_high(n), "pl": pivot_low(n),
        "lo_no": F.min("bar_no").over(whole),
        "hi_no": F.max("bar_no").over(whole),
    }).filter("own")
    sides = F.array(
        F.struct(F.lit("HIGH").alias("kind"), F.col("ph").alias("price"), F.col("ph").alias("v"),
                 F.col("h_left").alias("l"), F.col("h_right").alias("r")),
        F.struct(F.lit("LOW").alias("kind"), F.col("pl").alias("price"), (-F.col("pl")).alias("v"),
                 F.col("l_left").alias("l"), F.col("l_right").alias("r")),
    )
    found = marked.select("symbol", "date", "bar_no", "n_bars", "lo_no", "hi_no", F.inline(sides)).filter(
        F.col("price").isNotNull()
    ).withColumns({
        "open_left": (F.col("bar_no") - F.col("l") == F.col("lo_no")) & (F.col("lo_no") > 1),
        "open_right": (F.col("bar_no") + F.col("r") == F.col("hi_no")) & (F.col("hi_no") < F.col("n_bars")),
    })
    cut = bars.withColumn("blk", F.floor((F.col("bar_no") - 1) / seg_rows)).select(
        "symbol", "blk", "bar_no",
        F.inline(F.array(F.struct(F.lit("HIGH").alias("kind"), F.col("high").alias("bv")),
                         F.struct(F.lit("LOW").alias("kind"), (-F.col("low")).alias("bv")))),
    )
    tops = cut.groupBy("symbol", "blk", "kind").agg(
        F.max("bv").alias("top"), F.min("bar_no").alias("b0"), F.max("bar_no").alias("b1")
    )
    fixed = found
    for side in ("left", "right"):
        left = side == "left"
        todo = found.filter(f"open_{side}").select("symbol", "kind", "bar_no", "v", "lo_no", "hi_no")
        beyond = F.col("b0") < F.col("lo_no") if left else F.col("b1") > F.col("hi_no")
        edge = F.max if left else F.min
        stop_blk = (
            todo.join(tops, ["symbol", "kind"]).filter(beyond & (F.col("top") >= F.col("v")))
            .groupBy("symbol", "kind", "bar_no", "v", "lo_no", "hi_no").agg(edge("blk").alias("blk"))
        )
        outside = F.col("bb") < F.col("lo_no") if left else F.col("bb") > F.col("hi_no")
        stop = (
            stop_blk.join(cut.withColumnRenamed("bar_no", "bb"), ["symbol", "blk", "kind"])
            .filter(outside & (F.col("bv") >= F.col("v")))
            .groupBy("symbol", "kind", "bar_no").agg(edge("bb").alias(f"stop_{side}"))
        )
        fixed = fixed.join(stop, ["symbol", "kind", "bar_no"], "left")
    far_left = F.col("bar_no") - F.coalesce(F.col("stop_left"), F.lit(0)) - 1
    far_right = F.coalesce(F.col("stop_right"), F.col("n_bars") + 1) - F.col("bar_no") - 1
    return fixed.select(
        "symbol", "date", "bar_no", "kind", "price",
        F.least(
            F.when(F.col("open_left"), far_left).otherwise(F.col("l")),
            F.when(F.col("open_right"), far_right).otherwise(F.col("r")),
        ).alias("strength"),
    )


def last_pivots(piv: DataFrame, k: int = 3) -> DataFrame:
    """The `k` newest pivots of each kind per symbol, kept by a bounded top-k aggregate rather than a full sort."""
    newest = F.struct("bar_no", "date", "price")
    return (
        piv.groupBy("symbol", "kind", (F.floor(F.col("bar_no") / 256)).alias("_b"))
        .agg(F.slice(F.sort_array(F.collect_list(newest), asc=False), 1, k).alias("top"))
        .groupBy("symbol", "kind")
        .agg(F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, k).alias("top"))
        .select("symbol", "kind", F.posexplode("top").alias("back", "p"))
        .select("symbol", "kind", (F.col("back") + 1).alias("back"), "p.bar_no", "p.date", "p.price")
    )
