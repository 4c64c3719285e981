"""Confirmation of level crossings, retests, and the allocation of capped slots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def near_level(close: Column, level: Column, near_pct: float = 2.0) -> Column:
    """At most `near_pct` below a positive level; already above passes."""
    return (level > 0) & (F.try_divide(level - close, level) <= near_pct / 100.0)


def confirmed(close: Column, level: Column, volume_ratio: Column, least: float = 1.5) -> Column:
    return (close > level) & (volume_ratio >= least)


def retest(level: Column, touch: float = 0.01) -> Column:
    """The bar dipped to the level, held it, and closed strongly."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span = h - l
    where = F.when(span > 0, (c - l) / span).otherwise(0.0)
    reversal = (F.least(o, c) - l > F.abs(c - o)) | (c > o)
    return (
        (level <= l) & (l <= level * (1.0 + touch)) & (c > level) & reversal
        & ((where >= 0.5) | (c - level >= level * 0.01))
    )


def failed_level(breakout_date: Column, level: Column, today: Column, close: Column, days: int = 3) -> Column:
    """Closed below the level within `days` calendar days of the breakout; unknown facts do not fail it."""
    age = F.datediff(today, breakout_date)
    return F.coalesce((age >= 0) & (age <= days) & (close < level), F.lit(False))


def not_fired(candidates: DataFrame, trades: DataFrame, tol: float = 0.01) -> DataFrame:
    """Candidates (symbol, date, level) without an earlier pullback trade at the same level.

    The tolerance join is keyed on (symbol, level cell) with each trade entered into its own and both neighbouring
    cells, so it stays an equality join.
    """
    cell = F.floor(F.col("level") / tol)
    past = (
        trades.filter(F.col("alert_type") == "PULLBACK_ENTRY")
        .select(F.col("symbol"), F.col("entry_date").alias("_d"), F.col("breakout_level").alias("_l"))
        .withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_l") / tol) - 1, F.floor(F.col("_l") / tol) + 1)))
    )
    left = candidates.withColumn("_cell", cell)
    cond = (
        (left["symbol"] == past["symbol"]) & (left["_cell"] == past["_cell"])
        & (F.abs(past["_l"] - left["level"]) < tol) & (past["_d"] < left["date"])
    )
    return left.join(past, cond, "left_anti").drop("_cell")


def allocate(candidates: DataFrame, open_counts: DataFrame, max_total: int = 8, max_sector: int = 3) -> DataFrame:
    """Who gets a slot on each date: best score first, symbol on ties, under a total and a per-sector cap.

    `candidates` is (date, symbol, score, sector[, priority]); `open_counts` is (date, sector, n_open). Equivalent to
    taking candidates one by one: within a sector only the first `cap - open` can ever be taken, and of those only
    the first `total - open` overall. Both cuts compare a row number with a constant, so Spark keeps at most `cap`
    rows per group before the shuffle; the rejected ones are explained against the last accepted row. A cap of 0
    switches that limit off.
    """
    rows = candidates if "priority" in candidates.columns else candidates.withColumn("priority", F.lit(0))
    totals = open_counts.groupBy("date").agg(F.sum("n_open").alias("open_total"))
    rows = (
        rows.join(open_counts, ["date", "sector"], "left").join(totals, "date", "left")
        .withColumns({"n_open": F.coalesce("n_open", F.lit(0)), "open_total": F.coalesce("open_total", F.lit(0))})
    )
    order = [F.col("priority"), F.desc("score"), F.col("symbol")]
    kept = rows
    if max_sector > 0:
        kept = kept.withColumn("_s", F.row_number().over(Window.partitionBy("date", "sector").orderBy(*order)))
        kept = kept.filter((F.col("_s") <= max_sector) & (F.col("_s") <= max_sector - F.col("n_open"))).drop("_s")
    if max_total > 0:
        kept = kept.withColumn("_t", F.row_number().over(Window.partitionBy("date").orderBy(*order)))
        kept = kept.filter((F.col("_t") <= max_total) & (F.col("_t") <= max_total - F.col("open_total"))).drop("_t")
    taken = kept.select("date", "symbol", F.lit(True).alias("accepted"))
    key = F.struct(F.col("priority"), (-F.col("score")).alias("s"), F.col("symbol"))
    cut = kept.groupBy("date").agg(F.count("*").alias("_n"), F.max(key).alias("_last"))
    out = rows.join(taken, ["date", "symbol"], "left").join(cut, "date", "left")
    free = F.lit(max_total) - F.col("open_total")
    full = (free <= 0) | ((F.coalesce("_n", F.lit(0)) >= free) & (key > F.col("_last")))
    by_total = full if max_total > 0 else F.lit(False)
    return out.select(
        *candidates.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"),
        F.when(F.col("accepted"), "taken").when(by_total, "position_limit").otherwise("sector_limit").alias("reason"),
    )


def taking_order() -> list[Column]:
    """The order in which a day's candidates are looked at."""
    return [F.col("priority"), F.desc("score"), F.col("symbol")]


def first_of_day(rows: DataFrame, max_total: int, max_sector: int) -> DataFrame:
    """The candidates (date, symbol, score, sector, priority) that a book can take at all, whatever it holds: a bounded number a day."""
    if max_sector > 0:
        rows = rows.withColumn("_s", F.row_number().over(Window.partitionBy("date", "sector").orderBy(*taking_order())))
        rows = rows.filter(F.col("_s") <= max_sector).drop("_s")
    if max_total > 0:
        look = max_total + (max_total // max_sector * max_sector if max_sector > 0 else 0)
        rows = rows.withColumn("_t", F.row_number().over(Window.partitionBy("date").orderBy(*taking_order())))
        rows = rows.filter(F.col("_t") <= look).drop("_t")
    return rows


def living_book(candidates: DataFrame, max_total: int = 8, max_sector: int = 3) -> DataFrame:
    """The candidates that a book takes day by day, when what it takes stays open until its exit and only then frees its slots.

    `candidates` is (date, symbol, score, sector, exit_date[, priority]); the order of a day is priority, best score, symbol. A position is
    open through its exit date, for the exit comes after that day's entries; one without an exit stays open. Returned are the taken ones
    with the positions open before each: `n_open` in all and `n_sector` in its sector (unknown sectors are one). A cap of 0 switches that
    limit off.

    Of a day only the first `max_sector` of a sector can be taken, and as a book of `max_total` has at most max_total / max_sector full
    sectors, only so many more than `max_total` of those need a look. These few rows a day, whatever the number of candidates, pass
    in order of time through a fold whose state is the open positions. Candidates with neither cap are all taken.
    """
    rows = candidates if "priority" in candidates.columns else candidates.withColumn("priority", F.lit(0))
    rows = rows.withColumn("sector", F.coalesce("sector", F.lit("unknown"))).filter(F.col("date").isNotNull())
    rows = first_of_day(rows, max_total, max_sector)
    rows = rows.select("date", "symbol", "score", "sector", "exit_date", F.lit(0).alias("n_open"), F.lit(0).alias("n_sector"), "priority")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book: list[tuple] = []  # (exit date or None, sector) of the open positions
        for batch in batches:
            keep, opened, inside = [], [], []
            for k, (date, sector, ends) in enumerate(zip(batch["date"], batch["sector"], batch["exit_date"])):
                book = [p for p in book if p[0] is None or p[0] >= date]
                n_sector = sum(p[1] == sector for p in book)
                if (max_total <= 0 or len(book) < max_total) and (max_sector <= 0 or n_sector < max_sector):
                    keep.append(k)
                    opened.append(len(book))
                    inside.append(n_sector)
                    book.append((None if pd.isna(ends) else ends, sector))
            yield batch.iloc[keep].assign(n_open=opened, n_sector=inside).drop(columns="priority")

    # one book: a few rows for each day of the calendar
    ordered = rows.repartition(1).sortWithinPartitions("date", *taking_order())
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "priority")
    return ordered.mapInPandas(fold, kinds)
