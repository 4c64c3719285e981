"""Keeping tables: keyed upsert, delete, patch, ids, pruning, and re-basing after corporate actions.

Each function returns the new table as a DataFrame; writing it is the caller's job, so a lost executor only means
recomputing partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlespan.config import OPEN_STATES

MIN_OVERLAP = 3
TOLERANCE = 0.005
FACTOR_RANGE = (0.01, 100.0)
PRICES = ("open", "high", "low", "close")


def align(df: DataFrame, columns: list[str], types: dict[str, str]) -> DataFrame:
    """The fixed column list: missing columns as NULL, extra ones dropped."""
    return df.select(*[
        (F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in columns
    ])


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace existing ones with the same key."""
    kept = existing.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True).select(*existing.columns)


def delete(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def patch(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Overwrites the non-NULL fields of `changes`, which has at most one row per key."""
    fields = [c for c in changes.columns if c != key and c in base.columns]
    ch = changes.select(key, *[F.col(c).alias(f"_n_{c}") for c in fields])
    joined = base.join(ch, key, "left")
    return joined.select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])


def assign_ids(
    new_rows: DataFrame, existing: DataFrame, order: list[str], id_col: str = "id", block: Column | str | None = None
) -> DataFrame:
    """max(id)+1, +2, ... in the given order; ids start at 1 for an empty table.

    Numbering runs inside blocks and over block totals, so all new rows are never sorted in one task. A block is a column or
    expression monotone in the order; by default it is the first order column. Where one of its values may hold a large share
    of the rows, add a range of the next one: `F.struct("date", F.floor(F.col("key") / 65536))`.
    """
    from candlespan.operators.panel import running_totals

    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    cell = F.col(block or order[0]) if block is None or isinstance(block, str) else block
    rows = running_totals(new_rows.withColumn("_one", F.lit(1)), ["_one"], cell, order, {"_i": F.lit(1)})
    return rows.drop("_one", "_i_all").withColumn(id_col, (top + F.col("_i")).cast("long")).drop("_i")


def prune(df: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    """Keeps rows at most `days` calendar days old; undated rows go."""
    return df.filter(F.col(column) >= F.date_sub(as_of, days))


def overlap(cached: DataFrame, incoming: DataFrame) -> DataFrame:
    """Bars present on both sides, old next to new."""
    old = cached.select("symbol", "date", F.col("close").alias("close_old"), F.col("volume").alias("volume_old"))
    new = incoming.select("symbol", "date", F.col("close").alias("close_new"), F.col("volume").alias("volume_new"))
    return old.join(new, ["symbol", "date"])


def adjustment_factors(cached: DataFrame, incoming: DataFrame) -> DataFrame:
    """Price (and volume) factor of every symbol whose history the feed has re-adjusted.

    The median of new over old; one group is one symbol's overlapping days.
    """
    def ratio(name):
        n, o = F.col(f"{name}_new"), F.col(f"{name}_old")
        return F.median(F.when((n > 0) & (o > 0), n / o))

    def plausible(c):
        return F.when(F.col(c).between(*FACTOR_RANGE), F.col(c))

    both = overlap(cached, incoming).groupBy("symbol").agg(
        F.count("*").alias("n"), ratio("close").alias("price_factor"), ratio("volume").alias("volume_factor")
    )
    rows = both.withColumns({"price_factor": plausible("price_factor"), "volume_factor": plausible("volume_factor")})
    rows = rows.filter((F.col("n") >= MIN_OVERLAP) & (F.abs(F.col("price_factor") - 1.0) > TOLERANCE))
    return rows.withColumn("volume_factor", F.when(F.abs(F.col("volume_factor") - 1.0) > TOLERANCE, F.col("volume_factor")))


def upsert_prices(cached: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert on (symbol, date) after putting re-adjusted symbols' cached bars on the feed's new basis."""
    f = adjustment_factors(cached, incoming).select("symbol", "price_factor", "volume_factor")
    one = F.lit(1.0)
    based = cached.join(f, "symbol", "left").withColumns({
        **{c: F.col(c) * F.coalesce("price_factor", one) for c in PRICES},
        "volume": F.when(F.col("volume_factor").isNotNull(), F.bround(F.col("volume") * F.col("volume_factor"), 0))
                   .otherwise(F.col("volume")).cast("long"),
    }).select(*cached.columns)
    return upsert(based, incoming.select(*cached.columns), ["symbol", "date"])


def rebase_trades(trades: DataFrame, factors: DataFrame) -> DataFrame:
    """Open trades follow their symbol's price factor; shares move inversely, so the risk in money stays."""
    f = factors.select("symbol", "price_factor")
    rows = trades.join(f, "symbol", "left")
    k = F.when(F.col("state").isin(*OPEN_STATES), F.col("price_factor"))
    levels = ("entry_price", "stop_loss", "target_1", "target_2")
    return rows.withColumns({
        **{c: F.coalesce(F.col(c) * k, F.col(c)) for c in levels},
        "shares": F.coalesce(F.bround(F.col("shares") / k, 0), F.col("shares")).cast("long"),
    }).select(*trades.columns)


def needs_repair(broken: DataFrame, trades: DataFrame) -> DataFrame:
    """Symbols with a discontinuity, and how many open trades stand on them."""
    held = trades.filter(F.col("state").isin(*OPEN_STATES)).groupBy("symbol").agg(F.count("*").alias("open_trades"))
    return broken.join(held, "symbol", "left").withColumn("open_trades", F.coalesce("open_trades", F.lit(0)))


def flag_failed(watch: DataFrame, closes: DataFrame, days: int = 3) -> tuple[DataFrame, DataFrame]:
    """(failed, remaining) watch rows: a breakout that closed back below its level within `days`.

    `closes` holds each symbol's bar of the as-of day: symbol, date, close.
    """
    from candlespan.operators.confirm import failed_level

    today = closes.select("symbol", F.col("date").alias("_today"), F.col("close").alias("_close"))
    rows = watch.join(today, "symbol", "left").withColumn(
        "_failed", failed_level(F.col("breakout_date"), F.col("breakout_level"), F.col("_today"), F.col("_close"))
    )
    failed = rows.filter("_failed").select("symbol", "breakout_date", F.col("_today").alias("failure_date"), "original_score")
    return failed, rows.filter("not _failed").select(*watch.columns)
