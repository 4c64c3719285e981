"""The panel: numbered bars cut into bounded segments, on which every row-frame window runs.

`Window.partitionBy("symbol")` puts all rows of a symbol into one task. That is harmless for daily bars (a symbol
has one row per calendar day) but not for finer bars or for one symbol that holds a large share of the table. So
numbering is done in two levels (inside a calendar block, then over block totals), and windows run on
`(symbol, seg)` where a segment has a fixed number of rows plus copies of its neighbours' edge rows (halo). Every
trailing window up to `BACK` rows and every leading window up to `AHEAD` rows therefore sees exactly the rows it
would see in the whole series, and no task ever holds more than `SEG_ROWS + BACK + AHEAD` rows of a symbol.

A symbol with at most `SEG_ROWS` bars (16 years of daily bars) has one segment and no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEG_ROWS = 4096
BACK = 2048
AHEAD = 64


def series():
    """The one window all row-frame operators share, so Catalyst plans a single exchange and sort for them."""
    return Window.partitionBy("symbol", "seg").orderBy("bar_no")


def trailing(n: int):
    """The last `n` rows, the current one included."""
    if n > BACK:
        raise ValueError(f"trailing window of {n} rows exceeds the {BACK}-row halo")
    return series().rowsBetween(-(n - 1), 0)


def frame(lo: int, hi: int):
    """Rows `lo..hi` relative to the current one."""
    if -lo > BACK or hi > AHEAD:
        raise ValueError("frame reaches beyond the halo")
    return series().rowsBetween(lo, hi)


def warm(value: Column, n: int) -> Column:
    """NULL until the series has `n` bars."""
    return F.when(F.col("bar_no") >= n, value)


def running_totals(df: DataFrame, keys: list[str], block: Column | str, order: list, sums: dict) -> DataFrame:
    """Running sums per key in two levels: inside `(keys, block)`, plus the totals of the earlier blocks.

    `block` must be monotone in `order`. Only one row per block ever meets in a per-key window, so a key that
    holds most of the table is spread over its blocks. `sums` maps an output column to the expression summed;
    `<out>_all` is that key's grand total. A `block` given by name is a column of `df` and is dropped; when `df`
    holds nothing beyond keys, order and summed columns, both halves of the plan share one exchange.
    """
    local = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = df.withColumnRenamed(block, "_blk") if isinstance(block, str) else df.withColumn("_blk", block)
    rows = placed.select(
        "*", *[F.sum(expr).over(local).alias(out) for out, expr in sums.items()], F.row_number().over(local).alias("_rn")
    )
    last = rows.groupBy(*keys, "_blk").agg(*[F.max_by(out, "_rn").alias(f"_t_{out}") for out in sums])
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = last.select(
        *keys, "_blk",
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums],
        *[F.sum(f"_t_{o}").over(whole).alias(f"{o}_all") for o in sums],
    )
    plain = [c for c in placed.columns if c != "_blk"]
    return rows.join(offsets, [*keys, "_blk"]).select(
        *plain, *[(F.col(o) + F.col(f"_o_{o}")).alias(o) for o in sums], *[F.col(f"{o}_all") for o in sums]
    )


def number_bars(bars: DataFrame) -> DataFrame:
    """Adds `bar_no` (1 = the symbol's first bar) and `n_bars` to rows unique on (symbol, date)."""
    out = running_totals(bars, ["symbol"], F.year("date"), ["date"], {"bar_no": F.lit(1)})
    return out.withColumnRenamed("bar_no_all", "n_bars")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Deals rows by keys into as many partitions as the session sets for shuffles.

    Left to itself, Spark merges small partitions until there is about one task for each core. A core that gets a second of so few
    tasks, each with a long search for patterns, doubles the time of the stage.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def segment(numbered: DataFrame, seg_rows: int = SEG_ROWS, back: int = BACK, ahead: int = AHEAD, even: bool = True) -> DataFrame:
    """Copies edge rows of numbered bars into neighbouring segments; `own` marks the rows to keep at the end.

    With `even` the segments are dealt by `spread`; rows that are dealt so by symbol already need no second time.
    """
    if seg_rows < max(back, ahead):
        raise ValueError("a segment must be at least as long as its halo")
    pos = F.col("bar_no") - 1
    home = F.floor(pos / F.lit(seg_rows)).cast("long")
    at = pos - home * seg_rows
    homes = F.array_compact(F.array(
        home,
        F.when((at >= seg_rows - back) & ((home + 1) * seg_rows < F.col("n_bars")), home + 1),
        F.when((at < ahead) & (home > 0), home - 1),
    ))
    rows = (
        numbered.withColumn("_home", home)
        .withColumn("seg", F.explode(homes))
        .withColumn("own", F.col("seg") == F.col("_home"))
        .drop("_home")
    )
    return spread(rows, "symbol", "seg") if even else rows


def panel(bars: DataFrame, **sizes) -> DataFrame:
    """Bars unique on (symbol, date) -> segmented panel with `bar_no, n_bars, seg, own`."""
    numbered = bars if "bar_no" in bars.columns else number_bars(bars)
    return segment(numbered, **sizes)


def own_rows(df: DataFrame) -> DataFrame:
    """Drops halo copies once all windows are computed."""
    return df.filter("own").drop("own", "seg")
