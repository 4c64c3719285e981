"""Chart patterns for every bar of the panel.

A pattern is a struct column that is NULL where the pattern is absent. The inside bar is window frames; the other eight look at
many bars behind each bar and run as kernels.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlespan.config import PATTERN_ORDER
from candlespan.operators.indicators import true_range
from candlespan.operators.kernels import (
    BOX_NOTES, CUP_NOTES, FIELDS, FLAG_NOTES, NR7_NOTES, SQUEEZE_NOTES, TRIANGLE_NOTES, VCP_NOTES, YEAR_NOTES, box_kernel, contraction_kernel,
    cup_kernel, flag_kernel, nr7_kernel, only, run_kernels, squeeze_kernel, triangle_kernel, year_high_kernel,
)
from candlespan.operators.panel import series, trailing
from candlespan.operators.pivots import with_pivots


PATTERN_TYPE = T.StructType([
    T.StructField("pattern", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("breakout_level", T.DoubleType()),
    T.StructField("base_start_no", T.LongType()),
    T.StructField("base_height", T.DoubleType()),
    T.StructField("notes", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("moves", T.ArrayType(T.DoubleType())),
])


def _notes(**values) -> Column:
    if not values:
        return F.lit(None).cast("map<string,double>")
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("double"))])


def _struct(name: str, confidence: Column, level: Column, start: Column, height: Column, notes: Column,
            moves: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("pattern"), F.least(F.lit(100.0), confidence).cast("double").alias("confidence"),
        level.cast("double").alias("breakout_level"), start.cast("long").alias("base_start_no"),
        height.cast("double").alias("base_height"), notes.alias("notes"),
        (F.array() if moves is None else moves).cast("array<double>").alias("moves"),
    ).cast(PATTERN_TYPE)


def _num(cond: Column) -> Column:
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def _narrowest(panel: DataFrame) -> DataFrame:
    rows = panel if "tr" in panel.columns else panel.withColumn("tr", true_range())
    return rows.withColumn("_nr7", (F.col("bar_no") >= 7) & (F.col("tr") == F.min("tr").over(trailing(7))))


def with_mother(panel: DataFrame) -> DataFrame:
    """Adds what `inside_bar` looks at: the previous bar's high and low, and whether the bar is the narrowest of seven."""
    s = series()
    return _narrowest(panel).withColumns({"_mh": F.lag("high").over(s), "_ml": F.lag("low").over(s)})


def inside_bar(panel: DataFrame) -> DataFrame:
    """High below and low above the previous bar's; better when also NR7 or at most half as wide."""
    rows = panel if "_mh" in panel.columns else with_mother(panel)
    mother = F.col("_mh") - F.col("_ml")
    ratio = F.when(mother > 0, (F.col("high") - F.col("low")) / mother).otherwise(F.lit(1.0))
    match = _struct(
        "inside_bar", 55.0 + _num(F.col("_nr7")) * 20.0 + _num(ratio < 0.5) * 10.0, F.col("_mh"),
        F.col("bar_no") - 1, mother, _notes(inside_ratio=ratio, also_nr7=_num(F.col("_nr7"))),
    )
    hit = (F.col("high") < F.col("_mh")) & (F.col("low") > F.col("_ml"))
    return rows.withColumn("p_inside_bar", F.when(hit, match)).drop("_nr7", "_mh", "_ml")


def _from_kernel(name: str, prefix: str, notes: tuple, moves: str | None = None) -> Column:
    """The struct of a pattern whose kernel left flat columns."""
    c = {n: F.col(f"{prefix}_{n}") for n in ("confidence", "level", "start", "height", *notes)}
    match = _struct(name, c["confidence"], c["level"], c["start"], c["height"], _notes(**{n: c[n] for n in notes}),
                    F.col(moves) if moves else None)
    return F.when(c["confidence"].isNotNull(), match)


def fifty_two_week_high(panel: DataFrame) -> DataFrame:
    """Close within 2 % of the 252-bar high; more highs within 1.5 % of it in 126 bars give more confidence."""
    rows = panel if "year_confidence" in panel.columns else run_kernels(panel, [year_high_kernel()])
    found = _from_kernel("fifty_two_week_high", *KERNEL_PATTERNS["fifty_two_week_high"][1:])
    return rows.withColumn("p_fifty_two_week_high", found).drop(*[c for c in rows.columns if c.startswith("year_")])


#: Window patterns by name; the other names are kernels.
WINDOW_PATTERNS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "inside_bar": inside_bar,
}
KERNEL_PATTERNS = {
    "fifty_two_week_high": (year_high_kernel, "year", YEAR_NOTES, None),
    "darvas_box": (box_kernel, "box", BOX_NOTES, None),
    "vcp": (contraction_kernel, "vcp", VCP_NOTES, "vcp_moves"),
    "cup_and_handle": (cup_kernel, "cup", CUP_NOTES, None),
    "flag": (flag_kernel, "flag", FLAG_NOTES, None),
    "nr7": (nr7_kernel, "nr7", NR7_NOTES, None),
    "bollinger_squeeze": (squeeze_kernel, "squeeze", SQUEEZE_NOTES, None),
    "ascending_triangle": (triangle_kernel, "triangle", TRIANGLE_NOTES, None),
}


def known(enabled) -> list[str]:
    """The enabled names that exist, in the order given; others are ignored."""
    return [p for p in enabled if p in WINDOW_PATTERNS or p in KERNEL_PATTERNS]


def with_patterns(panel: DataFrame, enabled=PATTERN_ORDER, extra_kernels: list | None = None, notes: bool = True) -> DataFrame:
    """Adds a struct column `p_<name>` per enabled pattern. Without `notes` those found by kernels have neither notes nor moves, which then need not
    come back from Python.

    Windows go first, as they share the exchange of the grouped map, then the kernels, on narrow rows of plain numbers, which is all that
    crosses to Python; the structs are built afterwards and stay in the JVM.
    """
    names = known(enabled)
    rows = with_pivots(panel, 3)
    if "nr7" in names and "tr" not in rows.columns:
        rows = rows.withColumn("tr", true_range())
    if "inside_bar" in names:
        rows = with_mother(rows)
    searched = [n for n in names if n in KERNEL_PATTERNS]
    kernels = [KERNEL_PATTERNS[n][0]() for n in searched]
    if not notes:
        kernels = [only(k, [f"{KERNEL_PATTERNS[n][1]}_{c}" for c in FIELDS]) for n, k in zip(searched, kernels)]
    rows = run_kernels(rows, [*(extra_kernels or []), *kernels])
    flat = [c for c in rows.columns if c.split("_")[0] in {KERNEL_PATTERNS[n][1] for n in KERNEL_PATTERNS}]
    rows = rows.withColumns({
        f"p_{n}": _from_kernel(n, *(KERNEL_PATTERNS[n][1:] if notes else (KERNEL_PATTERNS[n][1], (), None))) for n in searched
    }).drop(*flat) if searched else rows
    for name in names:
        if name in WINDOW_PATTERNS:
            rows = WINDOW_PATTERNS[name](rows)
    return rows


def pattern_rows(with_cols: DataFrame, enabled=PATTERN_ORDER) -> DataFrame:
    """All matches as rows: one per symbol, date and pattern."""
    names = known(enabled)
    found = F.array_compact(F.array(*[F.col(f"p_{n}") for n in names]))
    return with_cols.filter("own").select("symbol", "date", "bar_no", "close", F.inline(found))


def best_pattern(enabled=PATTERN_ORDER) -> Column:
    """The most confident match of a row, the earlier enabled name on ties, NULL without a match."""
    names = known(enabled)
    ranked = F.array_compact(F.array(*[
        F.when(F.col(f"p_{n}").isNotNull(), F.struct(
            F.col(f"p_{n}")["confidence"].alias("c"), F.lit(-i).alias("i"),
            *[F.col(f"p_{n}")[x].alias(x) for x in ("pattern", "confidence", "breakout_level", "base_start_no", "base_height")],
        ))
        for i, n in enumerate(names)
    ]))
    return F.array_max(ranked)


def with_base_start(matches: DataFrame, bars: DataFrame) -> DataFrame:
    """Turns `base_start_no` into `base_start_date` by an equality join on (symbol, bar number)."""
    starts = bars.select("symbol", F.col("bar_no").alias("base_start_no"), F.col("date").alias("base_start_date"))
    return matches.join(starts, ["symbol", "base_start_no"], "left")
