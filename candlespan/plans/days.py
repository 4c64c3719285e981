"""The trading day as one plan: the pre-close run, which opens positions, and the end of day, which settles them and drops failed levels.

Whatever needs the bars is worked out for all symbols and dates at once: which setups are confirmed, what would become of a position
opened there, where their levels are retested and where they fail. What hangs on the days before, the open positions and the
pullback list, is the state of one fold that sees a bounded number of rows a day.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlespan.config import Settings
from candlespan.functions import sizing as Z
from candlespan.operators.confirm import confirmed, failed_level, first_of_day, retest, taking_order
from candlespan.operators.trades import bars_after
from candlespan.session import stored

#: Calendar days for which a breakout waits for its retest, those in which falling back below its level fails it, and how far apart
#: two levels are the same.
PULLBACK_DAYS = 10
FAIL_DAYS = 3
SAME_LEVEL = 0.01

SHOWN = [
    "date", "symbol", "alert_type", "pattern", "score", "sector", "breakout_level", "since", "entry_price", "stop_loss", "target_1",
    "target_2", "shares", "state", "exit_date", "exit_price", "pnl_inr", "pnl_r", "n_open", "n_sector",
]


def opened(entries: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Positions opened at the close of `entries`, with what the end-of-day runs after it make of them.

    `entries` has (symbol, date, close, level, base_height, atr_14, monday_open, risk_multiplier, ahead). The stop is wider over a weekend, the size follows the
    risk multiplier (null: 1). Each later bar is one end of day: stop (the open if it gapped through), second target, first target, which moves
    the stop to the entry, then the exit by time, in calendar days. A position still open at the last bar has no exit.
    `ahead` must reach one bar beyond `hold_max_days`.
    """
    p = s.paper
    stop = Z.stop_level(F.col("level"), F.col("atr_14"), Z.stop_multiplier(F.col("date"), F.coalesce("monday_open", F.lit(True)), p))
    t1, t2 = Z.targets(F.col("close"), F.col("stop_loss"), F.col("base_height"), p.target_1_r_multiple)
    rows = entries.withColumn("stop_loss", stop).withColumns({
        "target_1": t1, "target_2": t2,
        "shares": Z.position_size(F.col("close"), F.col("stop_loss"), s.risk, F.coalesce("risk_multiplier", F.lit(1.0))),
    })

    def end_of_day(acc, bar):
        half = acc["state"] == "TARGET_1_HIT"
        live = F.when(half, F.greatest("close", "stop_loss")).otherwise(F.col("stop_loss"))
        state = (
            F.when(bar["low"] <= live, "STOPPED_OUT").when(bar["high"] >= F.col("target_2"), "TARGET_HIT")
            .when(~half & (bar["high"] >= F.col("target_1")), "TARGET_1_HIT")
            .when(F.datediff(bar["date"], "date") >= p.hold_max_days, "TIME_EXIT").otherwise(acc["state"])
        )
        price = F.when(state == "STOPPED_OUT", F.least(live, bar["open"])).when(state == "TARGET_HIT", F.col("target_2")).when(state == "TIME_EXIT", bar["close"])
        return F.when(acc["day"].isNotNull(), acc).otherwise(
            F.struct(state.alias("state"), price.alias("price"), F.when(price.isNotNull(), bar["date"]).alias("day")))

    start = F.struct(F.lit("ENTERED").alias("state"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("date").alias("day"))
    rows = rows.withColumn("_x", F.aggregate("ahead", start, end_of_day))
    rows = rows.withColumns({"state": F.col("_x")["state"], "exit_price": F.col("_x")["price"], "exit_date": F.col("_x")["day"], "entry_price": F.col("close")})
    pnl = Z.settlement(F.col("entry_price"), F.col("exit_price"), F.col("shares"), F.col("stop_loss"), s.costs)
    return rows.withColumns({k: pnl[k] for k in ("pnl_inr", "pnl_r")}).drop("_x", "ahead")


def trading_days(
    rows: DataFrame, s: Settings = Settings(), pullback_days: int = PULLBACK_DAYS, facts: Callable[[DataFrame], DataFrame] | None = None,
    bars: DataFrame | None = None,
) -> DataFrame:
    """Every position that the daily runs open, in `SHOWN`'s columns, with the positions open before it.

    `rows` has one row for each bar, as `opened` needs it, with open, high, low, bar_no, volume_ratio (to the 20 bars before), continuous, and the setup of
    that day's watchlist: level, base_height, pattern, score (rescored with the day's bar), sector. Bars without a setup have a null level.

    Of all bars only confirmed breakouts and the retests of those taken need more than their own row. So `rows` may leave out what `facts` then adds to
    the few (sector, monday_open, risk_multiplier), and `ahead`, if numbered `bars` are given to look it up in.

    Pre-close of a day: setups that close above their level on volume, with a score to alert on, are taken best first under the limits on
    positions and on positions of a sector (null is a sector of its own) and go on the pullback list, where a symbol's newest breakout replaces the one before.
    Then symbols on the list, in order of symbol, that retest and hold their level open a position if there is room, once for a level, and leave the list; without
    room they stay. End of day: positions settle, and a breakout that closes below its level within `FAIL_DAYS` leaves the list. A position
    closed at the end of a day gives its slot to the next. Nulls in any condition open nothing; an empty table gives no rows.
    """
    r = s.risk
    rows = rows.filter("symbol is not null and date is not null")

    def known(some: DataFrame) -> DataFrame:
        return (facts(some) if facts else some).withColumn("sector", F.coalesce("sector", F.lit("unknown")))

    def with_ahead(some: DataFrame, name: str) -> DataFrame:
        return some if bars is None else bars_after(stored(some, name), bars, s.paper.hold_max_days + 1)

    fresh = known(rows.filter(
        F.col("continuous") & (F.col("level") > 0) & F.col("atr_14").isNotNull()
        & confirmed(F.col("close"), F.col("level"), F.col("volume_ratio"), s.thresholds.min_volume_ratio) & (F.col("score") >= s.thresholds.min_score_to_alert)
    ))
    first = first_of_day(fresh.withColumn("priority", F.lit(0)), r.max_concurrent_positions, r.max_positions_per_sector)
    first = opened(with_ahead(first, "chosen"), s).withColumns({"alert_type": F.lit("BREAKOUT"), "since": F.col("date"), "breakout_level": F.col("level")})
    narrow = [c for c in SHOWN if c not in ("n_open", "n_sector")] + ["priority"]
    first = stored(first.select(*narrow), "breakouts")

    # each of these few breakouts meets its symbol's bars of the days after it by equality
    waiting = first.select(
        "symbol", "since", "breakout_level", F.col("score").alias("_score"),
        F.explode(F.sequence("since", F.date_add("since", pullback_days))).alias("date"))
    met = rows.drop("level", "base_height", "score", "pattern").join(waiting, ["symbol", "date"]).withColumnRenamed("breakout_level", "level")
    failed = F.when(failed_level(F.col("since"), F.col("level"), F.col("date"), F.col("close"), FAIL_DAYS), F.col("date"))
    met = met.withColumn("_failed", F.min(failed).over(Window.partitionBy("symbol", "since")))
    back = known(met.filter(
        F.col("continuous") & F.col("atr_14").isNotNull() & (F.col("bar_no") > 20) & retest(F.col("level"))
        & (F.col("_failed").isNull() | (F.col("date") < F.col("_failed")))
    )).withColumn("base_height", F.greatest(F.lit(0.0), F.col("close") - F.col("level")))
    back = opened(with_ahead(back, "retests"), s).select(
        *[{"alert_type": F.lit("PULLBACK_ENTRY"), "pattern": F.lit("pullback"), "score": F.col("_score"), "breakout_level": F.col("level"), "priority": F.lit(1)}
          .get(c, F.col(c)).alias(c) for c in narrow])
    both = first.unionByName(back).withColumns({"n_open": F.lit(0), "n_sector": F.lit(0)})
    order = [F.col("date"), F.col("priority"), F.when(F.col("priority") == 0, -F.col("score")), *taking_order()[2:], F.col("since")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book: list[tuple] = []  # (exit date or None, sector) of the open positions
        listed: dict[str, object] = {}  # day of the breakout by symbol on the pullback list
        fired: dict[str, list[float]] = {}  # levels of the pullback positions by symbol
        for batch in batches:
            keep, before, inside = [], [], []
            columns = (batch[c] for c in ("date", "symbol", "sector", "alert_type", "since", "breakout_level", "exit_date"))
            for k, (date, symbol, sector, kind, since, level, ends) in enumerate(zip(*columns)):
                if kind == "PULLBACK_ENTRY":
                    if listed.get(symbol) != since:
                        continue
                    if any(abs(level - x) < SAME_LEVEL for x in fired.get(symbol, ())):
                        del listed[symbol]
                        continue
                book = [p for p in book if p[0] is None or p[0] >= date]
                n_sector = sum(p[1] == sector for p in book)
                if 0 < r.max_concurrent_positions <= len(book) or 0 < r.max_positions_per_sector <= n_sector:
                    continue
                keep.append(k)
                before.append(len(book))
                inside.append(n_sector)
                book.append((None if pd.isna(ends) else ends, sector))
                if kind == "BREAKOUT":
                    listed[symbol] = since
                else:
                    del listed[symbol]
                    fired.setdefault(symbol, []).append(level)
            yield batch.iloc[keep].assign(n_open=before, n_sector=inside)[SHOWN]

    # one account: some dozen breakouts a day and the retests of the last days' ones
    kinds = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in SHOWN)
    return both.repartition(1).sortWithinPartitions(*order).mapInPandas(fold, kinds)
