"""Trades: outcome labelling, one-bar settlement, progress and excursions, portfolio checks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlespan.config import OPEN_STATES, Risk, Settings
from candlespan.functions import sizing as Z
from candlespan.operators.kernels import Kernel
from candlespan.operators.panel import AHEAD, frame
from candlespan.session import stored

BUCKET_DAYS = 64
#: Bars in a block of the choice of non-overlapping trades.
BLOCK_BARS = 4096


def label_outcomes(signals: DataFrame, s: Settings = Settings()) -> DataFrame:
    """What would have happened to a trade entered at each signal bar's close.

    `signals` are panel rows with `level, base_height, atr_14` and any carried columns plus `ahead`, the next
    `hold_max_days` bars from `with_future`. The bars are folded in order: stop (the open if it gapped through), then
    second target, then the first target, which moves the stop to the entry from the next bar on; the last bar exits
    at its close. Signals without risk or without a later bar give no trade.
    """
    p = s.paper
    entry = F.col("close")
    stop = Z.stop_level(F.col("level"), F.col("atr_14"), p.atr_stop_multiplier)
    t1, t2 = Z.targets(entry, F.col("stop_loss"), F.col("base_height"), p.target_1_r_multiple)
    rows = signals.withColumn("stop_loss", stop).filter(
        (F.col("close") > F.col("stop_loss")) & (F.size("ahead") > 0)
    ).withColumns({"target_1": t1, "target_2": t2})

    start = F.struct(
        F.lit(None).cast("string").alias("state"), F.lit(None).cast("double").alias("price"),
        F.lit(0).alias("k"), F.lit(False).alias("t1"),
    )

    def step(acc, bar):
        live = F.when(acc["t1"], F.col("close")).otherwise(F.col("stop_loss"))
        state = F.when(bar["low"] <= live, "STOPPED_OUT").when(bar["high"] >= F.col("target_2"), "TARGET_HIT")
        price = F.when(bar["low"] <= live, F.least(live, bar["open"])).when(
            bar["high"] >= F.col("target_2"), F.col("target_2"))
        done = acc["state"].isNotNull()
        return F.when(done, acc).otherwise(F.struct(
            state.alias("state"), price.alias("price"), (acc["k"] + 1).alias("k"),
            (acc["t1"] | (bar["high"] >= F.col("target_1"))).alias("t1"),
        ))

    rows = rows.withColumn("_x", F.aggregate("ahead", start, step))
    x = F.col("_x")
    last = F.element_at("ahead", -1)
    rows = rows.withColumns({
        "state": F.coalesce(x["state"], F.lit("TIME_EXIT")), "exit_price": F.coalesce(x["price"], last["close"]),
        "bars_held": x["k"], "exit_date": F.element_at("ahead", x["k"])["date"],
        "shares": Z.position_size(entry, F.col("stop_loss"), s.risk),
    })
    pnl = Z.settlement(entry, F.col("exit_price"), F.col("shares"), F.col("stop_loss"), s.costs)
    return rows.withColumns({
        **pnl, "entry_price": entry, "entry_date": F.col("date"), "entry_no": F.col("bar_no"),
        "exit_no": F.col("bar_no") + F.col("bars_held"), "days_held": F.datediff("exit_date", "date"),
    }).drop("_x", "ahead")


def with_future(panel: DataFrame, hold: int = 30) -> DataFrame:
    """Adds `ahead`: the next `hold` bars, nearest first."""
    return panel.withColumn("ahead", F.collect_list(F.struct("date", "open", "high", "low", "close")).over(frame(1, hold)))


def bars_after(rows: DataFrame, bars: DataFrame, hold: int) -> DataFrame:
    """`ahead` as `with_future` gives it, for some rows of a symbol's many: they meet the numbered `bars` after them by equality on
    (symbol, block of `hold` bars). Give it stored rows: it reads them twice."""
    block = lambda no: F.floor(no / hold)
    asked = rows.select("symbol", F.col("bar_no").alias("_at")).distinct()
    asked = asked.withColumn("_b", F.explode(F.sequence(block(F.col("_at") + 1), block(F.col("_at") + hold))))
    later = bars.select("symbol", "bar_no", *FUTURE, block(F.col("bar_no")).alias("_b")).join(asked, ["symbol", "_b"])
    later = later.filter((F.col("bar_no") > F.col("_at")) & (F.col("bar_no") <= F.col("_at") + hold))
    found = later.groupBy("symbol", F.col("_at").alias("bar_no")).agg(F.sort_array(F.collect_list(F.struct("bar_no", F.struct(*FUTURE).alias("bar")))).alias("ahead"))
    none = F.filter(F.array(F.struct(*FUTURE)), lambda b: F.lit(False))
    return rows.join(found.select("symbol", "bar_no", F.col("ahead.bar").alias("ahead")), ["symbol", "bar_no"], "left").withColumn("ahead", F.coalesce("ahead", none))


FUTURE = ("date", "open", "high", "low", "close")


def future_kernel(where: Callable[[pd.DataFrame], np.ndarray], hold: int = 30) -> Kernel:
    """The next `hold` bars of the rows that `where` marks, as one array for each of `FUTURE`; `ahead_of` makes `ahead` of them."""
    if hold > AHEAD:
        raise ValueError("frame reaches beyond the halo")

    def fn(pdf: pd.DataFrame) -> dict:
        places, out = np.flatnonzero(where(pdf)), {}
        for c in FUTURE:
            values, column = pdf[c].to_numpy(), np.full(len(pdf), None, dtype=object)
            for i in places:
                column[i] = values[i + 1 : i + 1 + hold]
            out[f"ahead_{c}"] = column
        return out

    return Kernel(tuple((f"ahead_{c}", T.ArrayType(T.IntegerType() if c == "date" else T.DoubleType())) for c in FUTURE), fn)


def ahead_of(rows: DataFrame) -> DataFrame:
    """`ahead` as `with_future` gives it, from the arrays of `future_kernel`; NULL in rows that were not marked."""
    arrays = [f"ahead_{c}" for c in FUTURE]

    def bar(x):
        prices = [F.when(~F.isnan(x[f"ahead_{c}"]), x[f"ahead_{c}"]).alias(c) for c in FUTURE[1:]]
        return F.struct(F.date_from_unix_date(x["ahead_date"]).alias("date"), *prices)

    return rows.withColumn("ahead", F.transform(F.arrays_zip(*arrays), bar)).drop(*arrays)


def _links(entries: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """The place of each trade's successor in its block: the first entry after its exit; the length where none is left."""
    return np.searchsorted(entries, exits, side="right")


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each block, for every trade, the bar from which a replay that took it looks for its next trade outside the block."""
    for batch in batches:
        out = []
        for k in range(len(batch)):
            entries, exits = (batch.column(c)[k].values.to_numpy() for c in ("entries", "exits"))
            n = len(entries)
            to = _links(entries, exits)
            last = np.where(to == n, np.arange(n), to)  # the chain inside the block, twice as far in each round
            while not np.array_equal(last, further := last[last]):
                last = further
            out.append(exits[last] + 1)
        yield batch.append_column("leaves", pa.array(out, pa.list_(pa.int64())))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries taken in each block from the one it is reached at."""
    for batch in batches:
        owner, taken = [], []
        for k, landing in enumerate(batch.column("landing").to_pylist()):
            entries, exits = (batch.column(c)[k].values.to_numpy() for c in ("entries", "exits"))
            to, i = _links(entries, exits).tolist(), int(np.searchsorted(entries, landing))
            while i < len(to):
                owner.append(k)
                taken.append(entries[i])
                i = to[i]
        yield pa.RecordBatch.from_arrays([batch.column("symbol").take(pa.array(owner, pa.int64())), pa.array(taken, pa.int64())], ["symbol", "entry_no"])


def non_overlapping(trades: DataFrame, block: int = BLOCK_BARS) -> DataFrame:
    """Keeps, per symbol, the trades a sequential replay would take: the next entry lies after the previous exit.

    A trade's successor is the first entry after its exit. Trades are packed into blocks of `block` bars; inside a block all chains of
    successors are followed at once. A chain leaves its block at some bar, and finds the trade it goes on with by an equality
    join on (symbol, block): these crossings, at most as many for a block as bars a trade is held, are the nodes of a much smaller
    graph. Those that the chain from the symbol's first trade reaches are marked by pointer doubling, in as many rounds
    as the number of a symbol's blocks has binary digits. Each block is then walked from the one trade it is reached at. So a task never
    holds more than a block of one symbol, however long its signals overlap, and the one window has a row for a block.

    A symbol has at most one trade per entry bar, as signals are one per bar, and trades exit after their entry. Give it stored
    rows: it reads them twice.
    """
    number = lambda c: F.col(c).cast("long").alias(c)
    span = trades.select("symbol", number("entry_no"), number("exit_no"))
    packed = span.groupBy("symbol", F.floor(F.col("entry_no") / block).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("entry_no", "exit_no"))).alias("ts")
    ).select("symbol", "block", F.col("ts.entry_no").alias("entries"), F.col("ts.exit_no").alias("exits"))
    blocks = stored(packed.mapInArrow(_leaves, T.StructType([*packed.schema, T.StructField("leaves", T.ArrayType(T.LongType()))])), "trade-blocks")

    first = blocks.groupBy("symbol").agg(F.min(F.col("entries")[0]).alias("x"), F.count("*").alias("n"))
    most = first.agg(F.max("n")).first()[0] or 1
    reached = first.select("symbol", "x")
    nodes = blocks.select("symbol", F.explode(F.array_distinct("leaves")).alias("x")).unionByName(reached).distinct()
    nodes = nodes.withColumn("own", F.floor(F.col("x") / block))
    # where a bar's trade is found: in its own block if that has a later entry, else in the symbol's next block with trades
    places = blocks.select("symbol", "block", F.element_at("entries", -1).alias("last"))
    places = places.unionByName(nodes.select("symbol", F.col("own").alias("block")).distinct(), allowMissingColumns=True)
    places = places.groupBy("symbol", "block").agg(F.max("last").alias("last"))
    later = Window.partitionBy("symbol").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("next", F.min(F.when(F.col("last").isNotNull(), F.col("block"))).over(later))
    nodes = nodes.join(places.withColumnRenamed("block", "own"), ["symbol", "own"])
    nodes = nodes.select("symbol", "x", F.when(F.col("last") >= F.col("x"), F.col("own")).otherwise(F.col("next")).alias("block"))
    skipped = F.size(F.filter("entries", lambda e: e < F.col("x")))
    links = stored(nodes.join(blocks, ["symbol", "block"]).select(
        "symbol", "x", "block", F.col("entries")[skipped].alias("landing"), F.col("leaves")[skipped].alias("to")
    ), "trade-links")

    jumps = links.select("symbol", "x", "to")
    for k in range(math.ceil(math.log2(most))):
        far = reached.join(jumps, ["symbol", "x"]).select("symbol", F.col("to").alias("x"))
        reached = stored(reached.unionByName(far).distinct(), "trade-reached")
        again = jumps.select("symbol", F.col("x").alias("to"), F.col("to").alias("further"))
        jumps = stored(jumps.join(again, ["symbol", "to"]).select("symbol", "x", F.col("further").alias("to")), "trade-jumps")
    landed = links.join(reached, ["symbol", "x"], "left_semi").select("symbol", "block", "landing")
    taken = blocks.join(landed, ["symbol", "block"]).select("symbol", "entries", "exits", "landing").mapInArrow(
        _walked, T.StructType([span.schema["symbol"], T.StructField("entry_no", T.LongType())]))
    return trades.join(taken, ["symbol", "entry_no"], "left_semi")


def settle(trades: DataFrame, today: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One day's transition of every open trade. `today` is (symbol, date, open, high, low, close): that day's bars.

    Entry day: nothing. Then stop, second target, first target (once; it moves the stop to the entry), time exit.
    Trades without a bar for the day, or not open, keep their state.
    """
    bar = today.select("symbol", F.col("date").alias("today"), *[F.col(c).alias(f"_{c}") for c in ("open", "high", "low", "close")])
    rows = trades.join(bar, "symbol", "left")
    held = F.datediff("today", "entry_date")
    live = F.col("state").isin("ENTERED", "TARGET_1_HIT") & (held > 0)
    stop = F.when(F.col("state") == "TARGET_1_HIT", F.greatest("entry_price", "stop_loss")).otherwise(F.col("stop_loss"))
    new = (
        F.when(~F.coalesce(live, F.lit(False)), F.col("state"))
        .when(F.col("_low") <= stop, "STOPPED_OUT").when(F.col("_high") >= F.col("target_2"), "TARGET_HIT")
        .when((F.col("state") == "ENTERED") & (F.col("_high") >= F.col("target_1")), "TARGET_1_HIT")
        .when(held >= s.paper.hold_max_days, "TIME_EXIT").otherwise(F.col("state"))
    )
    rows = rows.withColumns({"new_state": new, "_stop": stop})
    closed = F.coalesce(live, F.lit(False)) & F.col("new_state").isin("STOPPED_OUT", "TARGET_HIT", "TIME_EXIT")
    price = (
        F.when(F.col("new_state") == "STOPPED_OUT", F.least("_stop", "_open"))
        .when(F.col("new_state") == "TARGET_HIT", F.col("target_2")).otherwise(F.col("_close"))
    )
    rows = rows.withColumn("exit_price", F.when(closed, price)).withColumns({
        "exit_date": F.when(closed, F.col("today")), "days_held": F.when(closed, held),
    })
    pnl = Z.settlement(F.col("entry_price"), F.col("exit_price"), F.col("shares"), F.col("stop_loss"), s.costs)
    return rows.withColumns({k: F.when(closed, v) for k, v in pnl.items()}).drop("_open", "_high", "_low", "_close", "_stop")


def holding_bars(trades: DataFrame, bars: DataFrame, include_entry: bool, as_of=None) -> DataFrame:
    """Range join of trades and the bars of their holding period, as an equality join on (symbol, date bucket).

    A trade is held until its exit; an open one until `as_of` (a date column of the trades or a literal), or else the newest bar.
    It is entered into the buckets its period touches, so the join never compares all dates of a symbol.
    """
    epoch = F.lit("1970-01-01").cast("date")

    def cell(c):
        return F.floor(F.datediff(c, epoch) / BUCKET_DAYS)

    newest = bars.agg(F.max("date")).scalar() if as_of is None else as_of
    t = trades.select("symbol", "id", "entry_date", "entry_price", "stop_loss", F.coalesce("exit_date", newest).alias("until"))
    t = t.filter(F.col("until") >= F.col("entry_date")).withColumn("_b", F.explode(F.sequence(cell("entry_date"), cell("until"))))
    b = bars.select("symbol", "date", "high", "low", "close").withColumn("_b", cell("date"))
    lower = F.col("date") >= F.col("entry_date") if include_entry else F.col("date") > F.col("entry_date")
    return t.join(b, ["symbol", "_b"]).filter(lower & (F.col("date") <= F.col("until")))


def excursions(trades: DataFrame, bars: DataFrame, as_of=None) -> DataFrame:
    """Best and worst point after the entry day in units of risk, never on the wrong side of zero."""
    risk = F.abs(F.col("entry_price") - F.col("stop_loss"))
    rows = holding_bars(trades, bars, False, as_of).filter((risk > 0) & (F.col("entry_price") > 0))
    return rows.groupBy("id").agg(
        F.greatest(F.lit(0.0), F.max((F.col("high") - F.col("entry_price")) / risk)).alias("max_favorable"),
        F.least(F.lit(0.0), F.min((F.col("low") - F.col("entry_price")) / risk)).alias("max_adverse"),
    )


def daily_progress(trades: DataFrame, bars: DataFrame, as_of=None) -> DataFrame:
    """Days since entry and each day's own move in percent, as an array and as 'D1:1.0%,D2:-0.3%'.

    The entry bar is D0 and only carries the entry price as the first baseline. Moves are shown to one place, ties to the even digit.
    """
    rows = holding_bars(trades, bars, True, as_of).filter(F.col("close").isNotNull() & (F.col("entry_price") > 0))
    days = rows.groupBy("id").agg(
        F.first("entry_price").alias("e"), F.sort_array(F.collect_list(F.struct("date", "close"))).alias("d")
    )
    base = F.transform("d", lambda x, i: F.when(i <= 1, F.col("e")).otherwise(F.element_at("d", i)["close"]))
    moves = F.slice(F.zip_with("d", base, lambda x, b: (x["close"] - b) / b * 100.0), F.lit(2), F.greatest(F.size("d") - 1, F.lit(0)))
    rows = days.select("id", moves.alias("moves"))
    return rows.select(
        "id", F.concat(F.lit("D"), F.size("moves").cast("string")).alias("days_in_trade"), "moves",
        F.when(F.size("moves") > 0, F.array_join(F.transform(
            "moves", lambda m, i: F.concat(F.lit("D"), (i + 1).cast("string"), F.lit(":"), F.when((m < 0) & (F.bround(m, 1) == 0), "-0.0").otherwise(F.format_string("%.1f", F.bround(m, 1))), F.lit("%"))
        ), ",")).alias("daily_moves"),
    )


def open_trades(trades: DataFrame) -> DataFrame:
    return trades.filter(F.col("state").isin(*OPEN_STATES))


def portfolio_health(trades: DataFrame, dates: DataFrame, r: Risk = Risk()) -> DataFrame:
    """Circuit breakers per as-of date: the day's and the month's realised loss, and the number of open positions.

    Trades are summed per exit date first, so the running sums work on one row per day; the calendar bounds them.
    """
    closed = trades.filter(F.col("exit_date").isNotNull()).groupBy(F.col("exit_date").alias("date")).agg(
        F.sum(F.coalesce("pnl_inr", F.lit(0.0))).alias("day_pnl"), F.count("*").alias("closed"))
    opened = trades.groupBy(F.col("entry_date").alias("date")).agg(F.count("*").alias("opened"))
    days = dates.join(closed, "date", "left").join(opened, "date", "left")
    month = Window.partitionBy(F.trunc("date", "MM")).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    ever = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = days.withColumns({
        "daily_pct": F.col("day_pnl") / r.capital * 100.0,
        "monthly_pct": F.sum("day_pnl").over(month) / r.capital * 100.0,
        "n_open": F.coalesce(F.sum("opened").over(ever), F.lit(0)) - F.coalesce(F.sum("closed").over(ever), F.lit(0)),
    })
    reasons = F.array_compact(F.array(
        F.when(F.col("daily_pct") < -r.max_daily_loss_pct, "daily_loss"),
        F.when(F.col("monthly_pct") < -r.max_monthly_loss_pct, "monthly_loss"),
        F.when(F.col("n_open") >= r.max_concurrent_positions, "position_limit"),
    ))
    return rows.select("date", "daily_pct", "monthly_pct", "n_open", reasons.alias("reasons"), (F.size(reasons) == 0).alias("healthy"))


def sector_exposure(trades: DataFrame, universe: DataFrame) -> DataFrame:
    """Open positions per sector; symbols without a universe row are left out, rows without a sector are 'unknown'."""
    u = universe.select("symbol", F.coalesce(F.nullif(F.trim("sector"), F.lit("")), F.lit("unknown")).alias("sector"))
    return open_trades(trades).join(u, "symbol").groupBy("sector").agg(F.count("*").alias("n_open"))
