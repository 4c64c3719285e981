"""Stateful operators with event-time timers: open trades moved by the bars that pass, and a watchlist whose entries have a lifetime.

Rows of a key wait in state until event time (the watermark) has passed them, and are then handled in the order of their dates. So
the outcome does not depend on how rows are cut into batches or ordered within one, and nothing later than the watermark is ever read.
A key has one timer, at the next date it has something to do. State is kept in RocksDB, so it may exceed an executor's memory.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
EPOCH = np.datetime64("1970-01-01")


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class InOrder(StatefulProcessor):
    """Hands a key's rows to `passed` once event time has passed them.

    ROW and HELD are the columns of waiting rows, whose first one `day` is a day number, and of what the key holds on to.
    """

    ROW: str
    HELD: str
    OUT: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a batch's rows of a key are one value: each value costs a round trip and an entry of the store
        self.waiting = handle.getListState("waiting", "part binary")
        self.held = handle.getListState("held", self.HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in self.ROW.split(", ")]
        new = [r for part in rows for r in zip(*(part[c].tolist() for c in names))]
        self.waiting.appendValue((pickle.dumps(new),))
        self.handle.registerTimer(min(r[0] for r in new) * DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        today = timerValues.getCurrentWatermarkInMs() // DAY_MS
        waiting = [r for (part,) in self.waiting.get() for r in pickle.loads(part)] if self.waiting.exists() else []
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        due = sorted((r for r in waiting if r[0] <= today), key=lambda r: r[:3])
        rest = [r for r in waiting if r[0] > today]
        out, held = self.passed(key, due, held, today)
        for state, values in ((self.waiting, [(pickle.dumps(rest),)] if rest else []), (self.held, held)):
            state.put(values) if values else state.clear()
        ahead = [r[0] for r in rest] + [d for d in self.alarms(held) if d > today]
        if ahead:
            self.handle.registerTimer(min(ahead) * DAY_MS)
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in self.OUT.split(", ")])
            yield frame.assign(**{c: (EPOCH + frame[c].to_numpy("timedelta64[D]")).astype("datetime64[ms]") for c in frame if c.endswith("date")})

    def passed(self, key, due: list[tuple], held: list[tuple], today: int) -> tuple[list[tuple], list[tuple]]:
        """The rows to put out and what is held from now on, after rows `due` up to `today` in order of (day, second, third column)."""
        raise NotImplementedError

    def alarms(self, held: list[tuple]) -> list[int]:
        """Days on which something happens to what is held even without a row."""
        return []

    def close(self) -> None:
        pass


def _first(hit: np.ndarray, after: int = 0) -> int:
    """The first true position from `after` on; the length if there is none."""
    found = np.flatnonzero(hit[after:])
    return after + int(found[0]) if len(found) else len(hit)


class TradeTracker(InOrder):
    """Moves a symbol's open trades through its bars: stop, target 2, target 1 (then the stop is the entry), time exit.

    A trade waits like a bar until its entry day has passed and is then held until it ends; only later bars move it.
    """

    ROW = "day int, is_bar boolean, id string, a double, b double, c double, d double"
    HELD = "id string, day int, state string, stop double, entry double, target_1 double, target_2 double"
    OUT = "id string, symbol string, entry_date date, state string, date date, price double"

    def __init__(self, hold_days: int):
        self.hold_days = hold_days

    def passed(self, key, due, held, today):
        bars = np.array([(r[0], *r[3:]) for r in due if r[1]], float).reshape(-1, 5)
        out, kept = [], []
        for trade in [*held, *[(r[2], r[0], "ENTERED", r[4], r[3], r[5], r[6]) for r in due if not r[1]]]:
            moves, trade = self._moved(trade, bars[np.searchsorted(bars[:, 0], trade[1], side="right") :])
            out += [(trade[0], key[0], trade[1], state, day, price) for state, day, price in moves]
            if trade[2] in ("ENTERED", "TARGET_1_HIT"):
                kept.append(trade)
        return out, kept

    def _moved(self, trade, bars):
        name, entered, now, stop, entry, target_1, target_2 = trade
        day, opened, high, low, close = bars.T
        due, moves, at = day - entered >= self.hold_days, [], 0
        if now == "ENTERED":
            hit = _first(high >= target_1)
            if hit < len(day) and hit < min(_first(low <= stop), _first(high >= target_2)) and hit <= _first(due):
                moves.append(("TARGET_1_HIT", int(day[hit]), target_1))
                now, stop, at = "TARGET_1_HIT", entry, hit + 1
        ends = [_first(low <= stop, at), _first(high >= target_2, at), _first(due, at)]
        end = min(ends)
        if end < len(day):
            now = ("STOPPED_OUT", "TARGET_HIT", "TIME_EXIT")[ends.index(end)]
            price = {"STOPPED_OUT": min(stop, opened[end]), "TARGET_HIT": target_2, "TIME_EXIT": close[end]}[now]
            moves.append((now, int(day[end]), float(price)))
        return moves, (name, entered, now, stop, entry, target_1, target_2)


class ExpiringWatchlist(InOrder):
    """A watchlist with one entry per symbol, as the log of its changes.

    An add replaces the symbol's entry. A removal (a hit, a failure) ends it. Without one it expires on the day after its last day of
    life, by a timer, before that day's own rows are handled. Rows of one day: adds in order of their breakout date, then removals;
    `turn` numbers the changes of a day.
    """

    ROW = "day int, removes boolean, breakout_day int, level double, score double"
    HELD = "breakout_day int, level double, score double"
    OUT = "symbol string, date date, turn int, change string, breakout_date date, breakout_level double, original_score double"

    def __init__(self, days: int):
        self.days = days

    def alarms(self, held):
        return [r[0] + self.days + 1 for r in held]

    def passed(self, key, due, held, today):
        out, turns = [], Counter()

        def put(day, change, entry):
            out.append((key[0], day, turns[day], change, *entry))
            turns[day] += 1

        def expire(day):
            nonlocal held
            for end in self.alarms(held):
                if end <= day:
                    put(max(end, day) if due_now else end, "expired", held[0])
                    held = []

        due_now = False
        for day, removes, *entry in due:
            expire(day)
            if removes:
                for e in held:
                    put(day, "removed", e)
                held = []
            else:
                held = [tuple(entry)]
                put(day, "added", held[0])
                due_now = True  # one that is too old when it comes expires on the day it comes
                expire(day)
                due_now = False
        expire(today)
        return out, held
